"""Line dedup on passages beside other repeated lines, between blank lines, and against brute force."""

import random

from panelwise.llm import common, lines

SF = "/root/testdata/sf0.001"


def brute(docs, long_line=None):
    """{doc_id: text} by looking up every window; doc_ids are distinct and not null."""
    split = {i: [(p, x) for p, x in enumerate(t.split("\n")) if x.split()] for i, t in sorted(docs)}
    first, out = {}, {}
    for i, own in split.items():
        for k in range(len(own)):
            if long_line and len(own[k][1].split()) >= long_line:
                first.setdefault((own[k][1],), (i, k))
            if k + 1 < len(own):
                first.setdefault((own[k][1], own[k + 1][1]), (i, k))
    for i, t in docs:
        own, gone = split[i], set()
        for n in (1, 2):
            for k in range(len(own) - n + 1):
                at = first.get(tuple(x for _, x in own[k : k + n]))
                if at and (at[0] != i or k >= at[1] + n):
                    gone |= set(range(own[k][0], own[k + n - 1][0] + 1))
        out[i] = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
    return out


def dedup(spark, data, long_line=None):
    return {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"), long_line).collect()}


def test_a_passage_beside_another_repeated_line(spark):
    a = "\n".join(f"line {k} of the passage" for k in range(3))
    data = [(1, f"one\n{a}\nend one"), (2, f"common header\n{a}\nend two"), (3, "common header\nend three"), (4, f"four\n{a}\ncommon footer\nend four"), (5, "x\ncommon footer\ny")]
    got = dedup(spark, data)
    assert got[2] == ("common header\nend two", 3) and got[4] == ("four\ncommon footer\nend four", 3)
    assert all(got[i] == (dict(data)[i], 0) for i in (1, 3, 5))


def test_paragraphs_between_blank_lines_and_beside_long_ones(spark):
    short = [" ".join(f"p{k}w{i}" for i in range(15)) for k in range(4)]
    long = " ".join(f"word{i}" for i in range(55))
    data = [(1, "\n\n".join(["a", *short, "b"])), (2, "\n\n".join(["c", *short, "d"])), (3, f"heading\n{long}\nclosing\ne"), (4, f"f\nheading\n \n{long}\nclosing\ng")]
    got = dedup(spark, data)
    assert got[2] == ("c\n\n\nd", 7) and got[4] == ("f\ng", 4)
    assert got[1] == (data[0][1], 0) and got[3] == (data[2][1], 0)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    pool = [f"line {k}" for k in range(25)] + [" ".join(f"long{k}w{i}" for i in range(45)) for k in range(4)] + ["", " "]
    data = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {i} {k}" for k in range(rng.randrange(1, 25)))) for i in range(60)]
    given = [(r.doc_id, r.text) for r in common.read(spark, SF, "documents").collect()]
    for docs in (data, given):
        for long_line in (None, 40):
            assert {i: t for i, (t, _) in dedup(spark, docs, long_line).items()} == brute(docs, long_line)


def test_one_line_is_no_passage_whatever_its_length(spark):
    data = [(i, f"own {i}\n" + " ".join(f"w{k}" for k in range(n)) + f"\nend {i}") for i in range(3) for n in (39, 40, 400)]
    assert all(r.n_removed == 0 for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect())


def test_chunks_are_shift_resistant_and_windows_extend_them(spark):
    rng = random.Random(21)
    passage = [f"line {rng.randrange(10**6)} of it" for _ in range(60)]
    texts = ["\n".join(passage), "\n".join(["one of its own", *passage, "and another"]), "\n".join(["x y"] * 3 + passage[5:40] + ["z w"]), "\n".join(passage[7:9])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = lines.cut(lines.line_places(df))
    by_doc = {d: [(r.h, r.c) for r in sorted(x, key=lambda r: r.i)] for d, x in _grouped(places.collect()).items()}
    cut_after = {d: {h for (h, c), (_, after) in zip(x, x[1:]) if c != after} for d, x in by_doc.items()}
    assert len(cut_after[0]) > 2 and cut_after[0] == cut_after[1]  # the same boundaries, wherever the passage stands
    matched = lines.repeated_chunks(places)
    assert {r.n for r in matched.collect()} and matched.filter("f1 = r1 and f2 = r2").count() == 0
    left = lines.line_windows(places, lines.cut(matched)).count()
    assert left < places.filter("k is not null").count()
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(df).collect()}
    assert got[0] == (texts[0], 0) and got[1] == ("one of its own\nand another", 60) and got[2] == ("x y\nx y\nx y\nz w", 35) and got[3] == ("", 2)


def _grouped(found):
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    return by
