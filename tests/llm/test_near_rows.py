"""Components against a plain union-find, and near-dedup on rows without and with repeated ids."""

import random

from panelwise.llm import neardup
from panelwise.llm.graph import components


def test_components_in_many_partitions(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    some = [tuple(sorted(rng.sample(range(200, 300), 2))) for _ in range(70)]
    edges = chain + star + some
    above = {x: x for e in edges for x in e}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    want = {x: top(x) for x in above if top(x) != x}
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    for most in (1000, 12):
        rows = components(df, most).collect()
        assert len(rows) == len(want) and {r.v: r.c for r in rows} == want
    assert components(df.limit(0)).count() == 0


def _text(name, n=30):
    return " ".join(f"{name}{i}" for i in range(n))


def test_rows_are_told_apart_by_their_own_text(spark):
    x, y, z = _text("x"), _text("y"), _text("z")
    data = [(3, x, "a"), (5, x + " more", "b"), (5, y, "c"), (None, y, "d"), (None, z, "e"), (None, z + " more", "f"), (7, z.upper()[:0], "g"), (None, None, "h"), (3, x, "i"), (3, x, "j"), (2, y + " more", "k")]
    df = spark.createDataFrame(data, "doc_id long, text string, best string")
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicates(df).collect())
    kept_z = {r.best for r in neardup.drop_near_duplicates(df).collect()} & {"e", "f"}
    assert len(kept_z) == 1
    assert [r for r in found if r[2] == "3"] == [("3", 26, "3", True)] * 3 + [("5", 27, "3", False)]
    assert [r for r in found if r[2] == "2"] == [("2", 27, "2", True), ("5", 26, "2", False), ("None", 26, "2", True)]
    assert sorted(r[3] for r in found if r[2] == "None" and r[1]) == [True, True]
    left = sorted(r.best for r in neardup.drop_near_duplicates(df).collect())
    assert len(left) == 5 and {"g", "h", "k"} <= set(left) and len({"a", "i", "j"} & set(left)) == 1
    assert neardup.drop_near_duplicates(df).columns == df.columns
