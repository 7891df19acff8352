"""Every corpus operator on odd rows, against brute force where SQL cannot say it."""

import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from panelwise.llm import common, decontaminate, html, language, lines, mixing, neardup, pii, quality, registry, tokens, toxicity

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, h string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, one-word, repeated, very long and odd-character rows, and columns that clash with the operators' own."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "the", "and"]) + str(rng.randrange(9999)) for _ in range(60_000))
    texts = [None, "", " \n\t ", "word", "four words are here", "The same text of some words that stands twice in this table, as it is.", long, "naïve café — ½ 日本語 \x00 \x0b end", "a" * 200_000]
    rows = [(i, t, "en", "s1" if i % 2 else None, len(t or ""), "x", "y") for i, t in enumerate(texts)]
    rows += [(50, texts[5], "en", "s1", 1, "x", "y"), (5, texts[5], "en", "s1", 71, "x", "y"), (None, texts[5], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, SF, "documents").cache()


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_quality_counts(odd, docs):
    for df in (odd, docs):
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_features(df).collect()), key=repr)
        assert got == sorted(((i, *brute.quality_counts(t)) for i, t in plain(df)), key=repr)


def test_quality_keeps_good_documents(spark, docs):
    scored = quality.score_quality(docs).join(common.read(spark, SF, "labels").withColumnRenamed("quality", "label"), "doc_id").filter("not base_failed")
    good = scored.groupBy("label").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rate = {r.label: r.k for r in good}
    assert rate[1] > 0.95 and rate.get(0, 0) < 0.3


def test_fit_votes_finds_the_accurate_rule():
    # rule 0 is right, rule 1 votes at random
    fitted = quality.fit_votes({"11": 400, "12": 400, "10": 100, "00": 60, "01": 60, "02": 60})
    assert fitted["12"] > 0.9 > 0.5 > fitted["02"] and quality.fit_votes({}) == {}


def test_quality_of_odd_rows(odd, spark):
    out = quality.score_quality(odd)
    assert out.count() == odd.count() and not out.filter("kept and n_words < 20").count()
    assert quality.filter_quality(odd).columns == odd.columns
    assert quality.score_quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_counts_equal_the_library(odd, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    more = odd.sparkSession.createDataFrame([(90, "<|endoftext|> in a text"), (91, "a  b \n\n c\t's don't")], "doc_id long, text string")
    for df in (odd.select("doc_id", "text"), docs.select("doc_id", "text").limit(60), more):
        got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df).collect()), key=repr)
        want = []
        for i, t in plain(df):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            want.append((i, len((t or "").encode()), n, n > 512))
        assert got == sorted(want, key=repr)


def test_decontamination(spark, odd, docs):
    bench = common.read(spark, SF, "benchmark").union(spark.createDataFrame([(900, None), (901, "!?"), (902, "are HERE"), (None, "word")], "item_id long, text string"))
    items = [tuple(r) for r in bench.collect()]
    for df in (odd.filter("doc_id is not null and doc_id != 5"), docs):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(df, bench).collect()}
        assert got == brute.contamination(plain(df), items)
    clean = decontaminate.drop_contaminated(odd, bench)
    bad = sum(brute.contamination([(0, t)], items)[0][1] > 0 for _, t in plain(odd))
    assert bad and clean.columns == odd.columns and clean.count() == odd.count() - bad
    assert decontaminate.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_a_large_benchmark_takes_several_passes(spark, docs):
    bench = common.read(spark, SF, "benchmark")
    one = {(r.doc_id, r.n_words, tuple(sorted(map(tuple, r.spans))), tuple(sorted(r["items"]))) for r in decontaminate.benchmark_hits(docs, bench).collect()}
    many = {(r.doc_id, r.n_words, tuple(sorted(map(tuple, r.spans))), tuple(sorted(r["items"]))) for r in decontaminate.benchmark_hits(docs, bench, most_words=300).collect()}
    assert one == many


def test_near_duplicates(odd, docs):
    for df in (odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), docs):
        want = brute.components(plain(df))
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
        assert got == {i: (len(brute.shingles(t)), want[i], want[i] == i) for i, t in plain(df)}
    every = neardup.near_duplicates(odd)
    assert every.count() == odd.count() and every.filter("doc_id is null and not kept").count() == 0
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_a_large_group_around_one_text(spark, edits):
    """Copies with edits of their own, close to the base or to few others: buckets stay split and the exact search joins them."""
    rng = random.Random(edits)
    base = [f"w{rng.randrange(10**6)}" for _ in range(70)]
    data = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(edits, edits + 3)):
            words[rng.randrange(70)] = f"x{rng.randrange(10**9)}"
        data.append((i * 3, " ".join(words)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, small=4).collect()}
    assert got == brute.components(data)


def test_line_dedup(spark, odd):
    a = "first line of a passage that is long\nsecond line of it, also with words\nthird line and then the end of it"
    single = " ".join(f"word{i}" for i in range(55))
    data = [(3, f"unique beginning\n{a}\nown end three"), (1, f"{a}\nown end one"), (2, "short line\nof a clean text"), (4, "short line\nwith another end"), (5, f"x\n{single}\ny"), (6, f"{single}"), (7, None), (8, "")]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"), long_line=40).collect()}
    assert got[1] == (data[1][1], 0) and got[2] == (data[2][1], 0) and got[4] == (data[3][1], 0)
    assert got[3] == ("unique beginning\nown end three", 3)
    assert got[5] == (data[4][1], 0) and got[6] == ("", 1) and got[7] == (None, 0) and got[8] == ("", 0)
    out = lines.dedup_lines(odd)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "n_lines", "n_removed"]
    assert lines.dedup_lines(odd.limit(0)).count() == 0


def test_line_dedup_loses_no_line_and_leaves_no_long_repeat(docs):
    before, out = dict(plain(docs)), dict(plain(lines.dedup_lines(docs, long_line=40)))
    kept = {x for t in out.values() for x in (t or "").split("\n")}
    assert all(x in kept for t in before.values() for x in (t or "").split("\n") if x.strip())
    seen = {}
    for i, t in out.items():
        for x in set((t or "").split("\n")):
            if len(x.split()) >= 50:
                assert seen.setdefault(x, i) == i


def test_mixing(spark, odd, docs):
    out = mixing.mix_sources(docs).collect()
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert abs(sum(t for t, _, _ in by.values()) - total) < 1e-6 * total and sum(k for _, k, _ in by.values()) <= total
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, out), key=repr)
    strange = mixing.mix_sources(odd)
    assert strange.count() == odd.count() and strange.filter("size = 0 and taken > 0").count() == 0
    assert mixing.mix_sources(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.select("doc_id", "text", "source")).count() > 0


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 50)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30.0 and got[None] == 150.0 and abs(got["b"] - 2 * got["c"]) < 1e-9 and abs(sum(got.values()) - 2060) < 1e-9


def test_language(spark, docs, odd):
    codes = language.train_language(docs)
    got = language.identify_language(docs, codes).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    rate = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert rate > 0.95
    strange = {r.doc_id: r for r in language.identify_language(odd.filter("doc_id is not null"), codes).collect()}
    assert [strange[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and strange[3].lang_pred in codes.languages
    assert all(0 <= r.score <= 1 and r.held_out == (crc32(str(i).encode()) % 4 == 2) for i, r in strange.items())
    assert language.identify_language(odd, language.train_language(odd.limit(0))).filter("lang_pred != 'und'").count() == 0


def test_codewords_differ():
    for k in (2, 4, 5, 12):
        words = language.codewords(k)
        assert len({tuple(w) for w in words}) == k and all(len(set(c)) == 2 for c in words.T) or k > 5


def test_toxicity(spark):
    docs, labels = common.read(spark, "/root/testdata/sf0.01", "documents"), common.read(spark, "/root/testdata/sf0.01", "labels")
    machine = toxicity.train_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, machine).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_the_machine_learns_a_pair():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 4)).astype(np.float32)
    y = ((x[:, 0] == 1) & (x[:, 1] == 1)).astype(np.float32)
    machine = toxicity.Machine(np.arange(4, dtype=np.uint64))
    machine.fit(x, y, epochs=60)
    row, at = np.nonzero(x)
    predicted = machine.raw(len(x), row, at) > 0
    assert (predicted == (y == 1)).mean() > 0.98


def test_toxicity_of_odd_rows(spark, odd):
    none = toxicity.train_toxicity(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    out = toxicity.score_toxicity(odd, none)
    assert out.count() == odd.count() and out.filter("score between 0 and 1").count() == odd.count() and out.filter("predicted = 1").count() == 0
    assert toxicity.drop_toxic(odd, none).columns == odd.columns


def test_pii_base_spans(odd, docs):
    rng = random.Random(5)
    texts = [t for _, t in plain(odd) + plain(docs)] + ["".join(rng.choice("a1.@+- ()92b\n") for _ in range(60)) for _ in range(2000)]
    assert all(sorted(pii.base_spans(t or "")) == brute.base_spans(t) for t in texts if len(t or "") < 100_000 or "@" not in t)


def test_pii_adds_other_forms_and_leaves_the_rest(spark):
    field = pii.Field().train()
    found = lambda t: [(pii.KINDS[k], t[s:e]) for k, s, e in pii.find_pii([t], field)[0][1]]
    assert found("please call (555) 123-4567 now") == [("phone", "(555) 123-4567")]
    assert found("mail jo [at] example [dot] com please") == [("email", "jo [at] example [dot] com")]
    assert found("on 2021-03-14 version 3.2.1 of 1999 under CC BY-NC 4.0.") == []
    assert found("x 5731080387325255 y") == []  # fails Luhn


def test_pii_digest(odd):
    out = {r.doc_id: r for r in pii.detect_pii(odd.filter("doc_id is not null")).collect()}
    assert out[0].base_sha256 == brute.sha("") and out[0].spans == "" and out[6].n_card == 0


def test_html(spark):
    page = (
        '<html><head><title>t</title><script>var a="<p>x</p>";</script></head><body><nav><a href="/">Home</a></nav><header><p>Site</p></header>'
        '<div class="cookie-notice"><p>We use the cookies that are of use to you and to us, and it is for this site and for all of the others.</p></div>'
        "<article><h1>A title</h1><p>It is the first of the paragraphs &amp; it\n has  white space, and that is for the test of it.</p><p>Short.</p><ul><li>one</li><li>two</li></ul>"
        '<div class="comments"><p>I am a reader and it was the best of all that is on the net for me.</p></div></article>'
        "<aside>side</aside><form>name</form><footer>&copy; us</footer></body></html>"
    )
    want = "A title\nIt is the first of the paragraphs & it has white space, and that is for the test of it.\nShort.\none\ntwo"
    df = spark.createDataFrame([(1, "u", page, 7), (2, None, None, 7), (3, "v", "", 7), (4, "w", "<p>unclosed <b", 7), (1, "u", page, 7)], "page_id long, url string, html string, n_chars int")
    got = html.extract_text(df).orderBy("page_id", "text").collect()
    assert [r.text for r in got if r.page_id == 1] == [want] * 2 and [r.n_chars for r in got if r.page_id in (2, 3)] == [0, 0]
    assert html.extract_text(df).columns == ["page_id", "url", "html", "text", "n_chars"]


def test_html_of_the_pages(spark):
    import html as references
    import re

    for r in registry.QUERIES["op5_html_text"](spark, SF).join(common.read(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        parts = [" ".join(references.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(p for p in parts if p)


def test_registered_queries_carry_doc_ids(spark):
    for name, query in registry.QUERIES.items():
        columns = query(spark, SF).columns if name in ("op3_token_counts", "op9_pii", "op5_html_text") else ["doc_id"]
        assert columns[0] in ("doc_id", "page_id")
