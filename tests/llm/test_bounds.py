"""What reaches the driver, a broadcast or a task is bounded; repeated ids, long lines, large benchmarks and hostile pages."""

import pickle
import random
import re
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwise.llm import common, decontaminate, html, language, mixing, pii, tokens, toxicity

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def one_id(spark):
    """20,000 rows, all but 40 of one doc_id, half of these with one text."""
    words = {"en": ["the", "and", "that", "with", "house"], "de": ["der", "und", "nicht", "mit", "haus"]}
    rng = random.Random(2)
    rows = []
    for i in range(20_000):
        lang = "de" if i % 4 == 0 else "en"
        number = 1 if i % 500 else i + 10
        rows.append((number, " ".join(rng.choice(words[lang]) for _ in range(8)) + (f" {i}" if i % 2 else " same"), lang, "s", 1))
    return spark.createDataFrame(rows, DOCS)


def test_language_sample_is_bounded(spark, one_id, monkeypatch):
    seen, fit = [], language.Codes.fit
    monkeypatch.setattr(language.Codes, "fit", lambda self, x, label, **k: seen.append((len(x), sorted(set(label.tolist())))) or fit(self, x, label, **k))
    codes = language.train_language(one_id, each=200, most=300)
    assert codes.languages == ["de", "en"] and seen[0][0] <= 300 and seen[0][1] == [0, 1]
    got = language.identify_language(one_id, codes)
    assert got.count() == 20_000 and got.join(one_id.select(*common.row_ids(), "lang").distinct(), ["r1", "r2"]).filter("lang = lang_pred").count() > 19_000
    assert language.identify_language(one_id.limit(0), codes).count() == 0
    assert language.train_language(one_id.filter("lang = 'en'")).languages == ["en"]


def test_toxicity_sample_is_bounded(spark, one_id, monkeypatch):
    labels = one_id.filter("lang = 'en'").groupBy("doc_id").agg(F.lit(1).alias("quality"), (F.col("doc_id") % 1000 < 500).cast("int").alias("toxic"))
    seen, fit = [], toxicity.Machine.fit
    monkeypatch.setattr(toxicity.Machine, "fit", lambda self, x, y, **k: seen.append(len(x)) or fit(self, x, y, **k))
    machine = toxicity.train_toxicity(one_id, labels, most=100)
    assert len(machine.known) <= 1024 and all(n <= 300 for n in seen)
    assert toxicity.score_toxicity(one_id.limit(0), machine).count() == 0


def test_padded_batches_are_bounded():
    rng = random.Random(1)
    texts = [f"call {rng.randrange(10**6)} or {rng.randrange(10**6)} now" for _ in range(255)]
    texts.append(" ".join(f"w{i}" if i % 3 else str(i) for i in range(200_000)))
    todo = sorted(((i, s) for i, t in enumerate(texts) for s in pii._sequences(t)), key=lambda x: len(x[1]))
    parts = list(pii._batches(todo))
    assert [x for part in parts for x in part] == todo and max(len(s) for _, s in todo) > 100_000
    assert all(len(part) == 1 or len(part) * len(part[-1][1]) <= 1 << 16 for part in parts)
    field = pii.Field().train()
    assert pii.find_pii(texts, field)[:255] == pii.find_pii(texts[:255], field)


def test_a_word_has_its_whole_shape():
    assert pii._shape("a-" * 40 + "1") == "x-" * 40 + "d" and pii._shape("x" * 100 + "7") == "xd"


def test_pii_of_an_empty_table(spark):
    assert pii.detect_pii(spark.createDataFrame([], DOCS)).count() == 0


def test_other_scripts_leave_the_rest_of_a_text_to_both_tiers(spark):
    with open(tokens.default_tokenizer(), encoding="utf-8") as f:
        text = f.read()
    counter, library = tokens.Counter(text, tokens.frequent_lengths(text)), tokens._load(text)
    rng = random.Random(1)
    parts = ["the", "Word", "it's", " ", "  ", "\n", "日本", "語", "привет", "😀", "é", "x1", "12", ",", "™", "αβγ", "\u2003", "a", "العربية", "e\u0301", "<|endoftext|>", "don't"]
    for _ in range(500):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randrange(1, 60)))
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids)
    words = " ".join("plain words of english text go here" for _ in range(4000))
    for t, most in ((f"{words} 日本語 {words}", 50), (words[: tokens.LONG_TEXT + 5] + "語" * 10 + words, 50), (words + words, 0), ("語" * 70_000 + words, 70_020)):
        counter.library = 0
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids) and counter.library <= most
    assert tokens.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    unset = N(getCheckpointDir=lambda: N(isDefined=lambda: False))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            common.shared_folder(N(sparkContext=N(master=master, _jsc=N(sc=lambda: unset)), conf=N(get=lambda *a: None)))


def test_patterns_are_small():
    rng = random.Random(5)
    items = [(str(i), " ".join(f"w{rng.randrange(10**5)}" for _ in range(60))) for i in range(1000)]
    patterns = decontaminate.Patterns(items)
    (table,) = patterns.tables
    assert len(table["at"]) == 51_000 and (table["shift"] == 0).mean() < 0.2
    assert len(pickle.dumps(patterns)) < 150 * 51_000


def test_items_without_an_id_in_pieces_and_repeated(spark):
    rng = random.Random(6)
    long = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
    other = [f"u{rng.randrange(10**6)}" for _ in range(30)]
    bench = [(None, " ".join(other)), ("7", " ".join(long)), ("8", "Only THREE words"), ("9", " ".join(long[100:150])), ("10", None), ("11", " ... "), ("9", " ".join(long[100:150]))]
    docs = [(1, "x " + " ".join(long[1990:2030]) + " y"), (2, " ".join(other[3:20])), (3, "so only three, words"), (4, "clean text of some words that are not in it"), (5, None), (1, "clean again"), (1, "clean again")]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")
    for most in (500_000, 800):
        got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(df, items, most_words=most).collect())
        assert got == [(1, 2, 0, ()), (1, 2, 0, ()), (1, 42, 40, ("7",)), (2, 17, 17, ()), (3, 4, 3, ("8",)), (4, 10, 0, ()), (5, 0, 0, ())]
    assert decontaminate.contamination(df.limit(0), items).count() == 0


def _bare(page):
    """The page without the elements and names that say what holds the text."""
    page = re.sub(r"(?i)<(/?)(article|main|nav|aside|header|footer|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r'(?i)\s(?:class|id|role)="[^"]*"', "", page)


def _f1(want, got):
    a, b = want.split("\n"), got.split("\n")
    return 2 * sum(min(a.count(x), b.count(x)) for x in set(a)) / max(1, len(a) + len(b))


def test_pages_without_containers(monkeypatch):
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    article = lambda x: "\n".join(b.text for b in html.blocks(x) if b.inside and not b.aside)
    want = [article(x) for x in pages]
    assert [html.main_text(x) for x in pages] == want
    mean = lambda: sum(_f1(w, html.main_text(_bare(x))) for w, x in zip(want, pages)) / len(pages)
    assert mean() >= 0.95
    monkeypatch.setattr(html, "score", lambda *a: 0.0)
    assert mean() < 0.5


def test_hostile_pages_take_linear_time():
    begun = time.time()
    for piece in ('<a "', "<a \" ' >", "<!", "<a ", "<article>", "<script>", "<template>", '<div "><b>', "<a href='x", "<option>", "<li><table>"):
        html.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - begun < 60
    assert html.main_text("<article><p>It is " + "<span>" * 5000 + "here</article> and not here") == "It is here"
    assert html.main_text('<article><p>An <a href="x>unclosed</a> quote') == "An unclosed quote"


def test_mix_of_rows_without_ids_and_with_clashing_columns(spark):
    rows = [(None if i % 2 else 7, " ".join(["w"] * (1 + i % 5)) + f" {i}", "s" if i % 3 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long").withColumn("h", F.lit("h")).withColumn("r1", F.lit(1)).withColumn("taken", F.lit(2))
    mix = mixing.mix_sources(df)
    assert mix.count() == 300
    by = {r["source"]: (r["t"], r["s"]) for r in mix.groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("s")).collect()}
    assert all(abs(t - s) <= 18 for t, s in by.values())
    out = mixing.mixed_documents(df)
    assert out.columns == ["doc_id", "text", "source", "h", "r1", "size", "source_size", "target", "copies", "taken"] and out.filter("taken != size * copies").count() == 0
    again = sorted(map(tuple, mixing.mix_sources(df.repartition(3)).collect()), key=repr)
    assert again == sorted(map(tuple, mix.collect()), key=repr)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Every stage on null, empty, long, repeated and id-less rows and clashing columns, and on no rows."""
    long = " ".join(f"w{i}" for i in range(30_000))
    text = "A text of some words that stands in two rows of this table, as it is.\nAnd a second line of it."
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (5, text), (5, text), (6, text), (None, text), (None, None), (7, "one")]
    odd = spark.createDataFrame([(i, t, None, None, None, "x", "y", 3) for i, t in rows], DOCS + ", r1 string, stays string, best int")
    spark.createDataFrame([(5, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("1", "four words of text"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd, str(tmp_path)), stage(spark, odd.limit(0), str(tmp_path))
        assert none.count() == 0
        if name == "mixing":
            assert out.filter("taken < 1").count() == 0
            continue
        assert out.columns == common.DOC_COLUMNS and none.columns == common.DOC_COLUMNS
        kept = sorted(repr(r.doc_id) for r in out.collect())
        want = {"near_dedup": ["1", "2", "3", "4", "5", "7", "None"], "toxicity": sorted(repr(i) for i, _ in rows), "decontamination": sorted(repr(i) for i, _ in rows), "line_dedup": ["1", "2", "3", "4", "7", "None", "None"]}[name]
        assert kept == want, name


def test_quality_posterior_equals_brute_force(spark):
    """Expectation maximisation over documents one by one, in place of the histogram of their patterns."""
    from math import exp, log

    from panelwise.llm import quality

    scored = quality.score_quality(common.read(spark, SF, "documents")).select("doc_id", "pattern", "quality", "base_failed", "kept").collect()
    votes = [r.pattern for r in scored]
    n, extra = len(votes), 0.02 * len(votes)
    prior = ({"1": 0.25, "0": 0.35, "2": 0.4}, {"1": 0.6, "0": 0.01, "2": 0.39})
    good = [0.1 if "0" in v else 0.9 for v in votes]
    for _ in range(60):
        weights = ([1 - g for g in good], good)
        share = (sum(good) + 0.8 * extra) / (n + extra)
        logs = [log(share / (1 - share))] * n
        for j in range(len(votes[0])):
            chance = [{v: (sum(w for w, x in zip(weights[c], votes) if x[j] == v) + extra * prior[c][v]) / (sum(weights[c]) + extra) for v in "012"} for c in (0, 1)]
            logs = [old + log(chance[1][x[j]] / chance[0][x[j]]) for old, x in zip(logs, votes)]
        good = [1 / (1 + exp(-x)) for x in logs]
    assert all(abs(g - r.quality) < 1e-9 for g, r in zip(good, scored))
    assert all(r.kept == (not r.base_failed and g >= 0.5) for g, r in zip(good, scored))
    assert brute.quality_counts("a b")[0] == 2


def test_every_language_with_a_training_row_is_learned(spark):
    rng = random.Random(66)
    word = lambda k: "".join(chr(97 + (rng.randrange(5) * 7 + k) % 26) for _ in range(6))
    rows = [(i, " ".join(word(0) for _ in range(12)), "common") for i in range(400)]
    rows += [(1000 + 10 * k + j, " ".join(word(k) for _ in range(12)), f"rare{k:02d}") for k in range(1, 26) for j in range(6)]
    codes = language.train_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), each=20, most=30, floor=2)
    assert codes.languages == sorted({r[2] for r in rows})
    # the sample has the floor of rows, not one language's
    wide = language.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), codes)
    assert wide.filter("lang_pred like 'rare%'").count() > 0
