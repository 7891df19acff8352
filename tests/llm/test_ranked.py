"""Operator 11 against plain Python over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from panelwise.llm import ranked
from panelwise.llm.ranked import Best, Chunk, Queries, op11_ranked_search, ranked_search
from panelwise.llm.words import buffer_of

from .brute import lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) of every item; docs and items may repeat."""
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(x for _, b in bags for x in b)
    weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for x, d in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n) // total
            s = sum(weight[x] * ((10**9 * b[x]) // (1000 * b[x] + 8 * m)) for x in TERM.findall(lower(text)) if x in b)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows_and_ties(spark):
    texts = ["the cat sat", "The CAT sat!", None, "", "!!!", "cat cat cat dog", "é 中文 ½ the", "x" * 5000 + " dog", "sat " * 3000]
    docs = [(k if k % 7 else None, t, "clash") for k, t in enumerate(texts * 5)]
    items = [(1, "the cat the cat"), (2, None), (3, "..."), (None, "dog"), (1, "SAT É"), (4, "absent words")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(5)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    want = brute([x[:2] for x in docs], items, 4)
    assert found(ranked_search(d, q, 4)) == want and len(want) > 8
    assert found(ranked_search(d, q, 4, most_words=1)) == want  # in several blocks
    assert ranked_search(d.limit(0), q).count() == 0 and ranked_search(d, q.limit(0)).count() == 0
    assert ranked_search(d, q).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_small_chunks_and_many_terms(spark, monkeypatch):
    dice = random.Random(11)
    word = lambda: f"w{int(dice.paretovariate(0.6)) % 400}"
    docs = [(k, " ".join(word() for _ in range(dice.randint(0, 60)))) for k in range(1500)]
    items = [(k, " ".join(word() for _ in range(dice.randint(1, 40)))) for k in range(25)]
    monkeypatch.setattr(ranked, "CHUNK_DOCS", 100)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(ranked_search(d.repartition(3), q)) == brute(docs, items)


def test_bounds_leave_most_documents_unscored():
    dice = random.Random(3)
    texts = [" ".join(f"w{dice.randint(0, 300)}" for _ in range(30)) for _ in range(2000)]
    texts[700] = texts[1300] = "alpha beta gamma delta"
    queries, best = Queries(["alpha beta gamma delta", "w1 w2"]), Best(2, 2)
    n, doc, term, times = queries.postings(*buffer_of(pa.array(texts, pa.large_string())))
    chunk = Chunk(np.arange(2000), doc, term, 10**9 * times // (1000 * times + 8 * n[doc]))
    scored = chunk.search(queries, np.full(len(queries.hashes), 1000), best)
    assert best.id[0].tolist() == [700, 1300] and best.score[0, 0] == best.score[0, 1]
    assert scored < 60


def test_range_maxima():
    factor = np.array([5, 1, 9, 9, 2, 7, 7], np.int64)
    chunk = Chunk(np.arange(7), np.arange(7), np.zeros(7, np.int64), factor)
    for a in range(7):
        for b in range(a + 1, 8):
            assert chunk.highest(np.array([a]), np.array([b]))[0] == a + int(np.argmax(factor[a:b]))


def test_long_documents_do_not_overflow():
    n = np.array([10**9, 3], np.int64)
    assert ranked.lengths_to_m(n, 10**11, 10**13).tolist() == [25 + 75 * 10**9 * 10**11 // 10**13, 25 + 75 * 3 * 10**11 // 10**13]


def test_query(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(op11_ranked_search(spark, path)) == brute(docs, items)
