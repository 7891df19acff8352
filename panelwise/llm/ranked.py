"""Ranked lexical search of whole texts by range maxima.

Documents stay where they are read. A task indexes them chunk by chunk: for each term of the queries
a posting list in the order of doc_id, with a sparse table of its range maxima. A search goes best
first over intervals of documents: the sum of the terms' range maxima bounds what a document of an
interval can score, the interval of the highest bound is split at the document of its greatest single
impact, that document is scored, and both parts get bounds of their own, until no bound reaches the
k-th best score. All queries advance together, so that a step is a numpy operation, and a task's best
scores prune its later chunks from the start. Tasks give their k best for each query, and these are
merged; no text and no posting is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read
from .words import LETTERED, buffer_of, slices, words

#: A chunk ends at so many documents or postings; both bound its sparse tables. Intervals of a query that are split in one step.
CHUNK_DOCS, CHUNK_POSTINGS, AT_ONCE = 4096, 1 << 20, 4
#: Stands for a doc_id that is null: after all others.
NO_ID = (1 << 63) - 1


class Queries:
    """Terms of query texts as sorted 64-bit hashes; each query's distinct terms with their numbers of repeats."""

    def __init__(self, texts: list[str | None]):
        hashes, _, _, first = words(*buffer_of(pa.array(texts, pa.large_string())), LETTERED)
        self.hashes, term = np.unique(hashes, return_inverse=True)
        query = np.repeat(np.arange(len(texts)), np.diff(first))
        pairs, self.times = np.unique(query * (len(self.hashes) + 1) + term, return_counts=True)
        self.query, self.term = np.divmod(pairs, len(self.hashes) + 1)
        self.size = len(texts)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes & np.uint64((1 << 20) - 1)] = True

    def postings(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and (text, term, occurrences) for the terms that it holds."""
        hashes, _, _, first = words(body, offsets, LETTERED)
        at = np.flatnonzero(self.seen[hashes & np.uint64((1 << 20) - 1)])
        term = np.searchsorted(self.hashes, hashes[at])
        term[term == len(self.hashes)] = 0
        good = self.hashes[term] == hashes[at] if len(self.hashes) else np.zeros(0, bool)
        text = np.searchsorted(first, at[good], side="right") - 1
        pairs, times = np.unique(text * max(1, len(self.hashes)) + term[good], return_counts=True)
        return np.diff(first), *np.divmod(pairs, max(1, len(self.hashes))), times


class Best:
    """The k best (score, doc_id) of each query so far: highest scores first, equal scores by ascending doc_id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.zeros((queries, k), np.int64), np.full((queries, k), NO_ID)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes scores above 0; a document must come once only."""
        own = (score > 0) & self.open(query, score, ids)
        query, score, ids = query[own], score[own], ids[own]
        if not len(query):
            return
        some = np.unique(query)
        q = np.concatenate([np.repeat(some, self.k), query])
        s, i = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.id[some].ravel(), ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        head = np.searchsorted(q, some)[:, None] + np.arange(self.k)
        self.score[some], self.id[some] = s[head], i[head]

    def open(self, query: np.ndarray, bound: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """Whether a document of at most this score and at least this doc_id can be among the query's best."""
        last, of = self.score[query, -1], self.id[query, -1]
        return (bound > last) | ((bound == last) & (lowest < of)) & (bound > 0)


class Chunk:
    """Posting lists of some documents in the order of doc_id, with sparse tables of range maxima."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, factor: np.ndarray):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.docs = ids[order], len(ids)
        key = term.astype(np.int64) * self.docs + place[doc]
        by = np.argsort(key, kind="stable")
        self.key, self.factor = key[by], factor[by]
        longest = int(np.bincount(term).max()) if len(term) else 0
        self.log = np.zeros(longest + 1, np.int64)
        for n in range(2, longest + 1):
            self.log[n] = self.log[n >> 1] + 1
        self.table = np.zeros((int(self.log[-1]) + 1, len(key)), np.int32)
        self.table[0] = np.arange(len(key))
        for j in range(1, len(self.table)):
            half, n = 1 << (j - 1), len(key) - (1 << j) + 1
            a, b = self.table[j - 1, :n], self.table[j - 1, half : half + n]
            self.table[j, :n] = np.where(self.factor[a] >= self.factor[b], a, b)

    def highest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The posting of the greatest factor in each range [a, b) of one list; no range is empty."""
        j = self.log[b - a]
        x, y = self.table[j, a], self.table[j, b - (1 << j)]
        return np.where(self.factor[x] >= self.factor[y], x, y)

    def search(self, queries: Queries, weight: np.ndarray, best: Best) -> int:
        """Puts the chunk's documents among the best of each query; returns how many (query, document) were scored."""
        a = np.searchsorted(self.key, queries.term * self.docs)
        b = np.searchsorted(self.key, (queries.term + 1) * self.docs)
        some = np.flatnonzero(b > a)
        query, own = np.unique(queries.query[some], return_inverse=True)
        whole = np.zeros(len(query), np.int64)
        live, scored = self._intervals(query, whole, whole + self.docs, own, queries.term[some], (weight[queries.term] * queries.times)[some], a[some], b[some], best), 0
        while len(live["query"]):
            taken = self._first(live)
            now = {k: v[taken] for k, v in live.items()}
            rest = ~taken
            count = now["count"]
            row = np.repeat(now["rows"] - np.cumsum(count) + count, count) + np.arange(count.sum())
            own, row = np.repeat(np.arange(len(count)), count), self._rows[:, row]
            term, gain, a, b = row
            doc = self.key[now["split"]] % self.docs
            at = np.clip(np.searchsorted(self.key, term * self.docs + doc[own]), a, b)
            there = (at < b) & (self.key[np.minimum(at, len(self.key) - 1)] == term * self.docs + doc[own])
            won = np.where(there, gain * self.factor[np.minimum(at, len(self.key) - 1)], 0)
            scored += len(count)
            best.add(now["query"], np.add.reduceat(won, np.cumsum(count) - count), self.ids[doc])
            n = len(count)
            parts = self._intervals(np.tile(now["query"], 2), np.concatenate([now["low"], doc + 1]), np.concatenate([doc, now["high"]]), np.concatenate([own, own + n]), np.tile(term, 2), np.tile(gain, 2), np.concatenate([a, at + there]), np.concatenate([at, b]), best, self._rows)
            live = {k: np.concatenate([v[rest], parts[k]]) for k, v in live.items()}
            on = best.open(live["query"], live["bound"], self.ids[live["low"]])
            live = {k: v[on] for k, v in live.items()}
        return scored

    def _intervals(self, query, low, high, own, term, gain, a, b, best: Best, rows: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Intervals that can still hold one of the best, with bounds, places to split, and their terms' posting ranges kept in rows."""
        good = b > a
        own, term, gain, a, b = own[good], term[good], gain[good], a[good], b[good]
        if rows is None:
            self._rows, self._used = np.zeros((4, 1 << 12), np.int64), 0
        which, start, count = np.unique(own, return_index=True, return_counts=True)
        if not len(which):
            none = np.zeros(0, np.int64)
            return dict.fromkeys(("query", "low", "high", "bound", "split", "rows", "count"), none)
        top = self.highest(a, b)
        most = gain * self.factor[top]
        bound, peak = np.add.reduceat(most, start), np.maximum.reduceat(most, start)
        at = np.minimum.reduceat(np.where(most == np.repeat(peak, count), np.arange(len(most)), len(most)), start)
        on = best.open(query[which], bound, self.ids[low[which]])
        kept = np.repeat(on, count)
        new = np.stack([term[kept], gain[kept], a[kept], b[kept]])
        while self._used + new.shape[1] > self._rows.shape[1]:
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)], axis=1)
        self._rows[:, self._used : self._used + new.shape[1]] = new
        which, count = which[on], count[on]
        begins = self._used + np.cumsum(count) - count
        self._used += new.shape[1]
        return {"query": query[which], "low": low[which], "high": high[which], "bound": bound[on], "split": top[at[on]].astype(np.int64), "rows": begins, "count": count}

    @staticmethod
    def _first(live: dict[str, np.ndarray]) -> np.ndarray:
        """Marks the few intervals of the highest bounds of each query."""
        query = live["query"]
        order = np.lexsort((live["low"], -live["bound"], query))
        rank = np.arange(len(query)) - np.searchsorted(query[order], query[order])
        taken = np.zeros(len(query), bool)
        taken[order[rank < AT_ONCE]] = True
        return taken


def statistics(docs: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """Documents with a word, words of all documents, and the number of documents that hold each term of ``queries``."""
    sent = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, filled, total = sent.value, 0, 0
        found = np.zeros(len(queries.hashes), np.int64)
        for batch in batches:
            body, offsets = buffer_of(batch.column(0))
            for low, high in slices(offsets):
                at = offsets[low : high + 1]
                n, _, term, _ = queries.postings(body[at[0] : at[-1]], at - at[0])
                found += np.bincount(term, minlength=len(found))
                filled, total = filled + int((n > 0).sum()), total + int(n.sum())
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[filled, total], found[some]]))], names=["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df, at, n = np.zeros(len(queries.hashes), np.int64), sums["term"].to_numpy(), sums["n"].to_numpy()
    df[at[at >= 0]] = n[at >= 0]
    return int(n[at == -2].sum()), int(n[at == -1].sum()), df


def lengths_to_m(n: np.ndarray, filled: int, total: int) -> np.ndarray:
    """25 + (75 * n * N) div L, exact where 64 bits do not hold the product."""
    if len(n) and int(n.max()) * filled * 75 >= 1 << 62:
        return np.array([25 + 75 * int(x) * filled // total for x in n], np.int64)
    return 25 + 75 * n * filled // max(1, total)


def _search(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    """query, doc_id, score: each task's k best of each query."""
    filled, total, df = statistics(docs, queries)
    weight = np.floor(1000 * np.log((2 * filled + 2) / (2 * df + 1))).astype(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = sent.value
        best, held, docs_held = Best(queries.size, k), [], 0

        def close():
            ids, doc, term, factor = (np.concatenate(x) for x in zip(*held))
            if len(doc):
                Chunk(ids, doc, term, factor).search(queries, weight, best)

        for batch in batches:
            body, offsets = buffer_of(batch.column(1))
            every = np.asarray(batch.column(0).fill_null(NO_ID), np.int64)
            for low, high in slices(offsets, rows=CHUNK_DOCS):
                at = offsets[low : high + 1]
                n, doc, term, times = queries.postings(body[at[0] : at[-1]], at - at[0])
                factor = 10**9 * times // (1000 * times + 8 * lengths_to_m(n, filled, total)[doc])
                if held and (docs_held + high - low > CHUNK_DOCS or sum(len(x[1]) for x in held) + len(doc) > CHUNK_POSTINGS):
                    close()
                    held, docs_held = [], 0
                held.append((every[low:high], doc + docs_held, term, factor))
                docs_held += high - low
        if held:
            close()
        query, rank = np.nonzero(best.score)
        ids = best.id[query, rank]
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, mask=ids == NO_ID), pa.array(best.score[query, rank])], names=["query", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "query long, doc_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank: within groups of tasks first, so that no group grows with the number of tasks alone."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    grouped = found.withColumn("__group", F.spark_partition_id() % 256)
    part = grouped.withColumn("rank", F.row_number().over(W.partitionBy("query", "__group").orderBy(*order))).filter(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).drop("__group")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, most_words: int = 500_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for every row of ``queries`` (item_id, text) the ``k`` documents of ``docs`` (doc_id, text) of the highest scores above 0.

    Equal scores go by ascending doc_id, rows without one last. Every row of ``docs`` is a document,
    so that repeated rows have equal scores and ranks of their own; every row of ``queries`` is a
    query, an item_id may be null or repeated. Null and empty texts have no terms; a query without
    terms, or without a document that holds one, has no rows; empty tables give an empty result;
    other columns are not read. doc_id is a whole number below 2 ** 63 - 1. Terms are told apart by
    64-bit hashes.

    Documents are read twice, for statistics and for the search, and not shuffled. The queries reach
    tasks in blocks of about ``most_words`` words; with more than one block, each is searched and
    written to the shared folder before the next is sent.
    """
    spark, kind = docs.sparkSession, queries.schema["item_id"].dataType.simpleString()
    asked = queries.select("item_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    blocks = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // (6 * most_words)))
    results = []
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").toArrow()
        names = spark.createDataFrame(list(enumerate(own["item_id"].to_pylist())), f"query long, item_id {kind}")
        found = _top(_search(docs, Queries(own["text"].to_pylist()), k), k)
        part = found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
        results.append(cut(part) if blocks > 1 else part)
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ranking that the contract of operator 11 names."""
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: DuckDB SQL for the ranking of operator 11: every document that shares a term with the item is scored.
OP11_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as terms from documents),
whole as (select count(*) filter (where len(terms) > 0) as filled, sum(len(terms)) as total from d),
held as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(terms) as n, unnest(terms) as term from d) x group by all),
weights as (select term, cast(floor(1000 * ln((2 * any_value(filled) + 2) / (2 * count(*) + 1))) as bigint) as w from held, whole group by term),
asked as (select q, item_id, term, count(*) as times from (select row_number() over () as q, item_id, unnest({_TERMS}) as term from benchmark) x group by all),
scored as (
  select q, item_id, r, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + cast((75 * n * filled) // total as bigint))))) as bigint) as score
  from asked join weights using (term) join held using (term), whole group by all)
select item_id, cast(rank as int) as rank, doc_id, score from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scored where score > 0) x where rank <= 10"""
