"""Toxicity by a factorisation machine over hashed terms.

Terms are the distinct words of a text and their stems, as 64-bit hashes. The machine scores
w0 + sum of w_i + sum over pairs of <v_i, v_j>: the last part learns that two terms together mean
what neither means alone. It is trained here, on a bounded sample of the labelled training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, cut, held_out, keep_row, read, row_ids
from .words import LETTERED, buffer_of, slices, words

STEM, THRESHOLD = 5, 0.7


def _terms(column: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: its range, (row, term) pairs without repetition; only ``known`` (sorted) terms if given."""
    body, offsets = buffer_of(column)
    near = None
    if known is not None:
        near = np.zeros(1 << 16, bool)
        near[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    for low, high in slices(offsets):
        at = offsets[low : high + 1]
        hashes, _, _, first, stems = words(body[at[0] : at[-1]], at - at[0], LETTERED, STEM)
        row = np.repeat(np.arange(high - low), np.diff(first))
        row, term = np.concatenate([row, row]), np.concatenate([hashes, stems])
        if known is not None:
            maybe = np.flatnonzero(near[(term & np.uint64(0xFFFF)).astype(np.int64)])
            row, term = row[maybe], term[maybe]
            place = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
            hit = known[place] == term if len(known) else np.zeros(0, bool)
            row, term = row[hit], place[hit].astype(np.uint64)
        order = np.lexsort((term, row))
        row, term = row[order], term[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
        yield low, high, row[new], term[new]


class Machine:
    """A factorisation machine over ``known`` terms; ``fit`` is deterministic."""

    def __init__(self, known: np.ndarray, rank: int = 8):
        self.known, rng = known, np.random.default_rng(3)
        self.bias, self.w, self.v = 0.0, np.zeros(len(known), np.float32), rng.normal(0, 0.02, (len(known), rank)).astype(np.float32)

    def raw(self, rows: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores before the logistic function of ``rows`` texts, given their (row, place of term) pairs."""
        total = np.full(rows, self.bias, np.float64)
        if len(at):
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            v = self.v[at].astype(np.float64)
            pairs = (np.add.reduceat(v, starts, axis=0) ** 2).sum(1) - np.add.reduceat((v * v).sum(1), starts)
            total[row[starts]] += np.add.reduceat(self.w[at].astype(np.float64), starts) + 0.5 * pairs
        return total

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 256, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Adam over the dense 0/1 matrix ``x`` of a bounded sample, ``steps`` steps at least."""
        rng, step = np.random.default_rng(5), 0
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.w, self.v)]
        for _ in range(max(epochs, -(-steps * batch // len(y)))):
            order = rng.permutation(len(y))
            for low in range(0, len(order), batch):
                rows = order[low : low + batch]
                xb, step = x[rows].astype(np.float32), step + 1
                s = xb @ self.v
                raw = self.bias + xb @ self.w + 0.5 * ((s * s).sum(1) - xb @ (self.v * self.v).sum(1))
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]).astype(np.float32) / len(rows)
                gw = xb.T @ g + decay * self.w
                gv = xb.T @ (g[:, None] * s) - (xb.T @ g)[:, None] * self.v + 10 * decay * self.v
                self.bias -= rate * float(g.sum())
                for p, grad, (m, q) in zip((self.w, self.v), (gw, gv), state):
                    m *= 0.9
                    m += 0.1 * grad
                    q *= 0.999
                    q += 0.001 * grad * grad
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = 4000, longest: int = 50_000, terms: int = 1024) -> Machine:
    """The machine fitted on at most ``most`` toxic and twice as many other labelled rows.

    The sample is bounded: the first rows of each label by a hash of doc_id, among training rows
    (held-out rows never count) with texts of ``longest`` characters at most; where doc_ids repeat
    with different texts, an even part of these. The ``terms`` terms whose presence differs most
    between the labels, for the sample's size, are counted and chosen by Spark; the driver gets them
    and, for each text, which of them it has. The bias is then set for the share of toxic rows among
    all training labels. Without rows of both labels the machine knows no term and gives that share.
    """
    rows = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(3, 1)).select("doc_id", "toxic").distinct()
    shares = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    share = min(1 - 1e-6, max(1e-6, (shares["t"] or 0) / shares["n"])) if shares["n"] else 1e-6
    order = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    chosen = rows.filter("toxic = 1").orderBy(order, "doc_id").limit(most).union(rows.filter("toxic = 0").orderBy(order, "doc_id").limit(2 * most))
    texts = docs.select("doc_id", "text", *row_ids()).filter(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    texts = cut(texts.groupBy("r1", "r2", "toxic").agg(F.first("text").alias("text")))
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if sum(n.values()) > 3 * most:
        texts = texts.filter(F.shiftrightunsigned(F.xxhash64("r1", "r2"), 11) * F.lit(2.0**-53) < 3 * most / sum(n.values()))
        n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(n) < 2:
        machine = Machine(np.zeros(0, np.uint64))
        machine.bias = float(np.log(share / (1 - share)))
        return machine

    def count(batches):
        for batch in batches:
            for low, high, row, term in _terms(batch.column(0)):
                toxic = batch.column(1).slice(low, high - low).to_numpy().astype(bool)[row]
                distinct, place = np.unique(term, return_inverse=True)
                every, hit = np.bincount(place, minlength=len(distinct)), np.bincount(place[toxic], minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(hit), pa.array(every - hit)], names=["term", "c1", "c0"])

    counted = texts.select("text", "toxic").mapInArrow(count, "term long, c1 long, c0 long").groupBy("term").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).filter("c1 + c0 >= 3")
    p = (F.col("c1") + F.col("c0")) / sum(n.values())
    z = F.abs(F.col("c1") / n[1] - F.col("c0") / n[0]) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n[1] + 1 / n[0]))
    best = counted.withColumn("z", z).filter("z > 2.5").orderBy(F.desc("z"), "term").limit(terms).select("term").toArrow()
    known = np.sort(best["term"].to_numpy().view(np.uint64))

    def place(batches):
        for batch in batches:
            for low, high, row, at in _terms(batch.column(0), known):
                ends = np.searchsorted(row, np.arange(high - low + 1)) * 2
                data = at.astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()), batch.column(1).slice(low, high - low)], names=["terms", "toxic"])

    sample = texts.select("text", "toxic").mapInArrow(place, "terms binary, toxic int").limit(3 * most).toArrow()
    found = sorted(zip(sample["toxic"].to_pylist(), sample["terms"].to_pylist()))
    y = np.array([t for t, _ in found], np.float32)
    x = np.zeros((len(y), len(known)), np.uint8)
    for i, (_, at) in enumerate(found):
        x[i, np.frombuffer(at, np.uint16)] = 1
    machine = Machine(known)
    machine.fit(x, y)
    sampled = float(y.mean())
    machine.bias += float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))
    return machine


def score_toxicity(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """r1 and r2 (the row's ids), doc_id, held_out, score, predicted of every row (doc_id, text).

    Null and empty texts have no terms and get the score of the bias. Repeated rows each get their
    row; an empty table gives an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            for low, high, row, at in _terms(batch.column(3), sent.value.known):
                raw = np.clip(sent.value.raw(high - low, row, at.astype(np.int64)), -500, 500)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, high - low) for k in range(3)), pa.array(1 / (1 + np.exp(-raw)))], names=["r1", "r2", "doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select(*row_ids(), "doc_id", "text").mapInArrow(run, f"r1 long, r2 long, doc_id {kind}, score double")
    return scored.select("r1", "r2", "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    bad = score_toxicity(docs, machine, threshold).filter("predicted = 1").select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).distinct()
    return keep_row(docs, *row_ids("__r1", "__r2")).join(bad, ["__r1", "__r2"], "left_anti").select(f"{ROW}.*")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """The digest that the contract of operator 8 names."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, train_toxicity(docs, read(spark, sf_dir, "labels"))).drop("r1", "r2")
