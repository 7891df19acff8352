"""Language identification by error-correcting output codes.

Every learned language has a codeword of bits. One binary logistic classifier for each bit, over
hashed byte n-grams, predicts that bit; the language whose codeword has the smallest loss, each bit
weighted by how well its classifier did in training, is chosen, and a small margin to the second
best flags ambiguity. A few wrong bits do not change the choice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, read, row_ids
from .words import buffer_of, slices

CELLS = 1 << 12

_LOWER = np.full(256, 32, np.uint8)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)


def _profiles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: its range, one unit vector of n-gram cells a row, whether the row has a letter.

    N-grams are runs of three bytes of the text, A-Z lower-cased and anything else in ASCII as a
    blank; runs of blanks alone count for nothing.
    """
    body, offsets = buffer_of(column)
    for low, high in slices(offsets, rows=512):
        at = offsets[low : high + 1] - offsets[low]
        b = _LOWER[body[offsets[low] : offsets[high]]]
        profile = np.zeros((high - low, CELLS), np.float32)
        letter = np.zeros(high - low, bool)
        if len(b) >= 3:
            wide = b.astype(np.uint32)
            gram = (wide[:-2] * np.uint32(65537) + wide[1:-1] * np.uint32(257) + wide[2:]) * np.uint32(2654435761)
            cell = (gram >> np.uint32(20)).astype(np.int64)
            blank = (b[:-2] == 32) & ((b[1:-1] == 32) | (b[2:] == 32))
            cell[blank] = CELLS
        else:
            cell = np.zeros(0, np.int64)
        found = np.concatenate(([0], np.cumsum((b >= 97) & (b <= 122))))
        letter = found[at[1:]] > found[at[:-1]]
        for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if y - x >= 3:
                profile[i] = np.sqrt(np.bincount(cell[x : y - 2], minlength=CELLS + 1)[:CELLS])
            if not letter[i] and y > x:
                letter[i] = any(c.isalpha() for c in column[low + i].as_py())
        norm = np.sqrt((profile * profile).sum(1, keepdims=True))
        yield low, high, profile / np.maximum(norm, 1e-9), letter


def codewords(languages: int) -> np.ndarray:
    """Codewords of +1 and -1, a row a language: every split of few languages, otherwise spread random ones."""
    if not languages:
        return np.zeros((0, 1), int)
    if languages <= 5:
        bits = max(1, 2 ** (languages - 1) - 1)
        return np.array([[1 if not k or not (b + 1) >> (k - 1) & 1 else -1 for b in range(bits)] for k in range(languages)])
    rng, bits = np.random.default_rng(11), 10 * int(np.ceil(np.log2(languages)))
    tries = [rng.choice([-1, 1], (languages, bits)) for _ in range(50)]
    return max(tries, key=lambda c: np.min(bits - np.abs(c @ c.T) + 2 * bits * np.eye(languages)))


class Codes:
    """Bit classifiers, their weights and the codewords of ``languages``."""

    def __init__(self, languages: list[str]):
        self.languages, self.words = languages, codewords(len(languages))
        self.w, self.b = np.zeros((CELLS, self.words.shape[1]), np.float32), np.zeros(self.words.shape[1], np.float32)
        self.weight = np.ones(self.words.shape[1])

    def fit(self, x: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.5, decay: float = 1e-5) -> None:
        """All bits at once by Adam; classes weigh alike whatever their numbers of rows."""
        y = self.words[label].astype(np.float32)
        share = (1 / np.bincount(label, minlength=len(self.languages))[label] / len(np.unique(label))).astype(np.float32)[:, None]
        m, q = np.zeros_like(self.w), np.zeros_like(self.w)
        for step in range(1, steps + 1):
            g = -y / (1 + np.exp(np.clip(y * (x @ self.w + self.b), -30, 30))) * share
            grad = x.T @ g + decay * self.w
            m = 0.9 * m + 0.1 * grad
            q = 0.999 * q + 0.001 * grad * grad
            self.w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-6)
            self.b -= rate * g.sum(0)
        right = ((y * (x @ self.w + self.b)) > 0).astype(np.float64)
        error = np.clip(((1 - right) * share).sum(0), 1e-3, 0.499)
        self.weight = np.log((1 - error) / error)
        self.weight /= self.weight.sum()

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability among the languages, and the margin to the second."""
        f = x @ self.w + self.b
        loss = np.stack([(np.logaddexp(0, -f * c) * self.weight).sum(1) for c in self.words], 1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        ordered = np.sort(p, 1)
        margin = ordered[:, -1] - (ordered[:, -2] if p.shape[1] > 1 else 0)
        return best, p[np.arange(len(p)), best], margin


def train_language(docs: DataFrame, each: int = 500, longest: int = 50_000, most: int = 4000, floor: int = 8) -> Codes:
    """The codes learned from about ``each`` texts a language, about ``most`` in all, but ``floor`` a language at least.

    The sample is bounded: of each language the rows whose hash of doc_id and text falls below the
    share that gives ``each`` different rows, among training rows (crc32 of doc_id modulo 4 is not 2)
    with a lang and a text of 20 to ``longest`` characters; repeated rows count once. Shares come from
    counts that combine on the map side, so that no task sorts a language. With more languages than
    most / each, each has fewer rows. Every language with a training row is learned: the row of its
    smallest hash is always in the sample, which grows with the number of languages alone.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.length("text").between(20, longest)).filter(~held_out(4, 2))
    rows = known.select("lang", "text", *row_ids())
    place = F.shiftrightunsigned(F.xxhash64("r1", "r2", F.lit("language")), 11) * F.lit(2.0**-53)
    counted = rows.withColumn("place", place).groupBy("lang").agg(F.approx_count_distinct("r1", 0.02).alias("d"), F.min("place").alias("first")).collect()
    codes = Codes(sorted(r["lang"] for r in counted))
    if len(counted) < 2:
        return codes
    each = max(min(floor, each), min(each, most // len(counted)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], max(each / max(1, r["d"]), r["first"]), r["first"]) for r in counted], "lang string, share double, first double")
    near = rows.join(F.broadcast(shares), "lang").withColumn("place", place).filter("place <= share")
    chosen = near.withColumn("place", F.when(F.col("place") == F.col("first"), -1.0).otherwise(F.col("place") / F.col("share")))
    texts = chosen.groupBy("lang", "r1", "r2").agg(F.first("text").alias("text"), F.first("place").alias("place")).select("text", "lang", "place")

    def run(batches):
        for batch in batches:
            for low, high, profile, _ in _profiles(batch.column(0)):
                # a byte a cell is enough for fitting: values of a unit vector in steps of 1/255
                small = np.rint(profile * 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in small], pa.binary()), *(batch.column(k).slice(low, high - low) for k in (1, 2))], names=["profile", "label", "place"])

    number = {lang: i for i, lang in enumerate(codes.languages)}
    sample = texts.mapInArrow(run, "profile binary, label string, place double").orderBy("place").limit(max(most, floor * len(counted))).toArrow()
    found = sorted((number[k], p) for k, p in zip(sample["label"].to_pylist(), sample["profile"].to_pylist()))
    x = np.frombuffer(b"".join(p for _, p in found), np.uint8).reshape(len(found), CELLS).astype(np.float32) / 255
    codes.fit(x, np.array([k for k, _ in found]))
    return codes


def identify_language(docs: DataFrame, codes: Codes, ambiguous_below: float = 0.2) -> DataFrame:
    """r1 and r2 (the row's ids), doc_id, held_out, lang_pred, score, ambiguous of every row (doc_id, text).

    Null texts and texts without a letter are 'und' with score 0. A letter alone is enough for a
    guess, which is then ambiguous as a rule. With one learned language all texts with a letter get
    it; with none, all are 'und'. Repeated rows each get their row; an empty table gives an empty
    result. Whole texts are read, columns other than doc_id and text are not.
    """
    sent = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        names = sent.value.languages
        for batch in batches:
            for low, high, profile, letter in _profiles(batch.column(3)):
                n = high - low
                if names:
                    best, score, margin = sent.value.decode(profile)
                else:
                    best, score, margin, letter = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, bool)
                langs = [names[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(low, n) for k in range(3)), pa.array(langs, pa.string()), pa.array(np.where(letter, score, 0.0).astype(np.float64)), pa.array(~letter | (margin < ambiguous_below))],
                    names=["r1", "r2", "doc_id", "lang_pred", "score", "ambiguous"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select(*row_ids(), "doc_id", "text").mapInArrow(run, f"r1 long, r2 long, doc_id {kind}, lang_pred string, score double, ambiguous boolean")
    return found.select("r1", "r2", "doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_language(spark, sf_dir: str) -> DataFrame:
    """The digest that the contract of operator 6 names."""
    docs = read(spark, sf_dir, "documents")
    return identify_language(docs.select("doc_id", "text"), train_language(docs)).drop("r1", "r2")
