"""Token counts of whole texts, without tokenising most of them and without a shuffle.

The first tier is a compact hash table from frequent pre-tokens to their number of tokens, broadcast
once. A byte-pair vocabulary lists its entries in the order in which merges were found, that is by
frequency, so the table needs no pass over the corpus and its size is bounded by the vocabulary. The
second tier is a bounded cache in each Python worker; pre-tokens in neither are encoded in batches.
Stretches with characters whose classes Unicode versions may see differently, from one blank between
ASCII words to the next, go to the library, and the rest of their text goes through the tiers.
Both tiers change the time only: every count is what the library gives for the text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .words import buffer_of, slices

#: Fixed value: the pre-token pattern of byte-level byte-pair encoding.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: All but characters whose classes all Unicode versions agree on.
UNSURE = r"[^\x09-\x0d\x20-\x7e\u00a0-\u024f\u2010-\u2027\u2030-\u205e\u20ac]"
#: Between a letter and a blank with a letter, no pre-token continues.
SAFE_CUT = r"(?<=[A-Za-z])(?= [A-Za-z])"
CACHED, CACHED_LENGTH, LONG_TEXT = 300_000, 100, 1 << 16


def default_tokenizer() -> str:
    """The path of the 50k byte-level vocabulary of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _load(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for. Fixed rule: printable bytes stand for themselves, others for 256 and up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def frequent_lengths(text: str, most: int = 50_000) -> dict[str, int]:
    """Tokens of the vocabulary's first ``most`` entries that are pre-tokens; ``text`` is the tokenizer's JSON."""
    import regex

    tokenizer, model = _load(text), json.loads(text)["model"]
    byte = byte_letters()
    whole, found = regex.compile(PRE_TOKEN), []
    for entry, _ in sorted(model["vocab"].items(), key=lambda x: x[1])[:most]:
        try:
            word = bytes(byte[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if whole.fullmatch(word) and len(whole.findall(word)) == 1:
            found.append(word)
    return {w: len(e.ids) for w, e in zip(found, tokenizer.encode_batch(found, add_special_tokens=False))}


class Counter:
    """Token counts of texts by both tiers; one for each worker. ``library`` is the number of characters that the library got as text."""

    def __init__(self, text: str, table: dict[str, int]):
        import regex

        self.tokenizer, self.table, self.cache, self.library = _load(text), table, {}, 0
        self.special = [x["content"] for x in json.loads(text).get("added_tokens", [])]
        self.pre_tokens, self.unsure = regex.compile(PRE_TOKEN).findall, regex.compile(UNSURE).search
        self.cut, self.last_cut = regex.compile(SAFE_CUT).search, regex.compile(f"(?r){SAFE_CUT}").search

    def count(self, t: str | None) -> int:
        """Tokens of a text; null has none."""
        if not t:
            return 0
        if any(x in t for x in self.special):
            return self._encoded(t)
        total, found, low = 0, [], 0
        while odd := self.unsure(t, low):
            before, after = self.last_cut(t, low, odd.start()), self.cut(t, odd.end())
            begin, end = before.start() if before else low, after.start() if after else len(t)
            found += self.pre_tokens(t[low:begin])
            total += self._in_pieces(t[begin:end])
            low = end
        return total + self._lengths(found + self.pre_tokens(t[low:]) if low else self.pre_tokens(t))

    def _encoded(self, t: str) -> int:
        self.library += len(t)
        return len(self.tokenizer.encode(t, add_special_tokens=False).ids)

    def _in_pieces(self, t: str) -> int:
        total, low = 0, 0
        while low < len(t):
            at = self.cut(t, low + LONG_TEXT) if len(t) - low > LONG_TEXT else None
            high = at.start() if at else len(t)
            total += self._encoded(t[low:high])
            low = high
        return total

    def _lengths(self, found: list[str]) -> int:
        table, cache, long = self.table, self.cache, {}
        misses = [w for w in set(found) if w not in table and w not in cache]
        if misses:
            got = zip(misses, self.tokenizer.encode_batch_fast(misses, add_special_tokens=False))
            if len(cache) > CACHED:
                cache.clear()
                return self._lengths(found)
            for w, e in got:
                (cache if len(w) <= CACHED_LENGTH else long)[w] = len(e.ids)
        return sum([table.get(w) or cache.get(w) or long[w] for w in found])


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) of every row (doc_id, text).

    The tokenizer is a byte-level .json file of the tokenizers library; the driver reads it and
    broadcasts it. Null text is empty and has 0 of both. Special strings inside a text count as the
    library counts them by default; no begin or end token is added, nothing is truncated. Repeated
    rows each get their row; an empty table gives an empty result.
    """
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        text = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((text, frequent_lengths(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*sent.value)
        for batch in batches:
            column = batch.column(1)
            _, offsets = buffer_of(column)
            for low, high in slices(offsets):
                counts = [counter.count(t) for t in column.slice(low, high - low).to_pylist()]
                n = pa.array(counts, pa.int64())
                sizes = pa.array(offsets[low + 1 : high + 1] - offsets[low:high])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), sizes, n], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """The digest that the contract of operator 3 names."""
    return count_tokens(read(spark, sf_dir, "documents"))
