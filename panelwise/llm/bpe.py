"""Byte-pair encoding by forced boundaries, and decoding.

A pair of bytes that stands inside no entry of the vocabulary is never joined, so that every place
with such a pair is a certain cut, and what lies between two cuts can be encoded on its own. In a
vocabulary that was learned inside words nearly every border of a word is one. A table of 65,536
flags finds the cuts of all texts of a batch in one numpy step; the fragments go through a bounded
cache, and what it lacks is divided by the pre-token pattern, cut again at forced places inside
pre-tokens, and joined by the ranked merges. The ids of a text are its fragments' ids in order.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .tokens import PRE_TOKEN, UNSURE, _load, byte_letters, default_tokenizer
from .words import buffer_of, slices

#: The last UTF-8 byte of each white space character of Unicode, past and present.
WHITE_LAST = bytes([*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
#: The endings that the pre-token pattern takes together with their apostrophe.
CONTRACTIONS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")
CACHED, CACHED_BYTES, SHORT = 300_000, 64, 40
_NONE, _LOW = 1 << 62, (1 << 31) - 1


class Vocabulary:
    """Merges, bytes of the entries and tables of certain cuts of a byte-level tokenizer in the tokenizers library's JSON.

    ``never[256 * a + b]`` says that no entry holds the byte b after the byte a. ``safe`` are those
    pairs between whole characters at which the pre-token pattern, too, gives both sides what it
    gives the whole: not after white space, whose last character may go with what follows, and
    before an apostrophe only after a letter or digit, as after a sign it begins no ending.
    """

    def __init__(self, text: str):
        whole = json.loads(text)
        model, split = whole["model"], whole.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or whole.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in whole.get("added_tokens", [])):
            raise ValueError("not a plain byte-level byte-pair tokenizer")
        self.text, letter = text, byte_letters()
        as_bytes = lambda entry: bytes(letter[c] for c in entry)
        vocab = model["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in whole.get("added_tokens", [])}
        self.entries = [b""] * (1 + max([*vocab.values(), *self.special.values()], default=-1))
        never = np.ones(1 << 16, bool)
        for entry, i in vocab.items():
            b = self.entries[i] = as_bytes(entry)
            for x, y in zip(b, b[1:]):
                never[x << 8 | y] = False
        for b, i in self.special.items():
            self.entries[i] = b
        self.of_byte = [vocab.get(c, -1) for c, _ in sorted(letter.items(), key=lambda x: x[1])]
        if min(self.of_byte) < 0:
            raise ValueError("the vocabulary lacks a byte")
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 31 | vocab[b], rank << 31 | vocab[a + b])
        self.never = never.tobytes()
        left, right = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
        word = np.isin(left, np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
        safe = never & (right & 0xC0 != 0x80) & ~np.isin(left, np.frombuffer(WHITE_LAST, np.uint8)) & ((right != 0x27) | word)
        for x in CONTRACTIONS:
            for a, b in zip(x, x[1:]):
                safe[a << 8 | b] = False
        self.safe = safe


class Encoder:
    """Encodes texts with a ``Vocabulary``; one for each worker. ``fragments`` and ``missed`` count what it looked up and what its cache lacked."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v, self.library = vocabulary, _load(vocabulary.text).pre_tokenizer
        self.pre_tokens, self.unsure, self.letter = regex.compile(PRE_TOKEN).findall, regex.compile(UNSURE).search, byte_letters()
        self.specials = re.compile(b"|".join(re.escape(x) for x in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None
        # ids as bytes, which the garbage collector need not visit; what falls out of the younger part is still in the older one
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.fragments = self.missed = 0

    def cuts(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Where fragments begin, in order, and the id of each that is a special string, by its place. Every text that is not empty begins one."""
        begins = np.zeros(len(body) + 1, bool)
        if len(body):
            begins[1:-1] = self.v.safe[body[:-1].astype(np.uint16) << np.uint16(8) | body[1:]]
        data, found = body.tobytes(), {}
        if self.specials is not None and any(x in data for x in self.v.special):
            for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                for m in self.specials.finditer(data, low, high):
                    found[m.start()] = self.v.special[m.group()]
                    begins[m.start() : m.end()] = False
                    begins[[m.start(), m.end()]] = True
        begins[offsets] = True
        return np.flatnonzero(begins[:-1]), found

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (one more than texts)."""
        at, special = self.cuts(body, offsets)
        data, places = body.tobytes(), at.tolist()
        pieces = [data[a:b] for a, b in zip(places, [*places[1:], len(body)])]
        cache, old = self.cache, self.old
        misses = set(pieces).difference(cache)
        self.fragments, self.missed = self.fragments + len(pieces), self.missed + len(misses)
        for piece in misses:
            cache[piece] = old.get(piece) or np.array(self.fragment(piece), np.int32).tobytes()
        got = [cache[p] for p in pieces]
        if special:
            for k, place in enumerate(places):
                if place in special:
                    got[k] = np.array([special[place]], np.int32).tobytes()
        sums = np.concatenate(([0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got))))) // 4
        for piece in misses:
            if len(piece) > CACHED_BYTES:
                del cache[piece]
        if len(cache) > CACHED:
            self.cache, self.old = {}, cache
        return np.frombuffer(b"".join(got), np.int32), sums[np.searchsorted(at, offsets)]

    def fragment(self, piece: bytes) -> list[int]:
        """Ids of a fragment: of its pre-tokens, cut at their forced places. The library divides what Unicode versions may see differently."""
        text = piece.decode()
        if self.unsure(text):
            parts = [bytes(self.letter[c] for c in part) for part, _ in self.library.pre_tokenize_str(text)]
        else:
            parts = [p.encode() for p in self.pre_tokens(text)]
        return [i for part in parts for i in self._pre_token(part)]

    def _pre_token(self, part: bytes) -> list[int]:
        never, low, ids = self.v.never, 0, []
        for k in range(1, len(part)):
            if never[part[k - 1] << 8 | part[k]]:
                ids += self._joined([self.v.of_byte[b] for b in part[low:k]])
                low = k
        return ids + self._joined([self.v.of_byte[b] for b in part[low:]])

    def _joined(self, ids: list[int]) -> list[int]:
        """The merges of least rank, leftmost first, until none is left."""
        if len(ids) > SHORT:
            return self._joined_long(ids)
        rank = self.v.merges.get
        ranks = [rank(a << 31 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NONE:
            at, new = ranks.index(best), best & _LOW
            ids[at] = new
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 31 | new, _NONE)
            if at < len(ranks):
                ranks[at] = rank(new << 31 | ids[at + 1], _NONE)
        return ids

    def _joined_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, n log n steps."""
        n, rank = len(ids), self.v.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank(ids[k] << 31 | ids[k + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if ids[k] < 0 or (second := after[k]) >= n or rank(ids[k] << 31 | ids[second], _NONE) != r:
                continue
            ids[k], ids[second], after[k] = r & _LOW, -1, after[second]
            if after[k] < n:
                before[after[k]] = k
                if (r := rank(ids[k] << 31 | ids[after[k]], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, k))
            if (p := before[k]) >= 0 and (r := rank(ids[p] << 31 | ids[k], _NONE)) != _NONE:
                heapq.heappush(heap, (r, p))
        return [i for i in ids if i >= 0]


def _vocabulary(tokenizer_path: str | None) -> Vocabulary:
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        return Vocabulary(f.read())


def encode_texts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of the whole text of every row of ``docs`` (doc_id, text), as the tokenizers library gives them without its own begin and end tokens.

    The tokenizer is a byte-level .json file that the driver reads and broadcasts; its size does not
    depend on the texts. Special strings inside a text become their one id, as is the library's
    default. Null and empty texts have no ids; repeated rows each get their row; an empty table gives
    an empty result; other columns of ``docs``, whatever their names, are left out. A worker holds
    one slice of texts (or one longer text) and a bounded cache. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_vocabulary(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            body, offsets = buffer_of(batch.column(1))
            for low, high in slices(offsets):
                at = offsets[low : high + 1]
                ids, first = encoder.encode(body[at[0] : at[-1]], at - at[0])
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``text``, what the library's decoder gives with special tokens left in.

    Ids that the vocabulary lacks add nothing; bytes that are no UTF-8 become U+FFFD. Null ids
    decode to the empty text.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(_vocabulary(tokenizer_path).entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sent.value
        size = np.array([len(e) for e in entries] + [0], np.int64)
        begin, whole = np.cumsum(size) - size, np.frombuffer(b"".join(entries), np.uint8)
        for batch in batches:
            column = batch.column(1)
            for k in range(0, len(column), 256):
                part = column.slice(k, 256)
                counts = np.asarray(pc.fill_null(pc.list_value_length(part), 0), np.int64)
                ids = np.asarray(part.flatten(), np.int64)
                ids = np.where((ids >= 0) & (ids < len(entries)), ids, len(entries))
                sizes = size[ids]
                ends = np.cumsum(sizes)
                data = whole[np.repeat(begin[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
                at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256), part, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    """The digest that the contract of operator 13 names."""
    decoded = decode_ids(encode_texts(read(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
