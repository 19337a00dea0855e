"""BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no vocabulary token can never be spanned by one, so a word is certainly cut between
them. Words (the tokenizer file's own pre-tokens) are split at such pairs, the fragments are encoded independently, each
by the merge ranks, and the ids are concatenated. Fragments and words that come again are remembered in bounded tables.

Token ids are kept packed: little-endian unsigned 32-bit integers in one binary value for each text.

Cases: null text is empty and has no ids; the tokenizer's special strings in a text are their own ids, as in the
tokenizers library with add_special_tokens=False; other columns of the input pass through unread.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batched, pieces, release

#: Words remembered in a Python worker before it begins anew; characters of text taken at once.
REMEMBER, BLOCK = 50_000, 1 << 17
#: Ids decoded at once.
IDS = 1 << 15
#: Bytes of input in a batch of results.
SLICE = 1 << 18
#: Fragments beyond so many bytes are merged one by one.
LONG = 48
TABLE_BITS, NONE = 19, 1 << 30

# The white space, contractions and byte-to-character table of the tokenizer files.
_SPACE = "\t-\r \x85\xa0  -     　"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_WORDS = regex.compile(rf"{_SHORT}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_ASCII_WORDS = re.compile(rf"{_SHORT}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHARACTER = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}


class Tokenizer:
    """A tokenizer file with word ends (lower-casing, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.suffix = said["model"]["end_of_word_suffix"] or ""
        ids: dict[str, int] = said["model"]["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in said["model"]["merges"]]
        self.merges = np.array([(ids[a], ids[b]) for a, b in pairs], np.int64).reshape(-1, 2)
        self.made = np.array([ids[a + b] for a, b in pairs] or [0], np.int32)
        self.tables = self._tables(self.merges)
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.token = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte = {c: b for b, c in _CHARACTER.items()}
        self.inside = np.zeros((256, 256), bool)
        for token in ids:
            own = [byte[c] for c in token.removesuffix(self.suffix)]
            self.inside[own[:-1], own[1:]] = True
        self.first = np.array([ids[_CHARACTER[b]] for b in range(256)], np.int32)
        self.final = np.array([ids[_CHARACTER[b] + self.suffix] for b in range(256)], np.int32)
        #: remembered words and the special strings, with their packed ids
        self.fixed = {x: np.array([i], "<u4").tobytes() for x, i in self.special.items()}
        self.words = dict(self.fixed)

    def forget(self) -> None:
        """Drop the remembered words: an idle worker keeps the vocabulary only."""
        self.words = dict(self.fixed)
        release()

    @functools.cached_property
    def ranks(self) -> dict[tuple[int, int], int]:
        """The ranks by pair, for long fragments only."""
        return {(a, b): rank for rank, (a, b) in enumerate(self.merges.tolist())}

    @staticmethod
    def _slots(keys: np.ndarray, turn: int) -> np.ndarray:
        odd = (0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * turn) % (1 << 64)
        return (keys.astype(np.uint64) * np.uint64(odd) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _tables(self, pairs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hash tables of pair keys and ranks; a key that finds its slot taken goes to the next table."""
        keys, ranks, out = pairs[:, 0] << 20 | pairs[:, 1], np.arange(len(pairs)), []
        while len(keys):
            own, rank = np.full(1 << TABLE_BITS, -1, np.int64), np.full(1 << TABLE_BITS, NONE, np.int32)
            slots, at = np.unique(self._slots(keys, len(out)), return_index=True)
            own[slots], rank[slots] = keys[at], ranks[at]
            out.append((own, rank))
            keys, ranks = np.delete(keys, at), np.delete(ranks, at)
        return out

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; NONE where there is no merge or an id is -1."""
        keys = left.astype(np.int64) << 20 | right
        out = np.full(keys.shape, NONE, np.int32)
        for turn, (own, rank) in enumerate(self.tables):
            slots = self._slots(keys, turn)
            out = np.where(own[slots] == keys, rank[slots], out)
        return np.where((left < 0) | (right < 0), NONE, out)

    def merge_equal(self, rows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of fragments of one length (bytes, one fragment a row), padded with -1, and how many each has. All rows take their next merge together: the lowest rank, leftmost."""
        ids = self.first[rows]
        ids[ends, -1] = self.final[rows[ends, -1]]
        done, n = np.full(ids.shape, -1, np.int32), np.full(len(ids), ids.shape[1])
        if ids.shape[1] == 1:
            return ids, n
        ranks, at, column = self.rank(ids[:, :-1], ids[:, 1:]), np.arange(len(ids)), np.arange(ids.shape[1])
        while len(at):
            p = ranks.argmin(1)
            low = ranks[np.arange(len(at)), p]
            on = low < NONE
            if not on.all():
                done[at[~on], : ids.shape[1]] = ids[~on]
                ids, ranks, at, p, low = ids[on], ranks[on], at[on], p[on], low[on]
                if not len(at):
                    break
            n[at] -= 1
            i = np.arange(len(at))
            ids[i, p] = self.made[low]
            pad = np.full((len(at), 1), -1, np.int32)
            ids = np.where(column[: ids.shape[1]] > p[:, None], np.hstack((ids[:, 1:], pad)), ids)
            ranks = np.where(column[: ranks.shape[1]] > p[:, None], np.hstack((ranks[:, 1:], pad + NONE + 1)), ranks)
            after = np.where(p + 1 < ids.shape[1], ids[i, np.minimum(p + 1, ids.shape[1] - 1)], -1)
            ranks[i, np.minimum(p, ranks.shape[1] - 1)] = np.where(p < ranks.shape[1], self.rank(ids[i, p], after), ranks[i, -1])
            left = p > 0
            ranks[i[left], p[left] - 1] = self.rank(ids[i[left], p[left] - 1], ids[i[left], p[left]])
        return done, n

    def merge_long(self, fragment: np.ndarray, ends: bool) -> list[int]:
        """The same for a long fragment, by a queue of pairs over a linked list: n log n steps."""
        ids: list = self.first[fragment].tolist()
        if ends:
            ids[-1] = int(self.final[fragment[-1]])
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        ranks = self.ranks
        queue = [(ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        heapq.heapify(queue)
        while queue:
            rank, i, pair = heapq.heappop(queue)
            j = after[i] if ids[i] is not None else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = int(self.made[rank]), None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in ranks:
                    heapq.heappush(queue, (ranks[p], a, p))
        return [x for x in ids if x is not None]

    def fragments(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The starts of the fragments of words that lie end to end in data: at each word, and between bytes that no token holds together."""
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.inside[data[:-1], data[1:]]
        cut[np.r_[0, ends[:-1]]] = True
        return np.flatnonzero(cut)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The packed ids of words (none empty)."""
        raw = [w.encode() for w in words]
        data, word_end = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
        start = self.fragments(data, word_end)
        length = np.diff(np.r_[start, len(data)])
        ends = np.zeros(len(data) + 1, bool)
        ends[word_end] = True
        ends = ends[start + length]
        count, parts = np.zeros(len(start), np.int64), []
        for size in np.unique(length):
            for rows in np.array_split(own := np.flatnonzero(length == size), len(own) // 8192 + 1):
                if size > LONG:
                    ids = [self.merge_long(data[start[r] : start[r] + size], bool(ends[r])) for r in rows]
                    count[rows] = [len(x) for x in ids]
                    flat = np.array([x for y in ids for x in y], np.int32)
                else:
                    ids, count[rows] = self.merge_equal(data[start[rows, None] + np.arange(size)], ends[rows])
                    flat = ids[np.arange(size) < count[rows, None]]
                parts.append((rows, flat))
        to = np.r_[0, np.cumsum(count)]
        out = np.empty(to[-1], "<u4")
        for rows, flat in parts:
            n = count[rows]
            out[np.repeat(to[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(flat))] = flat
        edges = 4 * to[np.searchsorted(start, np.r_[0, word_end])]
        packed = out.tobytes()
        return [packed[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    @staticmethod
    def split(text: str) -> list[str]:
        """The pre-tokens of text without special strings."""
        if text.isascii():
            return _ASCII_WORDS.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # a sigma at a word's end is lower-cased as any other
        return _WORDS.findall("σ".join(x.lower() for x in text.split("Σ")))

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """text in parts that are encoded apart, and whether a part is a special string. Long texts are also parted at spaces, which no word crosses."""
        whole = self.special_re.split(text) if self.special_re and "<|" in text else [text]
        for i, part in enumerate(whole):
            at = 0
            while not i % 2 and len(part) - at > BLOCK and (to := part.find(" ", at + BLOCK)) >= 0:
                yield part[at:to], False
                at = to
            yield part[at:], bool(i % 2)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of texts, a block of text at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def close():
            known = self.words
            if len(known) > REMEMBER:
                known.clear()
                known.update(self.fixed)
            new = list({w for _, found in held for w in found if w not in known})
            if new:
                known.update(zip(new, self.encode_words(new), strict=True))
            for k, found in held:
                out[k].append(b"".join([known[w] for w in found]))
            held.clear()

        for k, text in enumerate(texts):
            for part, special in self.parts(text):
                if special:
                    held.append((k, [part]))
                else:
                    held.append((k, self.split(part)))
                size += len(part)
                if size > BLOCK:
                    close()
                    size = 0
        close()
        return [b"".join(x) for x in out]

    def decode(self, packed: bytes) -> str:
        """Tokens joined by a space, as a tokenizer file without a decoder says."""
        ids = np.frombuffer(packed, "<u4")
        return " ".join(" ".join(map(self.token.__getitem__, ids[i : i + IDS].tolist())) for i in range(0, len(ids), IDS))


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, once for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def _map(docs: DataFrame, path: str, column: Column, made: dict[str, T.DataType], work: Callable[[Tokenizer, list], list[list]]) -> DataFrame:
    """docs with the columns made, from column by work, a bounded slice of rows at a time; all else passes through."""
    source = docs.drop(*made).withColumn("_tl_in", column)
    at = len(source.columns) - 1
    schema = T.StructType([*source.schema.fields[:at], *(T.StructField(n, t) for n, t in made.items())])
    kinds = [pa.binary() if isinstance(t, T.BinaryType) else pa.string() for t in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            values = batch.column(at)
            edges = np.r_[0, np.cumsum(np.maximum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), 64))]
            for a, b in pieces(edges, SLICE):
                out = work(own, values.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:at], *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], schema.names)
        own.forget()

    return batched(source).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", to: str = "token_ids") -> DataFrame:
    """docs with the packed ids of text_col."""
    return _map(docs, path, F.coalesce(F.col(text_col).cast("string"), F.lit("")), {to: T.BinaryType()}, lambda own, texts: [own.encode_all(texts)])


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """encoded with the text that ids_col decodes to; null ids are none."""
    return _map(encoded, path, F.coalesce(ids_col, F.lit(b"")), {to: T.StringType()}, lambda own, ids: [[own.decode(x) for x in ids]])


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", to: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """encode() and then decode() of its ids, in one pass over the rows and by one Python worker."""

    def work(own: Tokenizer, texts: list) -> list[list]:
        ids = own.encode_all(texts)
        return [ids, [own.decode(x) for x in ids]]

    return _map(docs, path, F.coalesce(F.col(text_col).cast("string"), F.lit("")), {to: T.BinaryType(), decoded: T.StringType()}, work)
