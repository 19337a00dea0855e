"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint is cut into segments of 22, 21 and 21 bits. Every 23-bit word lies within 3 bits of one word of the
perfect Golay code, and within 4 bits of one or six of them; two words that differ in at most 2 bits have one of those
in common, the one nearest to a word between them. So the codewords within 4 bits of a segment, told by their 12 bits of information, are
keys which segments with up to two errors share. By the pigeonhole principle the errors of two fingerprints that
differ in 3 bits at most leave a segment with at most 2 errors, and one of three blocks of 14 bits beside it without
any: with errors (1, 1, 1) or (2, 1, 0) a segment that has errors leaves at most 2 for the three blocks; with (3, 0, 0)
the other clean segment holds a whole block. A cell is such a segment's codeword and such a block. (Beyond
FINE distinct fingerprints four shorter blocks are cut, of which two are without errors: narrower cells, the same pairs.)

Cells are met in sorted runs, and only verified links leave the task. A cell of more than CELL fingerprints emits no
pairs: its fingerprints are joined by balls instead. Two words differ in at most 3 bits if and only if some word lies
within 1 bit of the one and 2 bits of the other, so each of them writes its 65 near words and 2,081 words around, and
everything that meets at a word is linked to one fingerprint next to it; no group there is larger than the ball.

Cases: null text counts as empty; a text without words has fingerprint zero and is linked like any other; rows that
share doc_id are rows of their own, a null doc_id never names a component unless all its documents have none; an empty
table gives an empty result; texts of any length are read whole, in pieces; only the two named columns are read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batched, discard, materialize, release, small
from .components import components

SHINGLE, SEED, ERRORS = 3, 42, 3
#: Bits of the segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Fingerprints of a cell that are compared with each other; larger cells go by balls.
CELL = 256
#: Distinct fingerprints beyond which cells are made of two of four blocks.
FINE = 16_000_000
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

#: The generator polynomial of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GENERATOR = 0b110001110101

# ------------------------------------------------------------------ fingerprints

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    at = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
    seen = np.bincount(at.ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BITS).ravel()


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of all runs of size words."""
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[: len(words) - size] + 1]
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes) -> int:
    """The SimHash of a text in UTF-8, as an unsigned whole number: majority of the XXH64 of its shingles."""
    ones, n, words, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.end() if cut else len(text)
        words += text[at:end].lower().split()  # of bytes: A-Z only; a space and \\t to \\r
        at = end
        if len(words) >= SHINGLE:
            hashes = _hashes(words, SHINGLE)
            ones, n, words = ones + _bit_counts(hashes), n + len(hashes), words[1 - SHINGLE :]
    if not n and words:
        ones, n = _bit_counts(_hashes(words, len(words))), 1
    return int(np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp: the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return batched(rows).mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------ the Golay code


def _rest(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator: 0 for codewords."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


def _patterns() -> np.ndarray:
    """By remainder, the error patterns of at most 4 bits that leave it: one or six, the rest -1."""
    out, used = np.full((1 << 11, 6), -1, np.int64), np.zeros(1 << 11, np.int64)
    for weight in range(5):
        masks = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(23), weight)], np.int64)
        for rest, mask in zip(_rest(masks).tolist(), masks.tolist(), strict=True):
            out[rest, used[rest]] = mask
            used[rest] += 1
    return out


_TABLES: list[np.ndarray] = []


def codewords(words: np.ndarray) -> np.ndarray:
    """The information bits of the codewords within 4 bits of each word, in six columns; -1 where there is none."""
    if not _TABLES:
        parts = [_rest(np.arange(n, dtype=np.int64) << s) for n, s in ((1 << 12, 0), (1 << 11, 12))]
        _TABLES.extend([*parts, _patterns()])
    low, high, patterns = _TABLES
    errors = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def cells(fps: np.ndarray, blocks: int = 3) -> np.ndarray:
    """The cells of each fingerprint (uint64), -1 where a column is not used. blocks: 3 or 4 beside each segment, all but two of them exact."""
    starts = np.cumsum((0, *SEGMENTS))
    parts = [((fps >> np.uint64(starts[i])) & np.uint64((1 << SEGMENTS[i]) - 1)).astype(np.int64) for i in range(3)]
    out = []
    for i in range(3):
        words = codewords(parts[i])
        j, k = (x for x in range(3) if x != i)
        beside, width = parts[j] | parts[k] << SEGMENTS[j], SEGMENTS[j] + SEGMENTS[k]
        # with 4 blocks two lie in either segment; with 3 the first and the last do
        edges = [0, SEGMENTS[j] // 2, SEGMENTS[j], SEGMENTS[j] + SEGMENTS[k] // 2, width] if blocks == 4 else [0, width // 3, width - width // 3, width]
        for no, exact in enumerate(itertools.combinations(range(blocks), blocks - 2)):
            bits = np.zeros(len(fps), np.int64)
            for b in exact:
                bits = bits << (edges[b + 1] - edges[b]) | beside >> edges[b] & ((1 << (edges[b + 1] - edges[b])) - 1)
            key = (i << 3 | no) << 24 | bits
            out.append(np.where(words >= 0, key[:, None] << 12 | words, -1))
    return np.concatenate(out, 1)


# ------------------------------------------------------------------ links

LINKS = "u long, v long, crowded boolean"


def _keyed(fps: DataFrame, blocks: int, most: int) -> DataFrame:
    """(cell, fp) of distinct fingerprints; of a cell that has more than most of a batch, so many go on and the others are told as crowded, by a null cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            keys = cells(own.view(np.uint64), blocks)
            cell, fp = keys.ravel(), np.repeat(own, keys.shape[1])
            cell, fp = cell[cell >= 0], fp[cell >= 0]
            order = np.argsort(cell, kind="stable")
            cell, fp = cell[order], fp[order]
            edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
            rank = np.arange(len(cell)) - np.repeat(edge, np.diff(np.r_[edge, len(cell)]))
            extra = rank > most
            told = np.unique(fp[extra])
            cell, fp = cell[~extra], fp[~extra]
            for a in range(0, len(cell), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + (1 << 17)]), pa.array(fp[a : a + (1 << 17)])], names=["cell", "fp"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(told), pa.int64()), pa.array(told)], names=["cell", "fp"])
        release()

    return batched(fps.select("fp")).mapInArrow(run, "cell long, fp long")


def _near(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.bitwise_count((u ^ v).view(np.uint64)) <= ERRORS


def _linked(keyed: DataFrame, most: int) -> DataFrame:
    """Verified links within cells, and (fp, fp, true) for each fingerprint of a cell with more than most."""

    def out(u, v, crowded):
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), crowded))], names=["u", "v", "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a task lie sorted by cell; of those before, as many as a full cell and one are kept
        cell, fp, old = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            told = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if told.any():
                yield out(*[batch.column(1).to_numpy()[told]] * 2, True)
            cell, fp = np.r_[cell, batch.column(0).drop_null().to_numpy()], np.r_[fp, batch.column(1).to_numpy()[~told]]
            full = np.flatnonzero(cell[most:] == cell[: len(cell) - most]) if len(cell) > most else np.zeros(0, np.int64)
            crowded = np.zeros(len(cell) + 1, np.int64)
            np.add.at(crowded, full, 1)
            np.add.at(crowded, full + most + 1, -1)
            crowded = np.cumsum(crowded)[:-1] > 0
            if crowded.any():
                yield out(*[np.unique(fp[crowded])] * 2, True)
            for apart in range(1, most):
                left = np.arange(max(0, old - apart), len(cell) - apart)
                left = left[cell[left] == cell[left + apart]]
                if not len(left):
                    break
                left = left[_near(fp[left], fp[left + apart])]
                yield out(fp[left], fp[left + apart], False)
            cell, fp = cell[-most:], fp[-most:]
            old = len(cell)
        release()

    return keyed.mapInArrow(run, LINKS)


_FLIPS = [sum(1 << b for b in bits) for weight in range(3) for bits in itertools.combinations(range(64), weight)]


def _ball_links(fps: DataFrame) -> DataFrame:
    """Links that connect all fingerprints which differ in at most ERRORS bits, in work proportional to their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array(_FLIPS, np.uint64).view(np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy()
            for a in range(0, len(own), 64):
                some = own[a : a + 64]
                at = (some[:, None] ^ flips).ravel()
                next_to = np.tile(np.arange(len(flips)) <= 64, len(some))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(some, len(flips))), pa.array(next_to)], names=["at", "fp", "next"])
        release()

    balls = fps.select("fp").mapInArrow(run, "at long, fp long, next boolean")
    met = balls.groupBy("at").agg(F.min(F.when(F.col("next"), F.col("fp"))).alias("u"), F.collect_set("fp").alias("around"))
    met = met.where(F.col("u").isNotNull() & (F.size("around") > 1))
    return met.select("u", F.explode("around").alias("v")).where("u <> v").distinct()


def links(fps: DataFrame, most: int = CELL) -> DataFrame:
    """fps (fp: distinct, a materialised table) as links (u, v) that connect all that differ in at most ERRORS bits."""
    blocks = 3 if fps.count() <= FINE else 4
    spread = F.coalesce(F.col("cell"), F.col("fp"))
    keyed = _keyed(fps, blocks, most).repartition(spread).sortWithinPartitions("cell", "fp")
    met = materialize(_linked(keyed, most), "met")
    crowded = materialize(met.where("crowded").select(F.col("u").alias("fp")).distinct(), "crowded")
    pairs = met.where("NOT crowded").select("u", "v")
    if not crowded.isEmpty():
        pairs = pairs.unionAll(_ball_links(crowded))
    out = materialize(pairs.distinct(), "pairs")
    discard(met, crowded)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the least doc_id that links lead to."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fps")
    pairs = links(fps)
    # a fingerprint alone needs no join; the others take the least doc_id of their component
    rooted = fps.join(components(pairs), fps["fp"] == F.col("node"), "left").where("n > 1 OR root IS NOT NULL")
    rooted = materialize(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    lows = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "lows")
    classes = small(materialize(rooted.join(small(lows), "root").select("fp", F.lit(True).alias("shared"), "component_id"), "classes"))
    discard(pairs, fps, rooted, lows)
    said = prints.join(classes, "fp", "left")
    return said.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
