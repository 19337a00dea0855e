"""Exact deduplication with counting quotient filters.

Each scan partition builds a counting quotient filter over 64-bit text fingerprints, cut into ranges of the
fingerprint space. The filters of a range meet in one group, which holds one entry for a fingerprint and partition
(a text with a third of all rows is one entry for each partition), and merge losslessly by their sorted remainders.
Fingerprints with a count above one go to byte verification: their rows are grouped by the text itself.

Cases: null text counts as empty; rows that share doc_id and text count as copies and stay together, unless one row
is asked for; a null doc_id is kept only if its whole group has none; an empty table gives an empty result; only the
two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batched, materialize, release, small

#: Fingerprints of all rows that fall into one range, which one task merges: the ranges follow from the number of rows.
RANGE_ROWS = 500_000
#: The most fingerprints a partition gathers before it writes its filter and begins another.
FLUSH = 1_000_000


def quotient_bits(range_bits: int) -> int:
    """Quotient bits within a range; what remains of the 64 bits is the stored remainder. The finer the ranges, the fewer: a block's bit map stays small beside its entries."""
    return max(3, min(10, 20 - range_bits))


def range_bits(n: int) -> int:
    """So many leading bits that a range has about RANGE_ROWS of n fingerprints, and 16 ranges at least."""
    return max(4, min(40, (-(-n // RANGE_ROWS) - 1).bit_length()))


def build_filter(fingerprints: np.ndarray, bits: int) -> dict[int, bytes]:
    """Counting quotient filters of uint64 fingerprints by range (their first bits): occupied bits by quotient, run-end bits by slot, then sorted remainders and their counts."""
    slots, counts = np.unique(fingerprints, return_counts=True)
    rest, q = 64 - bits, quotient_bits(bits)
    ranges = (slots >> np.uint64(rest)).astype(np.int64) if bits else np.zeros(len(slots), np.int64)
    edges = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(slots) else np.zeros(0, np.int64)
    shift = np.uint64(rest - q)
    out = {}
    for a, b in zip(edges, np.r_[edges[1:], len(slots)], strict=True):
        part = slots[a:b] & np.uint64((1 << rest) - 1)
        quotients = (part >> shift).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        run_end = np.r_[quotients[1:] != quotients[:-1], True]
        remainders = part & np.uint64((1 << int(shift)) - 1)
        out[int(ranges[a])] = b"".join((np.int64(b - a).tobytes(), np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(), remainders.tobytes(), counts[a:b].astype(np.int64).tobytes()))
    return out


def read_filter(block: bytes, at_range: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    n, rest, q = int(np.frombuffer(block, np.int64, 1)[0]), 64 - bits, quotient_bits(bits)
    at = 8
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(block, np.uint8, (1 << q) // 8, at)))
    at += (1 << q) // 8
    run_end = np.unpackbits(np.frombuffer(block, np.uint8, (n + 7) // 8, at), count=n)
    at += (n + 7) // 8
    remainders, counts = np.frombuffer(block, np.uint64, n, at), np.frombuffer(block, np.int64, n, at + 8 * n)
    quotients = occupied[np.cumsum(run_end) - run_end].astype(np.uint64)
    top = np.uint64(at_range << rest if bits else 0)
    return top | (quotients << np.uint64(rest - q)) | remainders, counts


def merge_filters(blocks: list[bytes], at_range: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of fingerprints with the sums of their counts; nothing is lost or guessed."""
    read = [read_filter(b, at_range, bits) for b in blocks]
    slots, counts = np.concatenate([r[0] for r in read]), np.concatenate([r[1] for r in read])
    order = np.argsort(slots, kind="stable")
    slots, counts = slots[order], counts[order]
    first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
    return slots[first], np.add.reduceat(counts, first)


def repeated_fingerprints(rows: DataFrame) -> DataFrame:
    """Of rows (one column _tl_fp), the fingerprints that occur more than once: _tl_fp, _tl_n. The rows are counted first, for the number of ranges."""
    bits = range_bits(rows.count())

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(got):
            made = build_filter(np.concatenate(got), bits)
            return pa.RecordBatch.from_pydict({"_tl_range": pa.array(list(made), pa.int64()), "_tl_block": pa.array(list(made.values()), pa.binary())})

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= FLUSH:
                yield blocks(held)
                held, n = [], 0
        if n:
            yield blocks(held)
        release()

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        slots, counts = merge_filters(list(group["_tl_block"]), int(key[0]), bits)
        again = counts > 1
        return pd.DataFrame({"_tl_fp": slots[again].view(np.int64), "_tl_n": counts[again]})

    filters = batched(rows).mapInArrow(partition, "_tl_range long, _tl_block binary")
    return filters.groupBy("_tl_range").applyInPandas(merged, "_tl_fp long, _tl_n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest doc_id stays."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_tl_id"), text.alias("_tl_text")).withColumn("_tl_fp", F.xxhash64("_tl_text"))
    again = small(materialize(repeated_fingerprints(rows.select("_tl_fp")).select("_tl_fp"), "fingerprints"))
    # byte verification: equal fingerprints are copies only if the texts are
    classes = (
        rows.join(again, "_tl_fp", "left_semi")
        .groupBy("_tl_fp", "_tl_text")
        .agg(F.max("_tl_id").alias("_tl_keep"), F.count(F.lit(1)).alias("_tl_size"))
        .select("_tl_fp", F.sha2("_tl_text", 256).alias("_tl_sha"), "_tl_keep", "_tl_size")
    )
    all_rows = rows.select("_tl_id", "_tl_fp", F.sha2("_tl_text", 256).alias("_tl_sha"))
    joined = all_rows.join(classes, ["_tl_fp", "_tl_sha"], "left")
    keep = F.when(F.col("_tl_size").isNull(), F.col("_tl_id")).otherwise(F.col("_tl_keep"))
    return joined.select(
        F.col("_tl_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("_tl_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_tl_id").eqNullSafe(keep).alias("kept"),
        F.col("_tl_sha").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one: bool = False) -> DataFrame:
    """docs, all columns, with the rows of each text that have its largest doc_id; one: with one row of them."""
    rows = docs.withColumn("_tl_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn("_tl_fp", F.xxhash64("_tl_text"))
    again = small(materialize(repeated_fingerprints(rows.select("_tl_fp")).select("_tl_fp"), "fingerprints"))
    alone = rows.join(again, "_tl_fp", "left_anti").select(*docs.columns)
    groups = rows.join(again, "_tl_fp", "left_semi").groupBy("_tl_fp", "_tl_text")
    if one:
        # the order's struct is never null, so rows without an id count too
        return alone.unionByName(groups.agg(F.max_by(F.struct(*docs.columns), F.struct(id_col)).alias("_tl_row")).select("_tl_row.*"))
    best = groups.agg(F.max(id_col).alias("_tl_keep")).select(F.col("_tl_fp").alias("_tl_of"), F.sha2("_tl_text", 256).alias("_tl_sha"), "_tl_keep")
    best = small(materialize(best, "best"))
    same = (F.col("_tl_fp") == F.col("_tl_of")) & (F.sha2("_tl_text", 256) == F.col("_tl_sha")) & rows[id_col].eqNullSafe(F.col("_tl_keep"))
    return alone.unionByName(rows.join(best, same, "left_semi").select(*docs.columns))
