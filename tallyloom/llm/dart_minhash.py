"""Near-duplicate classes by DartMinHash signatures.

A text is the multiset of its shingles of five words: a shingle weighs as often as it occurs, and the similarity is the
weighted Jaccard index, the sum of the lesser weights over that of the greater ones. Hashed darts fall on the plane of weight and rank of each element, one
for each unit of area; those below the element's weight hit it. Every dart belongs to one signature coordinate, and the
hit of lowest rank is that coordinate's value. Darts come in the order of their ranks, up to a rank where about
k (ln k + 2) of them hit the text; where a coordinate is still empty, the rank is doubled. Texts that agree on a whole
band of coordinates are candidates, and the exact similarity decides, with the k-th occurrence of a shingle as an
element of its own: on these the weighted index is the plain one.

Equal multisets are one node. In a band's bucket each node is compared with the hub, the node with the most
neighbours over all bands; components of the links found are then known, and what remains in a bucket outside the hub's
component is compared with every node of another component, after a signature test. So a group of n copies costs n
comparisons, and no link between candidates is lost: only pairs that are connected anyway are skipped.

Cases: null and empty texts have no shingle and are classes of their own; texts of one to four words are one shingle;
rows that share text or doc_id are rows of one class; the class id is the least doc_id, nulls aside; only the two named
columns are read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import batched, materialize, mix, pieces, release, small, utf8
from .components import components

WORDS, SIMILAR = 5, 0.8
#: SIMILAR as a fraction: bounds in whole numbers keep pairs of exactly that similarity.
PART, WHOLE = 4, 5
#: Bands and coordinates in each: two texts with similarity 0.8 miss all bands once in 20,000 times.
BANDS, ROWS = 25, 5
#: Signature agreement below this rules out SIMILAR (six standard deviations).
AGREE = 0.58
PIECE = 1 << 18

#: Lower-cases ASCII letters; 0 is what parts words.
_FOLD = np.array([b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_ODD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, in order, and the number of words of each row."""
    b = _FOLD[data]
    n = len(b)
    is_word = np.zeros(n + 1, bool)
    is_word[:n] = b > 0
    first = is_word[:n].copy()
    first[1:] &= ~is_word[: n - 1]
    inner = at[1:-1][at[1:-1] < n]
    first[inner] = is_word[inner]
    start = np.flatnonzero(first)
    stop = is_word[:n] & ~is_word[1:]
    ends = np.zeros(n + 1, bool)
    ends[1:] = stop
    ends[inner] |= is_word[inner - 1] & (inner > 0)
    end = np.flatnonzero(ends)
    power = _powers(_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(b * power[:n], out=sums[1:])
    inverse = _powers(pow(_BASE, -1, 1 << 64), n + 1)
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return h, np.diff(np.searchsorted(start, at))


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all rows by (row, hash), the row of each and how often it occurs there."""
    h, n = words(data, at)
    end = np.cumsum(n)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (end - n)[row]
    s = np.zeros(len(row), np.uint64)
    for j in range(WORDS):
        here = place + j < end[row]
        s[here] += h[place[here] + j] * np.uint64(_ODD[j % len(_ODD)] + 2 * (j // len(_ODD)))
    s = mix(s)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (row[1:] != row[:-1])]) if len(s) else np.zeros(0, np.int64)
    return s[first], row[first], np.diff(np.r_[first, len(s)])


def occurrences(text: str) -> np.ndarray:
    """The elements of a text's multiset, in order: hashes of each shingle and the number of the occurrence."""
    raw = np.frombuffer(text.encode(), np.uint8)
    s, _, count = shingles(raw, np.array([0, len(raw)]))
    s = np.repeat(s, count)
    at = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
    return np.unique(mix(s + at.astype(np.uint64) * np.uint64(_BASE)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _layers(elements: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Elements cut into layers of weight [0, 1), [1, 2), [2, 4), ...: hash of element and layer, row, width of the layer, share of it below the weight."""
    layer, out = 0, []
    while True:
        low, high = (0.0, 1.0) if layer == 0 else (2.0 ** (layer - 1), 2.0**layer)
        on = weights > low
        if not on.any():
            break
        out.append((mix(elements[on] + np.uint64(layer * _BASE % (1 << 64))), rows[on], np.full(on.sum(), high - low), np.minimum(1.0, (weights[on] - low) / (high - low))))
        layer += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (elements, rows, weights, weights)


def darts(elements: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """Signatures (n_rows x k, uint64) of weighted sets, elements in row order. A row without elements has zeros."""
    out = np.zeros((n_rows, k), np.uint64)
    total = np.bincount(rows, weights, n_rows)
    open_rows = np.flatnonzero(total > 0)
    hits = k * (np.log(k) + 2)
    while len(open_rows):
        chosen = np.zeros(n_rows, bool)
        chosen[open_rows] = True
        on = chosen[rows]
        base, row, width, part = _layers(elements[on], rows[on], weights[on])
        limit = (hits / np.maximum(total, 1e-300))[row]
        lowest = np.full(n_rows * k, np.inf)
        thrown = []
        rank, step = np.zeros(len(base)), np.zeros(len(base), np.int64)
        turn = 0
        while len(base):
            # one dart each while most end early, then as many as the rest will need
            expect = (limit - rank) * width
            n = np.ones(len(base), np.int64) if turn < 6 else np.ceil(expect + 4 * np.sqrt(expect) + 4).astype(np.int64)
            i = np.repeat(np.arange(len(base)), n)
            begin = np.cumsum(n) - n
            j = step[i] + np.arange(len(i)) - begin[i] + 1
            name = mix(base[i] + j.astype(np.uint64) * np.uint64(_BASE))
            gap = -np.log(_uniform(name)) / width[i]
            run = np.cumsum(gap)
            r = rank[i] + run - (run - gap)[begin][i]
            other = mix(name ^ np.uint64(_ODD[1]))
            hit = (r < limit[i]) & (_uniform(other) < part[i])
            slot = row[i[hit]] * k + (mix(name[hit] + np.uint64(_ODD[2])) % np.uint64(k)).astype(np.int64)
            np.minimum.at(lowest, slot, r[hit])
            thrown.append((slot, r[hit], name[hit]))
            final = r[begin + n - 1]
            more = final < limit
            base, row, width, part, limit, rank, step = base[more], row[more], width[more], part[more], limit[more], final[more], (step + n)[more]
            turn += 1
        flat = out.reshape(-1)
        for slot, r, name in thrown:
            won = r == lowest[slot]
            flat[slot[won]] = name[won]
        open_rows = open_rows[(lowest.reshape(n_rows, k)[open_rows] == np.inf).any(1)]
        hits *= 2
    return out


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """A hash of each band's coordinates and its number."""
    cut = signatures.reshape(len(signatures), BANDS, ROWS)
    h = np.zeros(cut.shape[:2], np.uint64)
    for i in range(ROWS):
        h = mix(h + cut[:, :, i] * np.uint64(_ODD[i % len(_ODD)]))
    return mix(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64)


def _second(text: str) -> Column:
    """A second hash of the text: rows are told by both."""
    return F.xxhash64(F.lit(1), text)


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: doc_id, fp and fp2 (hashes of the text), node (of the multiset; null without shingles), n (shingles, repeated ones too), bands, and one byte of each coordinate."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("fp"), "text", _second("text").alias("fp2"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            for a, b in pieces(at, PIECE):
                s, row, count = shingles(data[at[a] : at[b]], at[a : b + 1] - at[a])
                signatures = darts(s, row, count.astype(np.float64), b - a, BANDS * ROWS)
                n = np.bincount(row, count, b - a).astype(np.int64)
                node = np.zeros(b - a, np.uint64)
                np.add.at(node, row, mix(mix(s + np.uint64(_ODD[3])) + count.astype(np.uint64)))
                node = mix(node ^ n.astype(np.uint64)).view(np.int64)
                none = n == 0
                edges = pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32))
                short = (signatures & np.uint64(255)).astype(np.uint8).tobytes()
                width = BANDS * ROWS
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), batch.column(3).slice(a, b - a), pa.array(node, mask=none), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(edges, pa.array(bands_of(signatures).ravel())), pa.array([short[i : i + width] for i in range(0, len(short), width)], pa.binary())],
                    ["doc_id", "fp", "fp2", "node", "n", "bands", "short"],
                )
        release()

    return batched(rows).mapInArrow(run, f"doc_id {id_type}, fp long, fp2 long, node long, n int, bands array<long>, short binary")


def _jaccard(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, text_u, text_v), those with exact similarity SIMILAR or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()

        def of(node, text):
            if node not in held:
                held[node] = occurrences(text or "")
                if len(held) > 64:
                    held.popitem(last=False)
            held.move_to_end(node)
            return held[node]

        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = np.zeros(len(u), bool)
            for i in range(len(u)):
                a, b = of(u[i], batch.column(2)[i].as_py()), of(v[i], batch.column(3)[i].as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = both >= SIMILAR * (len(a) + len(b) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def _beside_hub(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, text_u, text_v) with a hub v: hub, node, n (shingles of the node), common (of them in the hub), extra (the others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()
        for batch in batches:
            n, common, extra = [], [], []
            for i in range(batch.num_rows):
                sets = []
                for node, text in ((batch.column(1)[i].as_py(), batch.column(3)[i]), (None, batch.column(2)[i])):
                    if node is None or node not in held:
                        found = occurrences(text.as_py() or "")
                        if node is not None:
                            held[node] = found
                            if len(held) > 64:
                                held.popitem(last=False)
                    sets.append(found if node is None else held[node])
                more = np.setdiff1d(sets[1], sets[0], assume_unique=True)
                n.append(len(sets[1]))
                common.append(len(sets[1]) - len(more))
                extra.append(more.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(n, pa.int32()), pa.array(common, pa.int32()), pa.array(extra, pa.list_(pa.int64()))], ["hub", "node", "n", "common", "extra"])

    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(run, "hub long, node long, n int, common int, extra array<long>")


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, short_u, short_v), those whose signatures agree on AGREE of the coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            mask = pa.array((a == b).mean(1) >= AGREE) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return pairs.select("u", "v", "short_u", "short_v").mapInArrow(run, "u long, v long")


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, fp, fp2, root (of its class; null without shingles)."""
    signed = materialize(sign(docs, id_col, text_col), "signatures")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("short").alias("short"))
    nodes = materialize(nodes, "nodes")

    # buckets of two or more nodes
    entries = nodes.select("node", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(entries.join(shared, "band").select("band", "node", "size"), "buckets")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    hubs = members.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("top")).select("band", F.col("top.node").alias("hub"))
    hubs = materialize(hubs, "hubs")
    star = materialize(members.join(hubs, "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), "stars")

    def with_texts(pairs: DataFrame) -> DataFrame:
        """pairs with text_u and text_v; texts are fetched for the nodes that occur in pairs."""
        asked = materialize(pairs.select("u").unionAll(pairs.select("v")).distinct().join(nodes.select(F.col("node").alias("u"), "fp"), "u"), "asked")
        own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        read = docs.select(own.alias("text")).withColumn("fp", F.xxhash64("text"))
        texts = read.join(small(asked.select("fp")), "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text"))
        texts = materialize(asked.join(texts, "fp").select(F.col("u").alias("node"), "text"), "texts")
        for end in ("u", "v"):
            pairs = pairs.join(texts.toDF(end, f"text_{end}"), end)
        return pairs

    links = materialize(_jaccard(with_texts(star)), "links")
    found = components(links)

    # buckets with nodes outside their hub's component. Two nodes that share no shingle but the hub's can only be similar
    # if both lie mostly within the hub and are smaller; all others must meet in a shingle that the hub has not
    rooted = members.select("band", "node").join(found, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    main = hubs.join(found, hubs["hub"] == found["node"], "left").select("band", "hub", F.coalesce("root", "hub").alias("main"))
    rooted = rooted.join(main, "band")
    mixed = rooted.where("root <> main").select("hub").distinct()
    rooted = materialize(rooted.where("node <> hub").select("hub", "node", "root", "main").distinct().join(mixed, "hub", "left_semi"), "mixed")
    beside = _beside_hub(with_texts(rooted.select(F.col("node").alias("u"), F.col("hub").alias("v"))))
    beside = materialize(beside.join(rooted, ["hub", "node"]), "beside")
    wanted = (F.col("u.root") != F.col("u.main")) & (F.col("u.root") != F.col("v.root")) & ((F.col("v.root") == F.col("v.main")) | (F.col("u.node") < F.col("v.node")))
    ends = [F.col("u.node").alias("u"), F.col("v.node").alias("v")]
    # they must share so many of them that one is among the rarest of each: the prefix filter, by size steps of the other
    step = lambda n: F.floor(F.log(n) * 20).cast("int")
    extra = beside.select("hub", "node", "root", "main", "n", F.explode("extra").alias("at"))
    rare = extra.join(extra.groupBy("hub", "at").agg(F.count(F.lit(1)).alias("often")), ["hub", "at"])
    rare = rare.withColumn("rank", F.row_number().over(Window.partitionBy("hub", "node").orderBy("often", "at"))).where(f"{WHOLE} * (rank - 1) <= {WHOLE - PART} * n")
    rare = materialize(rare.drop("often").withColumn("size", step(F.col("n"))), "rare")
    least = F.expr(f"({PART} * n + {WHOLE - 1}) div {WHOLE}")
    most = lambda common: F.expr(f"{PART + WHOLE} * ({common}) div {PART} - n")
    reach = rare.where("root <> main").withColumn("size", F.explode(F.sequence(step(least), step(most("n - rank + 1")))))
    enough = lambda end: (PART + WHOLE) * (F.col(f"{end}.n") - F.col(f"{end}.rank") + 1) >= PART * (F.col("u.n") + F.col("v.n"))
    near = enough("u") & enough("v")
    rest = reach.alias("u").join(rare.alias("v"), (F.col("u.hub") == F.col("v.hub")) & (F.col("u.at") == F.col("v.at")) & (F.col("u.size") == F.col("v.size")) & near & wanted).select(*ends)
    # of nodes mostly within the hub: from the least to the largest size that can be similar
    step = lambda n: F.floor(F.log(n) * 100).cast("int")
    within = beside.drop("extra").where(f"{WHOLE} * common >= {PART} * n")
    reach = within.where("root <> main").withColumn("at", F.explode(F.sequence(step(least), step(most("common")))))
    both = F.least("u.common", "v.common")
    inner = reach.alias("u").join(within.withColumn("at", step(F.col("n"))).alias("v"), (F.col("u.hub") == F.col("v.hub")) & (F.col("u.at") == F.col("v.at")) & wanted & (WHOLE * both >= PART * (F.col("u.n") + F.col("v.n") - both))).select(*ends)
    rest = rest.unionAll(inner).distinct()
    for end in ("u", "v"):
        rest = rest.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("short").alias(f"short_{end}")), end)
    rest = materialize(_agreeing(rest.where(f"least(n_u, n_v) >= {SIMILAR} * greatest(n_u, n_v)")), "rest")
    more = materialize(_jaccard(with_texts(rest)), "links")
    if more.limit(1).count():
        found = components(links.unionAll(more))

    return signed.select("doc_id", "fp", "fp2", "node").join(found, "node", "left").select("doc_id", "fp", "fp2", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of the class), class_size, and whether it is the one that stays."""
    own = _rooted(docs, id_col, text_col).select("doc_id", "root")
    # a table of its own: the join then has a plain exchange on each side, and a class with very many rows can be split
    classes = materialize(own.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1"), "classes")
    joined = own.join(classes, "root", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return joined.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each class of near-duplicates: one with the least doc_id, nulls aside."""
    own = materialize(_rooted(docs, id_col, text_col).where("root IS NOT NULL"), "rooted")
    best = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "fp2")).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    best = materialize(best.select("root", F.col("best.doc_id").alias("_tl_id"), F.col("best.fp").alias("_tl_fp"), F.col("best.fp2").alias("_tl_fp2")), "best")
    text = ["_tl_fp", "_tl_fp2"]
    classed = materialize(own.select("root", "fp", "fp2").distinct().join(best.select("root"), "root", "left_semi").select(F.col("fp").alias("_tl_fp"), F.col("fp2").alias("_tl_fp2")), "classed")
    rows = docs.withColumn("_tl_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumns({"_tl_fp": F.xxhash64("_tl_text"), "_tl_fp2": _second("_tl_text")})
    alone = rows.join(small(classed), text, "left_anti").select(*docs.columns)
    # of equal rows, with the same id and text, one
    kept = rows.withColumn("_tl_id", F.col(id_col)).alias("d").join(small(best.drop("root")).alias("b"), (F.col("d._tl_fp") == F.col("b._tl_fp")) & (F.col("d._tl_fp2") == F.col("b._tl_fp2")) & F.col("d._tl_id").eqNullSafe(F.col("b._tl_id")), "left_semi")
    kept = kept.groupBy(*text).agg(F.first(F.struct(*docs.columns)).alias("_tl_row"))
    return alone.unionByName(kept.select("_tl_row.*"))
