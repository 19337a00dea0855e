"""Centroid clustering by sort-means: Lloyd's rounds on whole-number vectors, exact and without a shuffle of vectors.

Each round orders, for every centroid, the others by their distance from it. A vector starts at the centroid of its
last assignment, of distance d, and looks at the others in that order; it stops at the first one that lies strictly
beyond 2 d, since no centroid from there on can be nearer (one at exactly 2 d may tie, so it is still looked at).

A round is one scan: tasks assign the vectors of a batch, write them with their cluster, and add one row of sums for
each cluster they met. The rows of sums stand in columns of their own, so adding them up reads no vector. What reaches
the driver is one centroid table a round, of k rows.

Cases: a vector counts if it has exactly `dim` components, none null or non-finite; others are left out. Components
beyond LIMIT after quantisation raise an error, since distances would no longer fit a long. Rows that share a vec_id
are vectors of their own; a null vec_id sorts last as a seed; fewer vectors than k give fewer centroids; an empty
table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import batched, discard, materialize, release

#: The largest whole number of a component: four squared distances of 64 such components still fit a long.
LIMIT = 1 << 26
STATE = "vec_id long, v binary, cluster int, distance long, n long, sums array<bigint>"


def counts(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, all finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dim) & sound, F.lit(False))


def whole(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of dim components."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"a component beyond {LIMIT / scale:g}: distances would not fit a long")
    return x.astype(np.int64).reshape(-1, dim)


def assign(x: np.ndarray, last: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and its squared distance, from the last assignment on."""
    gaps = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    best, distance = last.copy(), ((x - centroids[last]) ** 2).sum(1)
    for a in np.unique(last):
        rows = np.flatnonzero(last == a)
        reach = 4 * distance[rows]
        for j in np.argsort(gaps[a], kind="stable"):
            if j == a:
                continue
            near = gaps[a, j] <= reach
            rows, reach = rows[near], reach[near]
            if not len(rows):
                break
            d = ((x[rows] - centroids[j]) ** 2).sum(1)
            better = (d < distance[rows]) | ((d == distance[rows]) & (j < best[rows]))
            best[rows[better]], distance[rows[better]] = j, d[better]
    return best, distance


def _round(vectors: DataFrame, centroids: np.ndarray, dim: int, scale: float, keep: bool) -> DataFrame:
    """One assignment. vectors: (vec_id, embedding) at first, later (vec_id, v, cluster). keep: write the vectors too, for another round."""
    k, first = len(centroids), "v" not in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                x, last = whole(batch.column(1), dim, scale), np.zeros(batch.num_rows, np.int64)
            else:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).astype(np.int64).reshape(-1, dim)
                last = batch.column(2).to_numpy().astype(np.int64)
            best, distance = assign(x, last, centroids)
            n += np.bincount(best, minlength=k)
            for c in np.unique(best):
                mine = best == c
                sums[c] += x[mine].sum(0)
                inertia[c] += int(distance[mine].sum(dtype=object))
            raw = x.astype(np.int32).tobytes()
            v = [raw[i : i + 4 * dim] for i in range(0, len(raw), 4 * dim)] if keep else [None] * len(x)
            none = pa.nulls(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(v, pa.binary()), pa.array(best, pa.int32()), pa.array(distance), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))], names=names)
        met = np.flatnonzero(n)
        tail = [pa.nulls(len(met)).cast(pa.int64()), pa.nulls(len(met)).cast(pa.binary()), pa.array(met, pa.int32()), pa.array([int(i) for i in inertia[met]], pa.int64()), pa.array(n[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(tail, names=names)
        release()

    names = ["vec_id", "v", "cluster", "distance", "n", "sums"]
    return batched(vectors).mapInArrow(run, STATE)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid moved to floor(sum / count) of its vectors; an empty one stays."""
    summed = state.where("n IS NOT NULL").select("cluster", "n", F.posexplode("sums"))
    summed = summed.groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = centroids.copy()
    for c, pos, s, n in summed.collect():  # k * dim rows at most
        out[c, pos] = int(s) // int(n)
    return out


def sort_means(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", scale: float = 64.0, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance), the final centroids, and the inertia of each. The k kept vectors with the smallest sha256 of seed:vec_id are the first centroids."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(counts(F.col("embedding"), dim))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))  # vectors that share an id by what they become
    seeds = rows.orderBy(key.asc_nulls_last(), numbers).limit(k).select("embedding").collect()
    if not seeds:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dim), np.int64), []
    centroids = whole(pa.array([r[0] for r in seeds], pa.list_(pa.float64())), dim, scale)
    state = None
    for left in range(rounds, -1, -1):
        source = rows if state is None else state.where("v IS NOT NULL").select("vec_id", "v", "cluster")
        now = materialize(_round(source, centroids, dim, scale, keep=left > 0), "clusters")
        if state is not None:
            discard(state)
        state = now
        if left:
            centroids = _moved(state, centroids)
    inertia = [0] * len(centroids)
    for c, d in state.where("n IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect():
        inertia[c] = int(d)
    return state.where("n IS NULL").select("vec_id", "cluster", "distance"), centroids, inertia
