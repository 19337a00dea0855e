"""A Merkle manifest of a dataset: trees of arity 8 by group, one tree over the groups' roots, a proof for every row.

Rows become leaves and get their place in their group by a range sort and prefix sums of counts. Aligned blocks of 512
leaves (three levels) are rows of their own; their roots are the leaves of the next level, so each level is a table
512 times smaller, built and read by many tasks. Proofs come down the same levels: a block meets the proof of its own
root in a join, and a fractal traversal gives the paths of its leaves in order. Of each stacked level the traversal
keeps the existing run of nodes, from which paths are read, and the desired next one, which grows by one leaf a step
and is complete when the existing one is used up; so it holds two runs a level, whatever the block's size. The proof
of the block's root, which came from the levels above, is then appended.

Cases: null fields are leaves' `-`; a null group is a group of its own, the first; rows are ordered by id (null first),
then by leaf, so repeated rows have places of their own and equal leaves give equal results up to their places; one
leaf alone is its group's root, one group's root the root; an empty table gives an empty result; very long texts pass
only through the hash; columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import batched, discard, materialize, release, small

ARITY = 8
#: Levels that a block spans, and the leaves of a whole one.
STACK = 3
BLOCK = ARITY**STACK
#: Proofs of blocks, of some 2 KB each, that may be broadcast.
PROOFS = 4_096
PATH = "array<struct<before: string, after: string>>"


def _field(value: Column) -> Column:
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields: of each its byte count, a colon and its text, or - if null."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, digest, lambda acc, run: F.sha2(F.concat(run["before"], acc, run["after"]), 256))


def siblings(path: Column) -> Column:
    """The siblings on a path, from the leaf up, left to right, as one text."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), "")


# ------------------------------------------------------------------ one block


def node(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above so many leaves, up to a block's."""
    up = 0
    while ARITY**up < min(size, BLOCK):
        up += 1
    return up


class Growing:
    """A run of nodes of one level that is built from the leaves below it, one leaf a step."""

    def __init__(self, leaves: list[str], level: int, start: int) -> None:
        self.leaves, self.level, self.at = leaves, level, start
        self.end = min(start + ARITY ** (level + 1), len(leaves))
        self.runs: list[list[str]] = [[] for _ in range(level + 1)]

    def step(self) -> None:
        if self.at >= self.end:
            return
        self.runs[0].append(self.leaves[self.at])
        self.at += 1
        for up in range(self.level):
            if self.runs[up] and (len(self.runs[up]) == ARITY or self.at == len(self.leaves)):
                self.runs[up + 1].append(node(self.runs[up]))
                self.runs[up] = []

    def whole(self) -> list[str]:
        while self.at < self.end:
            self.step()
        return self.runs[-1]


def block_root(leaves: list[str], levels: int) -> str:
    return node(Growing(leaves, levels - 1, 0).whole()) if levels else leaves[0]


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """The paths of a block's leaves in order: of each level the siblings before and after."""
    existing = [Growing(leaves, level, 0).whole() for level in range(levels)]
    desired = [Growing(leaves, level, ARITY ** (level + 1)) for level in range(levels - 1)]
    for at in range(len(leaves)):
        path = []
        for level, run in enumerate(existing):
            i = at // ARITY**level % ARITY
            path.append(("".join(run[:i]), "".join(run[i + 1 :])))
        yield path
        for level, growing in enumerate(desired):
            growing.step()
            if (at + 1) % ARITY ** (level + 1) == 0:
                existing[level] = growing.whole()
                desired[level] = Growing(leaves, level, at + 1 + ARITY ** (level + 1))


# ------------------------------------------------------------------ tables of blocks


def places(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """rows (a materialised table) with _tl_pos, the place in their tree (from 0), and _tl_size, the tree's rows; and the tables that this reads."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 1_000_000 + 1)
    by = [F.col(tree), *[F.col(c).asc_nulls_first() for c in order]]
    # the last key parts equal rows, which otherwise would be one range
    dealt = rows.withColumn("_tl_row", F.monotonically_increasing_id()).repartitionByRange(parts, *by, F.col("_tl_row"))
    dealt = materialize(dealt.sortWithinPartitions(*by, "_tl_row").drop("_tl_row").withColumn("_tl_at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_tl_at", 33).alias("_tl_part")
    runs = dealt.groupBy(tree, part).agg(F.min("_tl_at").alias("_tl_from"), F.count(F.lit(1)).alias("_tl_n"))
    whole = Window.partitionBy(tree)
    before = F.sum("_tl_n").over(whole.orderBy("_tl_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(tree, "_tl_part", "_tl_from", F.coalesce(before, F.lit(0)).alias("_tl_before"), F.sum("_tl_n").over(whole).alias("_tl_size"))
    runs = materialize(runs, "runs")
    joined = dealt.withColumn("_tl_part", part).join(small(runs), [tree, "_tl_part"])
    return joined.withColumn("_tl_pos", F.col("_tl_before") + F.col("_tl_at") - F.col("_tl_from")).drop("_tl_part", "_tl_at", "_tl_from", "_tl_before"), [dealt, runs]


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """nodes (tree, _tl_pos, _tl_size, node and carried columns) as one row a block, its nodes in order."""
    return (
        nodes.groupBy("tree", "_tl_size", F.expr(f"_tl_pos DIV {BLOCK}").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("_tl_pos", "node", *carry))).alias("nodes"))
    )


def _roots(blocks: DataFrame) -> DataFrame:
    """The nodes of the next level: one for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lists = batch.column(1).to_pylist(), batch.column(3)
            roots = [block_root(lists[i].values.field("node").to_pylist(), height(n)) for i, n in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([-(-n // BLOCK) for n in sizes], pa.int64()), pa.array(roots, pa.string())], names=["tree", "_tl_pos", "_tl_size", "node"])
        release()

    return batched(blocks.select("tree", "_tl_size", "block", "nodes")).mapInArrow(run, "tree string, _tl_pos long, _tl_size long, node string")


def climb(nodes: DataFrame, carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks from the leaves up, and (tree, node): every tree's root."""
    blocks = []
    while True:
        blocks.append(materialize(_blocks(nodes, [] if blocks else carry), "blocks"))
        before, nodes = nodes, materialize(_roots(blocks[-1]), "nodes")
        if len(blocks) > 1:
            discard(before)
        if nodes.where("_tl_size > 1").isEmpty():
            return blocks, nodes


def _paths(blocks: DataFrame, upper: DataFrame, carry: dict[str, str], told: dict[str, str]) -> DataFrame:
    """Of each node of blocks: tree, its place, its digest and carried columns, its whole path, and what upper (tree, block, path and told columns) says of its block."""
    rows = blocks.join(small(upper, PROOFS), ["tree", "block"]).select("tree", "_tl_size", "nodes", "path", *told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, sizes, above = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i, size in enumerate(sizes):
                nodes, tail = batch.column(2)[i].values, [(r["before"], r["after"]) for r in above[i]]
                paths = [path + tail for path in traverse(nodes.field("node").to_pylist(), height(size))]
                flat, offsets, n = [r for p in paths for r in p], [0], len(paths)
                for p in paths:
                    offsets.append(offsets[-1] + len(p))
                runs = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.string()) for k in (0, 1)], names=["before", "after"])
                same = [pa.array([batch.column(4 + j)[i].as_py()] * n, pa.string()) for j in range(len(told))]
                columns = [pa.array([trees[i]] * n, pa.string()), nodes.field("_tl_pos"), nodes.field("node"), *[nodes.field(c) for c in carry], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), *same]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "block", "node", *carry, "path", *told])
        release()

    kinds = {"tree": "string", "block": "long", "node": "string", **carry, "path": PATH, **told}
    return batched(rows).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def descend(blocks: list[DataFrame], tops: DataFrame, carry: dict[str, str], told: dict[str, str]) -> DataFrame:
    """The paths of all leaves. tops: of each tree the path of its root, and told columns."""
    upper = tops.withColumn("block", F.lit(0).cast("long"))
    for table in reversed(blocks[1:]):
        upper = materialize(_paths(table, upper, {}, told).drop("node"), "paths")
    return _paths(blocks[0], upper, carry, told)


def manifest(rows: DataFrame, carry: dict[str, str] | None = None) -> DataFrame:
    """Proofs of rows (group, id: long, node: the leaf's digest, and columns to carry with their types): id, node, carried columns, path, subroot, root.

    fold(node, path) gives the root; siblings(path) gives the digests of the proof.
    """
    carry = {"id": "long", **(carry or {})}
    # null first, then by the bytes of the group's name
    tree = F.coalesce(F.concat(F.lit("."), F.col("group")), F.lit(""))
    leaves = materialize(rows.select(tree.alias("tree"), "node", *carry), "leaves")
    placed, read = places(leaves, "tree", ["id", "node"])
    blocks, subroots = climb(placed, list(carry))
    discard(leaves, *read)
    groups = subroots.select(F.lit("").alias("tree"), "node", F.col("tree").alias("group"))
    placed, read = places(groups, "tree", ["group"])
    top, roots = climb(placed, ["group"])
    over = descend(top, roots.select("tree", F.expr(f"CAST(array() AS {PATH})").alias("path"), F.col("node").alias("root")), {"group": "string"}, {"root": "string"})
    over = materialize(over.select(F.col("group").alias("tree"), "path", F.col("node").alias("subroot"), "root"), "groups")
    discard(*read, subroots, *top, roots)
    return descend(blocks, over, carry, {"subroot": "string", "root": "string"}).select("node", *carry, "path", "subroot", "root")
