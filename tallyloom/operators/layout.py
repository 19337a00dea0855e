"""Positioned words to table rows: columns, lines, cells, continuation rows. Pages are partitions; nothing spans a document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import _with


def column_of(x0: Column, x1: Column, bounds: Column) -> Column:
    """The column of a word by its centre: [b_i, b_i+1), the outer ones are clamped."""
    mid = (x0 + x1) / 2
    return F.greatest(F.lit(0), F.least(F.size(F.filter(bounds, lambda b: b <= mid)) - 1, F.size(bounds) - 2))


def ruled_columns(edges: DataFrame, min_len: float = 5.0, tol: float = 1.5, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """keys, column, x: vertical edges (page, x0, top, bottom) longer than min_len, chained while the gap is at most tol; the mean of each chain."""
    long = edges.where(F.col("bottom") - F.col("top") > min_len).select(*keys, F.col("x0").alias("x"))
    w = Window.partitionBy(*keys).orderBy("x")
    chained = long.withColumn("_tl_new", F.coalesce((F.col("x") - F.lag("x").over(w) > tol).cast("int"), F.lit(0)))
    chained = chained.withColumn("column", F.sum("_tl_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy(*keys, "column").agg(F.avg("x").alias("x"))


def banded_columns(words: DataFrame, min_gap: float = 4.0, resolution: float = 0.5, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """keys, x: the centres of corridors of at least min_gap that no word of the page covers, on a grid of resolution."""
    w = Window.partitionBy(*keys)
    cells = words.withColumn("_tl_min", F.min("x0").over(w))
    cells = cells.select(*keys, "_tl_min", F.floor((F.col("x0") - F.col("_tl_min")) / resolution).alias("a"), F.floor((F.col("x1") - F.col("_tl_min")) / resolution).alias("b")).groupBy(*keys, "_tl_min", "a").agg(F.max("b").alias("b"))
    reach = F.max("b").over(Window.partitionBy(*keys).orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    gaps = cells.withColumn("_tl_reach", reach).where((F.col("a") - F.col("_tl_reach") - 1) * resolution >= min_gap)
    return gaps.select(*keys, (F.col("_tl_min") + (F.col("_tl_reach") + 1 + F.col("a")) / 2 * resolution).alias("x"))


def ruled_bounds(edges: DataFrame, min_len: float = 5.0, tol: float = 1.5, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """keys, bounds: the ruled columns' edges of each page, from left to right."""
    return ruled_columns(edges, min_len, tol, keys).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("bounds"))


def banded_bounds(words: DataFrame, min_gap: float = 4.0, resolution: float = 0.5, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """keys, bounds: the corridors' centres of each page between its outermost words, which lie 1 inside the outer bounds."""
    inner = banded_columns(words, min_gap, resolution, keys).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("_tl_inner"))
    outer = words.groupBy(*keys).agg((F.min("x0") - 1.0).alias("_tl_a"), (F.max("x1") + 1.0).alias("_tl_b"))
    both = outer.join(inner.hint("merge"), list(keys), "left")
    return both.select(*keys, F.concat(F.array("_tl_a"), F.coalesce("_tl_inner", F.array().cast("array<double>")), F.array("_tl_b")).alias("bounds"))


def cell_rows(lined: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """keys, line, cells: lines with words (see line_words) and bounds as arrays of one text a column."""
    bounds = F.col("bounds")
    placed = F.transform("words", lambda w: F.struct(column_of(w["x0"], w["x1"], bounds).alias("column"), w["text"].alias("text")))
    text = lambda own, i: F.array_join(F.transform(F.filter(own, lambda w: w["column"] == i), lambda w: w["text"]), " ")
    # most columns of a line are empty: its words are gone through only for the others
    each = lambda own, taken: F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda i: F.when(F.array_contains(taken, i), text(own, i)).otherwise(F.lit("")))
    return lined.select(*keys, "line", _with(placed, lambda own: _with(own["column"], lambda taken: each(own, taken))).alias("cells"))


def table_rows(words: DataFrame, bounds: DataFrame, tol: float = 2.0, keys: tuple[str, ...] = ("page",), tasks: int | None = None) -> DataFrame:
    """keys, line, cells, and what else bounds has: the lines of each page that has bounds (two at least), as arrays of one text a column. Pages are as many as the input has: their bounds are dealt and sorted with the words, neither joined to the lines nor broadcast. A page's lines follow one another in one task."""
    more = [c for c in bounds.columns if c not in (*keys, "bounds")]
    pages = bounds.where(F.size("bounds") > 1).dropna(subset=list(keys)).select(*keys, F.struct("bounds", *more).alias("_tl_own"))
    lined = line_words(words, tol, keys, pages, tasks).select(*keys, "line", "words", "_tl_own.*")
    return cell_rows(lined, (*keys, *more))


def merge_cells(rows: DataFrame, is_start: Column, keys: tuple[str, ...], order: tuple[str, ...], joiner: str = " ") -> DataFrame:
    """keys, record, order columns of its first row, cells: rows (cells: arrays) that do not start a record are appended, cell by cell, to the one before; what stands before the first start is a record of its own."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("record", F.coalesce(F.sum(F.coalesce(is_start, F.lit(False)).cast("int")).over(w), F.lit(0)))
    # the window's partitions hold whole records: nothing is shuffled again
    held = own.groupBy(*keys, "record").agg(F.array_sort(F.collect_list(F.struct(*order, "cells"))).alias("_tl_rows"))
    return held.select(*keys, "record", *[F.col("_tl_rows")[0][c].alias(c) for c in order], _joined(F.col("_tl_rows"), joiner).alias("cells"))


def _joined(rows: Column, joiner: str) -> Column:
    """The cells of a record's rows, one below the other; empty ones leave no trace."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r["cells"])))
    text = lambda i: F.array_join(F.filter(F.transform(rows, lambda r: F.get(r["cells"], i)), lambda t: t != ""), joiner)
    return F.transform(F.sequence(F.lit(0), width - 1), text)


def table_records(words: DataFrame, bounds: DataFrame, is_start: Column, tol: float = 2.0, keys: tuple[str, ...] = ("page",), joiner: str = " ", tasks: int | None = None) -> DataFrame:
    """keys, record, line (its first), cells, and what else bounds has: merge_cells of table_rows, page by page. The rows of a page come in order in one task, so records are gathered as they pass: of all that, only words are shuffled and sorted, once."""
    rows = table_rows(words, bounds, tol, keys, tasks).withColumn("_tl_start", F.coalesce(is_start, F.lit(False)))
    n, more = len(keys), [c for c in rows.columns if c not in (*keys, "line", "cells", "_tl_start")]
    rows, first = rows.select(*keys, *more, "line", "cells", "_tl_start"), len(keys) + len(more)
    own = ("line", "cells")
    row = T.StructType([rows.schema[c] for c in own])
    schema = T.StructType([*rows.schema.fields[:first], T.StructField("record", T.LongType()), T.StructField("_tl_rows", T.ArrayType(row))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple[pa.RecordBatch, list[int]]]:
            page, record = None, 0
            for batch in batches:
                out, starts = [], []
                for at, begins in zip(zip(*(c.to_pylist() for c in batch.columns[:n]), strict=True), batch.column("_tl_start").to_pylist(), strict=True):
                    if at != page or begins:
                        record = int(begins) + (record if at == page else 0)
                        page = at
                        starts.append(len(out))
                    out.append(record)
                yield batch.append_column("record", pa.array(out, pa.int64())), starts

        return _gathered(told(), [*range(first), "record"], own, schema)

    held = rows.mapInArrow(run, schema)
    return held.select(*keys, "record", F.col("_tl_rows")[0]["line"].alias("line"), _joined(F.col("_tl_rows"), joiner).alias("cells"), *more)


def lines(words: DataFrame, tol: float = 2.0, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """words (keys, text, x0, x1, top) with line: a word joins the line whose FIRST word is at most tol above it.

    Words of a page are sorted by their rounded top, then from left to right; each task runs once over its sorted words
    and keeps only the page and the first word's top, so a page costs linear time and no page is held. A word without a
    top comes before the others of its page, and those share a line.
    """
    dealt, n = _dealt(words, keys), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, line, _ in _walk(batches, n, tol):
            yield batch.append_column("line", pa.array(line, pa.int32()))

    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField("line", T.IntegerType())]))


def line_words(words: DataFrame, tol: float = 2.0, keys: tuple[str, ...] = ("page",), pages: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """keys, line, words: the lines of lines(), each with an array of its words (x0, text, x1) from left to right.

    The words of a line follow one another in the sorted pass, so it gathers them as it goes and holds one line: what is
    shuffled afterwards are lines, not words. With pages (keys, _tl_own: a struct, one row a page) only their lines are
    kept, each with its page's _tl_own. tasks: see sorted_tasks.
    """
    dealt, n = _dealt(words, keys, pages, tasks), len(keys)
    own = ("x0", "text", "x1")
    word = T.StructType([dealt.schema[c] for c in own])
    more = [] if pages is None else [dealt.schema["_tl_own"]]
    schema = T.StructType([*dealt.schema.fields[:n], T.StructField("line", T.IntegerType()), *more, T.StructField("words", T.ArrayType(word))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _owned(batches, n) if more else batches
        numbered = ((batch.append_column("line", pa.array(line, pa.int32())), starts) for batch, line, starts in _walk(known, n, tol))
        return _gathered(numbered, [*range(n), "line", *(f.name for f in more)], own, schema)

    return dealt.mapInArrow(run, schema).withColumn("words", F.array_sort("words"))


def _gathered(batches: Iterator[tuple[pa.RecordBatch, list[int]]], first: list[int | str], own: tuple[str, ...], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows, of which those given in starts are the first: its columns named in first as they stand there, and a list of its columns own. Runs go on over batches; one is held."""

    def rows_of(rows: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        heads = rows.select(first).take(pa.array(starts, pa.int32()))
        each = pa.StructArray.from_arrays([rows.column(c) for c in own], list(own))
        lists = pa.ListArray.from_arrays(pa.array([*starts, rows.num_rows], pa.int32()), each)
        return pa.RecordBatch.from_arrays([*heads.columns, lists], schema.names)

    held = None  # the last run: it may go on in the next batch
    for rows, starts in batches:
        if held is not None:
            starts = [0, *(held.num_rows + i for i in starts)]
            rows = pa.concat_batches([held, rows])
        if len(starts) > 1:
            yield rows_of(rows.slice(0, starts[-1]), starts[:-1])
        held = rows.slice(starts[-1]) if starts else None
    if held is not None:
        yield rows_of(held, [0])


def sorted_tasks(words: DataFrame) -> int:
    """Tasks for the sorted pass over so many words, however the session deals its shuffles: words pack so well that by their packed size too many would come together, and be spilled. One for every 250,000 words (40 MB of memory to sort), up to 200, to which Spark writes without sorting; more only where one would have over 4,000,000 words. Counts the words, which costs nothing where they are a table."""
    n = words.count()
    return max(min(n // 250_000 + 1, 200), n // 4_000_000 + 1)


def _dealt(words: DataFrame, keys: tuple[str, ...], pages: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """keys, text, x0, x1, top: pages as a whole, sorted by their rounded top, then from left to right. With pages, their rows (keys, _tl_own) stand before their words."""
    own = words.select(*keys, "text", F.col("x0").cast("double"), F.col("x1").cast("double"), F.col("top").cast("double")).withColumn("_tl_y", F.round("top", 1))
    order = ["_tl_y", "x0", "x1", "text", "top"]
    if pages is not None:
        own = own.unionByName(pages, allowMissingColumns=True)
        order = [F.col("_tl_own").isNull(), *order]
    dealt = own.repartition(*keys) if tasks is None else own.repartition(tasks, *keys)
    return dealt.sortWithinPartitions(*keys, *order).drop("_tl_y")


def _owned(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The words of those pages that have a row with _tl_own before them, each with it."""
    page, last = None, None
    for batch in batches:
        mine = batch.column("_tl_own")
        known = mine.is_valid()
        pool = mine.filter(known) if last is None else pa.concat_arrays([last, mine.filter(known)])
        of, kept, at = (0 if last is not None else -1), [], []
        for i, (p, new) in enumerate(zip(zip(*(c.to_pylist() for c in batch.columns[:n]), strict=True), known.to_pylist(), strict=True)):
            if new:
                page, of = p, of + 1
            elif p == page:
                kept.append(i)
                at.append(of)
        if len(pool):
            last = pool.slice(len(pool) - 1)
        if kept:
            own = batch.take(pa.array(kept, pa.int32()))
            yield own.set_column(own.schema.get_field_index("_tl_own"), "_tl_own", pool.take(pa.array(at, pa.int32())))


def _walk(batches: Iterator[pa.RecordBatch], n: int, tol: float) -> Iterator[tuple[pa.RecordBatch, list[int], list[int]]]:
    """Each batch that has rows, with the line of each of them and the rows that begin one. The first n columns name the page."""
    page, anchor, line = None, None, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        out, starts = [], []
        for at, top in zip(zip(*(c.to_pylist() for c in batch.columns[:n]), strict=True), batch.column("top").to_pylist(), strict=True):
            if at != page:
                page, anchor, line = at, top, 0
                starts.append(len(out))
            elif top is not None and (anchor is None or abs(top - anchor) > tol):
                anchor, line = top, line + 1
                starts.append(len(out))
            out.append(line)
        yield batch, out, starts


def cells(lined: DataFrame, bounds: Column, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """keys, line, column, text: the words of each cell from left to right. bounds: an array, the same for all or one for each page."""
    own = lined.withColumn("column", column_of(F.col("x0"), F.col("x1"), bounds))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return own.groupBy(*keys, "line", "column").agg(joined.alias("text"))


def merge_continuation(rows: DataFrame, is_start: Column, columns: list[str], keys: list[str], order: str = "seq", joiner: str = " ") -> DataFrame:
    """Rows that do not start a record are appended, cell by cell, to the one before; the first row always starts one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("record", F.greatest(F.sum(F.coalesce(is_start, F.lit(False)).cast("int")).over(w), F.lit(1)))
    text = lambda c: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("t")))), lambda x: F.coalesce(x["t"], F.lit("")) != ""), lambda x: x["t"]), joiner)
    return own.groupBy(*keys, "record").agg(*[text(c).alias(c) for c in columns])


def carry_forward(rows: DataFrame, value: Column, keys: list[str], order: str = "seq", to: str = "carried") -> DataFrame:
    """rows with the last known value so far: a section, branch or year header holds until the next."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(w))


def fit(cells: Column, width: int, joiner: str = " ") -> Column:
    """An array of exactly width cells: padded with empty ones, or the surplus folded into the last."""
    short = F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), 1, width)
    folded = F.concat(F.slice(cells, 1, width - 1), F.array(F.array_join(F.slice(cells, width, F.greatest(F.size(cells) - width + 1, F.lit(0))), joiner)))
    return F.when(F.size(cells) <= width, short).otherwise(folded)


def legend(lines: DataFrame, column: str = "text") -> DataFrame:
    """code, meaning from lines like "ABC - text"."""
    rx = r"^\s*([A-Z]{2,6})\s+[-–]\s+(.+?)\s*$"
    return lines.where(F.col(column).rlike(rx)).select(F.regexp_extract(column, rx, 1).alias("code"), F.regexp_extract(column, rx, 2).alias("meaning"))


def identity_closure(rows: DataFrame, parts: list[str], total: str) -> DataFrame:
    """closed, checked: rows whose parts add up to the total, to two digits."""
    from functools import reduce

    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*parts, total]])
    closes = F.bround(reduce(lambda a, b: a + b, [F.col(c) for c in parts]), 2) == F.bround(total, 2)
    return rows.where(known).agg(F.count_if(closes).alias("closed"), F.count(F.lit(1)).alias("checked"))
