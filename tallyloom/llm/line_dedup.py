"""Cross-site removal of repeated lines, with DataFrame functions only.

The sites of every line hash are gathered in HyperLogLog sketches, which merge as partial aggregates, so a line on a
third of all rows costs each task one sketch. Lines whose estimate is within MARGIN of the threshold get exact distinct
counts; the others are decided by the sketch. Lines found on MIN_SITES sites or more are boilerplate and go.

Hashes only find candidates: lines are removed by their text. The texts of a hash that goes are told by their least and
greatest; where those differ, which is once in 2^64 pairs of lines, each text is counted on its own.

Cases: null text is empty; blank lines stay; lines are compared without white space at their ends; a null site is no
site; rows that share doc_id and text are cleaned alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, small

MIN_SITES = 10
#: Relative deviation of the sketches, and how many of them the exact range spans on each side.
DEVIATION, SPAN = 0.05, 4


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Of lines (line hash, site), the hashes on min_sites sites or more."""
    sketched = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("site", DEVIATION).alias("sites"))
    margin = 1 + SPAN * DEVIATION
    # fewer occurrences than sites wanted is a certain no
    sketched = materialize(sketched.where((F.col("n") >= min_sites) & (F.col("sites") * margin >= min_sites)), "sketches")
    sure = F.col("sites") > min_sites * margin + 1
    near = sketched.where(~sure).select("line")
    exact = lines.join(small(materialize(near, "near")), "line", "left_semi").distinct().groupBy("line").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return sketched.where(sure).select("line").unionAll(exact.select("line"))


def _texts(lines: DataFrame, gone: DataFrame, min_sites: int) -> DataFrame:
    """line, key: the texts of the hashes in gone that are on min_sites sites or more. lines: line, key, site."""
    told = lines.join(gone, "line").groupBy("line").agg(F.min("key").alias("key"), F.max("key").alias("_tl_last"))
    told = materialize(told, "texts")
    shared = told.where("key <> _tl_last").select("line")
    exact = lines.join(small(shared), "line", "left_semi").distinct().groupBy("line", "key").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return told.where("key = _tl_last").select("line", "key").unionAll(exact.select("line", "key"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Of each row: doc_id, n_lines, n_removed, and text without boilerplate lines."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(site_col).cast("string").alias("site"))
    lines = rows.select("doc_id", "text", "site", F.explode_outer(F.split("text", "\n")).alias("row")).where(F.btrim("row", F.lit(" \t\r")) != "")
    keyed_lines = lines.select(_key(F.col("row")).alias("line"), F.btrim("row", F.lit(" \t\r")).alias("key"), "site")
    gone = small(materialize(boilerplate(keyed_lines.select("line", "site"), min_sites), "boilerplate"))
    gone = small(materialize(_texts(keyed_lines, gone, min_sites), "removed"))
    hits = lines.select("doc_id", F.xxhash64("text").alias("fp"), _key(F.col("row")).alias("line"), F.btrim("row", F.lit(" \t\r")).alias("key")).join(gone, ["line", "key"])
    hits = hits.groupBy("doc_id", "fp").agg(F.collect_set("key").alias("gone"))
    keyed = rows.withColumn("fp", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(hits["doc_id"]) & (keyed["fp"] == hits["fp"])
    joined = keyed.join(hits, same, "left").select(keyed["doc_id"], "text", "gone")
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.btrim(x, F.lit(" \t\r"))))
    done = joined.withColumn("kept", F.when(F.col("gone").isNull(), F.split("text", "\n")).otherwise(kept))
    n = F.size(F.split("text", "\n"))
    return done.select("doc_id", n.cast("long").alias("n_lines"), (n - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("text"))
