"""Written tables in the folder that driver and executors share, and positions in a total order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, one is set in local mode; elsewhere that is an error, since a folder of the driver's own would lose rows."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that the driver and all executors share is needed")
        found = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its rows are then the same however often they are read."""
    path = f"{shared_dir(df.sparkSession)}/tallyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], to: str = "rank") -> DataFrame:
    """df with the place of each row (from 1) in the order of the columns, without one task that sees all rows.

    Rows are dealt into ranges and sorted within them; a range's rows are counted, and the counts before it are its
    offset. Only the window over the counts, a row for each range, is one task. Rows that tie in all columns of order
    stand in any order; ranges are cut between them too, so equal rows do not meet in one task. An empty frame gives none.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = df.withColumn("_tl_row", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(parts, *order, F.col("_tl_row")).sortWithinPartitions(*order, "_tl_row").drop("_tl_row")
    dealt = written(dealt.withColumn("_tl_at", F.monotonically_increasing_id()), "numbered")
    # the upper bits of the id are the range, the lower ones the row within it
    part = F.shiftright("_tl_at", 33)
    runs = dealt.groupBy(part.alias("_tl_part")).agg(F.min("_tl_at").alias("_tl_from"), F.count(F.lit(1)).alias("_tl_n"))
    before = F.sum("_tl_n").over(Window.orderBy("_tl_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_tl_part", "_tl_from", F.coalesce(before, F.lit(0)).alias("_tl_before"))
    joined = dealt.withColumn("_tl_part", part).join(F.broadcast(runs), "_tl_part")  # a row for each range: spark.sql.shuffle.partitions at most
    return joined.withColumn(to, F.col("_tl_before") + F.col("_tl_at") - F.col("_tl_from") + 1).drop("_tl_part", "_tl_at", "_tl_from", "_tl_before")
