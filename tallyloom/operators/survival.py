"""Censored processing times and Kaplan-Meier estimates, all groups in one plan."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def processing_time(df: DataFrame, start: str = "date_application", end: str = "date_conditions", as_at: str | None = None) -> DataFrame:
    """df with time_days, event (1, 0, or null without a start) and as_at. An open case is censored at its row's own publication date, else the latest of the applications, else the latest end; negative times are unknown."""
    if as_at is not None:
        out = df.withColumn("as_at", F.lit(as_at).cast("date"))
    else:
        own = F.col("date_published") if "date_published" in df.columns else F.lit(None).cast("date")
        app = F.upper(F.coalesce("_entity", F.lit("APPLICATION"))) != "NODE" if "_entity" in df.columns else F.lit(True)
        one = df.agg(F.coalesce(F.max(F.when(app, own)), F.max(end)).alias("_tl_last"))
        out = df.crossJoin(F.broadcast(one)).withColumn("as_at", F.coalesce(own, "_tl_last")).drop("_tl_last")
    days = F.datediff(F.coalesce(F.col(end), F.col("as_at")), F.col(start))
    ok = F.col(start).isNotNull() & F.coalesce(days >= 0, F.lit(True))
    return out.withColumns({"time_days": F.when(ok, days), "event": F.when(ok, F.col(end).isNotNull().cast("int"))})


def group_key(by: list[str] | None) -> Column:
    return F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("(empty)")) for c in by]) if by else F.lit("all")


def km_table(timed: DataFrame, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """group, t, n_at_risk, events, S, S_lower, S_upper, with n and the censored of the group.

    Rows are summed by time first, so a window sees one row for each distinct day of a group, whatever the register's size.
    """
    z = NormalDist().inv_cdf(1 - alpha / 2)
    known = timed.where("time_days >= 0 AND event IS NOT NULL").withColumn("group", group_key(by))
    days = known.groupBy("group", F.col("time_days").alias("t")).agg(F.sum("event").alias("events"), F.count(F.lit(1)).alias("rows"))
    own, later, so_far = Window.partitionBy("group"), Window.partitionBy("group").orderBy(F.desc("t")), Window.partitionBy("group").orderBy("t")
    risk = days.select("group", "t", "events", F.sum("rows").over(own).alias("n"), F.sum("events").over(own).alias("n_events"), F.sum("rows").over(later).alias("n_at_risk"))
    d, r = F.col("events"), F.col("n_at_risk")
    steps = risk.where("events > 0").withColumn("S", F.product(1 - d / r).over(so_far)).withColumn("_tl_v", F.sum(F.when(r > d, d / (r * (r - d))).otherwise(0.0)).over(so_far))
    se = F.when(F.col("S") > 0, F.col("S") * F.sqrt("_tl_v")).otherwise(0.0)
    return steps.select("group", "t", "n_at_risk", "events", "S", F.greatest(F.lit(0.0), F.col("S") - z * se).alias("S_lower"), F.least(F.lit(1.0), F.col("S") + z * se).alias("S_upper"))


def km_summary(timed: DataFrame, by: list[str] | None = None, min_n: int = 0, alpha: float = 0.05, max_groups: int | None = None) -> DataFrame:
    """group, n, events, censored, censored_share, median and its interval, for groups of at least min_n rows, the largest first (ties by name); max_groups keeps the first of them, as a chart does."""
    known = timed.where("time_days >= 0 AND event IS NOT NULL").withColumn("group", group_key(by))
    sizes = known.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events")).where(F.col("n") >= min_n)
    first = lambda c: F.min(F.when(F.col(c) <= 0.5, F.col("t"))).cast("double")
    medians = km_table(timed, by, alpha).groupBy("group").agg(first("S").alias("median"), first("S_lower").alias("median_lower"), first("S_upper").alias("median_upper"))
    censored = F.col("n") - F.col("events")
    ordered = sizes.join(medians, "group", "left").select("group", "n", "events", censored.alias("censored"), F.round(censored / F.col("n"), 6).alias("censored_share"), "median", "median_lower", "median_upper").orderBy(F.desc("n"), "group")
    return ordered if max_groups is None else ordered.limit(max_groups)


def date_coverage(df: DataFrame, start: str = "date_application", end: str = "date_conditions") -> DataFrame:
    """One row, n and coverage: the share of applications with a date, of the two dates the lesser."""
    share = lambda c: F.coalesce(F.try_divide(F.count(c), F.count(F.lit(1))), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    app = df.where(F.coalesce(F.upper("_entity"), F.lit("APPLICATION")) != "NODE") if "_entity" in df.columns else df
    return app.agg(F.count(F.lit(1)).alias("n"), F.least(share(start), share(end)).alias("coverage"))


def complete_case_medians(timed: DataFrame, by: list[str], min_n: int = 30) -> DataFrame:
    """by, n and the quartiles of the closed cases."""
    q = F.percentile("time_days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return timed.where("event = 1").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), q.alias("q")).where(F.col("n") >= min_n).select(*by, "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def sorted_medians(timed: DataFrame, by: tuple[str, ...] = ("publisher", "resource_class"), min_n: int = 30) -> DataFrame:
    """The table of complete_case_medians, by the first column, then from the shortest median to the longest, ties by name."""
    return complete_case_medians(timed, list(by), min_n).orderBy(by[0], "median", *by[1:])
