"""Stations, nodes and the load that applications put on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import station_name

ACTIVE = ("APPLICATION_FILED", "APPLICATION_INCOMPLETE", "UNDER_REVIEW", "CONDITIONS_ISSUED", "AGREEMENT_IN_FORCE")
LINE = r"(?iU)\b(w\s+lini(i|ach)|relacj(i|a)|odczep\s+z\s+lini)"


def node_rows(panel: DataFrame) -> DataFrame:
    """The panel's nodes: by its entity, or, where it has none, rows that state an available capacity."""
    if "_entity" in panel.columns:
        return panel.where(F.upper("_entity") == "NODE")
    return panel.where("capacity_available IS NOT NULL") if "capacity_available" in panel.columns else panel.limit(0)


def station_map(nodes: DataFrame, separator: str | None = ",") -> DataFrame:
    """group, node_name, station, station_norm, _seq: one row for each station of each node. nodes has _group_no, node_name, _seq and station or location_text."""
    own = nodes.withColumn("station", F.explode_outer(F.split("location_text", separator))) if "station" not in nodes.columns else nodes
    own = own.select(F.col("_group_no").alias("group"), "node_name", F.trim("station").alias("station"), station_name(F.col("station")).alias("station_norm"), "_seq").where("station_norm <> ''")
    return own.groupBy("group", "station_norm").agg(F.min_by(F.struct("node_name", "station"), "_seq").alias("r"), F.min("_seq").alias("_seq")).select("group", "r.node_name", "r.station", "station_norm", "_seq")


def assign(apps: DataFrame, stations: DataFrame, strict: bool = False) -> DataFrame:
    """apps with group, group_name and group_match: EXACT, EXTENDED, LINE, AMBIGUOUS or NONE.

    Containment is an equi-join too: the name's runs of words are exploded, of each length that a station name has. Distinct
    descriptions are matched once. A station in two groups whose nodes have the same name goes to the first group,
    unless strict.
    """
    sizes = sorted(r[0] for r in stations.select(F.size(F.split("station_norm", " "))).distinct().collect()) or [1]
    texts = apps.select("location_text").distinct().withColumn("_tl_norm", station_name(F.col("location_text")))
    open_texts = texts.where((F.col("_tl_norm") != "") & ~F.coalesce(F.col("location_text").rlike(LINE), F.lit(False)))

    def groups(hits: DataFrame) -> DataFrame:
        per = hits.groupBy("location_text").agg(
            F.array_sort(F.collect_list(F.struct("_seq", "group", "node_name"))).alias("h"),
        )
        ids, names = F.array_distinct(F.transform("h", lambda x: x["group"])), F.array_distinct(F.transform("h", lambda x: x["node_name"]))
        n = F.size(ids) if strict else F.least(F.size(ids), F.size(names))
        return per.select("location_text", n.alias("_tl_n"), F.get(ids, F.lit(0)).alias("group"), F.get(names, F.lit(0)).alias("group_name"))

    exact = groups(open_texts.join(stations, F.col("_tl_norm") == F.col("station_norm")))
    rest = open_texts.join(exact.select("location_text"), "location_text", "left_anti").withColumn("_tl_words", F.split("_tl_norm", " "))
    runs = rest.withColumn("_tl_from", F.explode(F.sequence(F.lit(1), F.size("_tl_words")))).withColumn("_tl_size", F.explode(F.array(*map(F.lit, sizes)))).where("_tl_from + _tl_size <= size(_tl_words) + 1")
    runs = runs.select("location_text", F.array_join(F.slice("_tl_words", F.col("_tl_from"), F.col("_tl_size")), " ").alias("_tl_run")).distinct()
    extended = groups(runs.join(stations, F.col("_tl_run") == F.col("station_norm")))
    found = exact.withColumn("_tl_how", F.lit("EXACT")).unionByName(extended.withColumn("_tl_how", F.lit("EXTENDED")))
    how = F.when(F.col("_tl_norm") == "", "NONE").when(F.coalesce(F.col("location_text").rlike(LINE), F.lit(False)), "LINE").when(F.col("_tl_n") > 1, "AMBIGUOUS").otherwise(F.coalesce("_tl_how", F.lit("NONE")))
    matched = texts.join(found, "location_text", "left").withColumn("group_match", how)
    single = F.col("group_match").isin("EXACT", "EXTENDED")
    matched = matched.select(F.col("location_text").alias("_tl_text"), F.when(single, F.col("group")).alias("group"), F.when(single, F.col("group_name")).alias("group_name"), "group_match")
    return apps.join(matched, apps["location_text"].eqNullSafe(F.col("_tl_text")), "left").drop("_tl_text")


def loading(apps: DataFrame, nodes: DataFrame, field: str = "capacity_injected", direction: str | None = None, voltage: str | None = None) -> DataFrame:
    """group, node_name, available, requested, applications, loading (null where nothing is available) and zero_capacity. apps is assigned."""
    direction = direction or ("generation" if "injected" in field else "demand")
    own = apps.where(F.col("process_status").isin(*ACTIVE) & F.col("group").isNotNull())
    if voltage is not None:
        own = own.where(F.coalesce(F.contains("voltage_level", F.lit(voltage)), F.lit(False)))
    asked = own.groupBy("group").agg(F.sum(field).alias("requested"), F.count(F.lit(1)).alias("applications"))
    base = nodes.where("capacity_available IS NOT NULL")
    if "_direction" in nodes.columns:
        base = base.where(F.col("_direction") == direction)
    base = base.select(F.col("_group_no").alias("group"), "node_name", F.col("capacity_available").alias("available"))
    out = base.join(asked, "group", "left").withColumns({"requested": F.coalesce("requested", F.lit(0.0)), "applications": F.coalesce("applications", F.lit(0))})
    return out.withColumns({"loading": F.try_divide(F.col("requested"), F.nullif("available", F.lit(0.0))), "zero_capacity": F.col("available") == 0})
