"""The tidy tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import numbered
from .editions import STATUS_ORDER
from .panel import filled


def applications(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.upper("_entity"), F.lit("APPLICATION")) != "NODE") if "_entity" in df.columns else df


def capacity_by_class(df: DataFrame, top: int = 5) -> DataFrame:
    """resource_class, hue (voltage level; beyond the top ones by capacity "other levels"), mw, applications."""
    injected = F.when(F.col("capacity_injected") > 0, F.col("capacity_injected")).otherwise(F.coalesce("capacity_withdrawn", F.lit(0.0)))
    each = applications(df).groupBy("resource_class", F.coalesce("voltage_level", F.lit("(empty)")).alias("level")).agg((F.sum(injected) / 1000).alias("mw"), F.count(F.lit(1)).alias("applications"))
    rank = each.groupBy("level").agg(F.sum("mw").alias("all_mw")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("all_mw"), "level"))).select("level", "rank")
    hue = F.when(F.col("rank") <= top, F.col("level")).otherwise("other levels")
    return each.join(rank, "level").groupBy("resource_class", hue.alias("hue")).agg(F.sum("mw").alias("mw"), F.sum("applications").alias("applications"))


def status_distribution(df: DataFrame, by: str = "publisher") -> DataFrame:
    """group, status, order, n, share within the group."""
    counts = applications(df).groupBy(F.coalesce(by, F.lit(f"({by} not set)")).alias("group"), F.coalesce("process_status", F.lit("UNSPECIFIED")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    order = F.create_map(*[F.lit(x) for kv in STATUS_ORDER.items() for x in kv])[F.col("status")]
    return counts.withColumns({"order": F.coalesce(order, F.lit(len(STATUS_ORDER))), "share": F.round(F.col("n") / F.sum("n").over(Window.partitionBy("group")), 6)})


def location_category(geocoded: DataFrame) -> DataFrame:
    """category, n of a geocoded panel."""
    c, a, r = F.col("_geo_confidence"), F.col("_geo_accuracy"), F.col("_geo_reason")
    category = (
        F.when(c == "SOURCE", "source coordinates").when(a == "ADDRESS_POINT", "address point").when(a == "LOCALITY_CENTROID", "locality only").when(a == "INTERSECTION_POINT", "street crossing").when(a == "STREET_AXIS_POINT", "street point").when(a == "NO_GEOMETRY", "street without geometry")
        .when(r == "empty_description", "no description").when(r == "station_code_without_dictionary", "station code").when(r == "verbal_description_not_street_name", "verbal description").otherwise("unresolved")
    )
    return geocoded.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def loading_bars(loaded: DataFrame, label: int = 12) -> DataFrame:
    """rank, node_name, loading, labelled: nodes with a known loading, largest first."""
    ranked = numbered(loaded.where("loading IS NOT NULL"), [F.desc("loading"), F.col("group")])
    return ranked.select("rank", "node_name", "loading", (F.col("rank") <= label).alias("labelled"))


def quality_chart(by_publisher: DataFrame) -> DataFrame:
    """code, group, violations, total, place of rules by publisher (see quality_by_publisher): a rule that failed counts as none, rules with the most violations come first, ties by code."""
    own = by_publisher.select("code", F.coalesce("publisher", F.lit("(publisher not set)")).alias("group"), F.greatest("violations", F.lit(0)).cast("long").alias("violations"))
    total = own.groupBy("code").agg(F.sum("violations").alias("total"))
    placed = total.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "code")).cast("long"))  # a row for each rule
    return own.join(F.broadcast(placed), "code")


def loading_title(loaded: DataFrame) -> DataFrame:
    """n nodes, of which without capacity, the median loading, and how many above one."""
    return loaded.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("zero_capacity").alias("zero"), F.median("loading").alias("median"), F.count_if(F.col("loading") > 1).alias("above_one"))


def edition_flows(compared: DataFrame) -> DataFrame:
    """segment, edition, n from a comparison's one row."""
    s = [("shared", "both", "shared"), ("gone", "a", "gone"), ("new", "b", "new"), ("repeated", "a", "rows_a"), ("repeated", "b", "rows_b")]
    value = {"rows_a": F.col("rows_a") - F.col("unique_a"), "rows_b": F.col("rows_b") - F.col("unique_b")}
    return compared.select(F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(e).alias("edition"), value.get(c, F.col(c)).alias("n")) for n, e, c in s])).alias("p")).select("p.*")


def chart_inclusion(df: DataFrame, min_n: int = 30, min_coverage: float = 0.8) -> DataFrame:
    """chart, reason: which charts the panel supports; the reason why not is null for those it does. One scan.

    The curves of processing times need both dates in a share of min_coverage of the applications, and min_n of them
    with a first date; node loading needs nodes and applications.
    """
    app = (F.coalesce(F.upper("_entity"), F.lit("APPLICATION")) != "NODE") if "_entity" in df.columns else F.lit(True)
    some = {f"any_{c}": F.coalesce(F.bool_or(app & filled(df, c)), F.lit(False)) for c in ("process_status", "resource_class")}
    dates = {f"n_{c}": F.count_if(app & filled(df, c)) for c in ("date_application", "date_conditions")}
    one = df.agg(F.count_if(app).alias("n_app"), F.count_if(~app).alias("n_node"), *[v.alias(k) for k, v in {**some, **dates}.items()])
    coverage = F.coalesce(F.try_divide(F.least("n_date_application", "n_date_conditions"), "n_app"), F.lit(0.0))
    times = F.when(coverage < min_coverage, F.format_string(f"date coverage %.1f%% is below the {min_coverage * 100:.0f}%% inclusion criterion", coverage * 100)).when(F.col("n_date_application") < min_n, f"no group of {min_n} applications with date_application")
    capacity = F.lit("capacity_available" in df.columns)
    reasons = {
        "field_coverage": F.lit(None).cast("string"),
        "quality_rules": F.lit(None).cast("string"),
        "column_shift": F.lit(None).cast("string"),
        "status_distribution": F.when(~F.col("any_process_status"), "no process status disclosed"),
        "capacity_by_class": F.when(~F.col("any_resource_class"), "no resource class disclosed"),
        "processing_time": times,
        "location_resolution": F.lit(None if "coordinates" in df.columns else "no coordinates").cast("string"),
        "node_loading": F.when(~capacity | (F.col("n_node") == 0) | (F.col("n_app") == 0), "needs both node rows and application rows"),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("chart"), v.alias("reason")) for k, v in reasons.items()])).alias("c")).select("c.*")


def chart_tables(df: DataFrame, min_n: int = 30, min_coverage: float = 0.8, edition_b: DataFrame | None = None) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """The tables of all charts that the panel supports, by chart, and (chart, reason) of the others. With edition_b also those that compare it with df, the earlier edition."""
    from . import editions, nodes, panel, quality, survival

    # a row for each chart
    reasons = {r["chart"]: r["reason"] for r in chart_inclusion(df, min_n, min_coverage).collect()}

    def loads() -> DataFrame:
        own = nodes.node_rows(df).withColumn("_seq", F.col("_seq") if "_seq" in df.columns else F.monotonically_increasing_id())
        return loading_bars(nodes.loading(nodes.assign(applications(df), nodes.station_map(own)), own))

    made = {
        "field_coverage": lambda: panel.field_coverage(df),
        "quality_rules": lambda: quality.quality_sums(df),
        "column_shift": lambda: quality.column_shift(df),
        "status_distribution": lambda: status_distribution(df),
        "capacity_by_class": lambda: capacity_by_class(df),
        "processing_time": lambda: survival.km_table(survival.processing_time(applications(df)), ["resource_class"]),
        "location_resolution": lambda: location_category(df),
        "node_loading": loads,
    }
    skipped = [(c, r) for c, r in reasons.items() if r is not None]
    if "_geo_confidence" not in df.columns and reasons.get("location_resolution") is None:
        reasons["location_resolution"] = "not geocoded"
        skipped.append(("location_resolution", "not geocoded"))
    if "_group_no" not in df.columns and reasons.get("node_loading") is None:
        reasons["node_loading"] = "nodes have no group"
        skipped.append(("node_loading", "nodes have no group"))
    tables = {c: f() for c, f in made.items() if reasons.get(c) is None}
    if edition_b is not None:
        tables["edition_flows"] = edition_flows(editions.compare(df, edition_b))
        tables["edition_transitions"] = editions.transitions(df, edition_b)
        tables["linkage_recall"] = editions.linkage_recall(df, edition_b)
    return tables, skipped


def save_all(df: DataFrame, path: str, min_n: int = 30, min_coverage: float = 0.8, edition_b: DataFrame | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """Write every chart's table as Parquet under path; the charts written, and those skipped with the reason."""
    tables, skipped = chart_tables(df, min_n, min_coverage, edition_b)
    for chart, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{chart}")
    return sorted(tables), skipped
