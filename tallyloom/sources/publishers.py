"""Publishers' tables after staging, as panels. Input columns are texts, as they come from cells and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import both_known_or, flag, harmonize_class, harmonize_status, iso_date, number, power_kw, strip, voltage
from ..functions.documents import date_in_name, stated_kva
from ..operators.layout import carry_forward
from ..operators.panel import finalize


def _keep(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("source_document", "_seq") if c in df.columns]


def slot_sheet(rows: DataFrame, publisher: str, jurisdiction: str) -> DataFrame:
    """Nodes for which the number of free connection slots is given (station, voltage, slots): no slot is a constraint; the capacity stays unknown."""
    slots = number(F.col("slots"))
    own = rows.where(strip(F.coalesce("station", F.lit(""))) != "").select(
        F.concat_ws("|", "station", "voltage").alias("node_id"), F.col("station").alias("node_name"), F.col("station").alias("location_text"), voltage(F.col("voltage")).alias("voltage_level"),
        (slots == 0).alias("constraint_flag"), slots.alias("_free_slots"), F.lit("NODE").alias("_entity"), *_keep(rows),
    )
    return finalize(own, publisher, jurisdiction)


def heat_map(rows: DataFrame, publisher: str, jurisdiction: str) -> DataFrame:
    """A heat map's sheet (station, voltage, available_mva, constrained, also_constrained, note, lat, lon). Unknown or no is unknown."""
    mva = number(F.col("available_mva"), ",", ".")
    own = rows.where(strip(F.coalesce("station", F.lit(""))) != "").select(
        F.col("station").alias("node_id"), F.col("station").alias("node_name"), F.col("station").alias("location_text"), voltage(F.col("voltage")).alias("voltage_level"),
        F.coalesce(mva * 1000, stated_kva(F.col("note"))).alias("capacity_available"), both_known_or(flag(F.col("constrained")), flag(F.col("also_constrained"))).alias("constraint_flag"),
        F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat_ws(",", "lat", "lon")).alias("coordinates"), F.lit("NODE").alias("_entity"), *_keep(rows),
    )
    return finalize(own, publisher, jurisdiction)


def wide_rows(rows: DataFrame, publisher: str, jurisdiction: str, width: int = 29) -> DataFrame:
    """Rows of exactly so many cells whose first is a code (cells: array of texts, Spanish numbers in MW): code, name, place, voltage, available, reserved. The date is in the document's name."""
    good = rows.where((F.size("cells") == width) & F.element_at("cells", 1).rlike(r"^[A-Z0-9]{3,}"))
    cell = lambda i: F.element_at("cells", i)
    mw = lambda i: number(cell(i), ".", ",") * 1000
    own = good.select(
        cell(1).alias("node_id"), cell(2).alias("node_name"), cell(3).alias("location_text"), voltage(cell(4)).alias("voltage_level"), mw(5).alias("capacity_available"), mw(6).alias("capacity_reserved"),
        date_in_name(F.col("source_document")).alias("date_published"), F.lit("NODE").alias("_entity"), *_keep(good),
    )
    return finalize(own, publisher, jurisdiction)


def listed_rows(rows: DataFrame, columns: dict[str, int], publisher: str, jurisdiction: str) -> DataFrame:
    """A ruled listing (cells, source_document, _seq): rows whose first cell is a number; columns names the cells (from 0)."""
    good = rows.where(F.regexp_replace(F.coalesce(F.element_at("cells", 1), F.lit("")), r"\.$", "").rlike(r"^\d+$"))
    cell = lambda c: F.get("cells", F.lit(columns[c])) if c in columns else F.lit(None).cast("string")
    kw = lambda c: power_kw(cell(c), "kW")
    own = good.select(
        F.coalesce(F.nullif(strip(cell("application_id")), F.lit("")), F.concat(F.lit(f"{publisher}:item:"), F.element_at("cells", 1))).alias("application_id"),
        cell("location_text").alias("location_text"), voltage(cell("voltage_level")).alias("voltage_level"), harmonize_class(cell("resource_class")).alias("resource_class"),
        kw("capacity_injected").alias("capacity_injected"), kw("capacity_withdrawn").alias("capacity_withdrawn"), harmonize_status(cell("process_status")).alias("process_status"), cell("refusal_reason").alias("refusal_reason"),
        *[iso_date(cell(c)).alias(c) for c in ("date_application", "date_conditions", "date_refusal", "date_agreement")], *_keep(good),
    )
    return finalize(own, publisher, jurisdiction)


def sections(lines: DataFrame, headings: dict[str, str], keys: tuple[str, ...] = ("source_document",), order: str = "seq") -> DataFrame:
    """lines (text) with the section that the last heading (name: pattern) opened; the headings themselves are dropped."""
    opened = None
    for name, rx in headings.items():
        hit = F.col("text").rlike(rx)
        opened = F.when(hit, F.lit(name)) if opened is None else opened.when(hit, F.lit(name))
    return carry_forward(lines.withColumn("_tl_open", opened), F.col("_tl_open"), list(keys), order, "section").where("_tl_open IS NULL").drop("_tl_open")


def node_tables(composition: DataFrame, values: DataFrame, publisher: str, jurisdiction: str) -> DataFrame:
    """Nodes from two tables: composition (source_document, seq, group_no, stations; rows with a branch name alone open a branch) and values (source_document, seq, cells; a row of three years or more names the columns). The nearest year is the available capacity; each year becomes a column of its own."""
    branch = F.when(F.col("group_no").isNull(), F.col("stations"))
    own = carry_forward(composition, branch, ["source_document"], "seq", "branch").where("group_no IS NOT NULL")
    groups = own.groupBy("group_no").agg(F.max_by(F.struct("stations", "branch"), "seq").alias("r")).select("group_no", "r.*")
    years = F.when(F.size(F.filter("cells", lambda x: x.rlike("^20[0-9]{2}$"))) >= 3, F.col("cells"))
    rows = carry_forward(values, years, ["source_document"], "seq", "years").where(F.element_at("cells", 1).rlike("^[0-9]+$") & F.col("years").isNotNull())
    each = rows.select(F.element_at("cells", 1).alias("group_no"), F.posexplode("cells").alias("i", "text"), "years").withColumn("year", F.get("years", F.col("i"))).where(F.col("year").rlike("^20[0-9]{2}$"))
    mw = each.select("group_no", "year", (number(F.col("text")) * 1000).alias("kw")).groupBy("group_no", "year").agg(F.max("kw").alias("kw"))
    names = [r["year"] for r in mw.select("year").distinct().orderBy("year").collect()]  # a handful of years
    wide = mw.groupBy("group_no").agg(*[F.max(F.when(F.col("year") == y, F.col("kw"))).alias(f"_capacity_available_{y}") for y in names], F.min_by("kw", "year").alias("capacity_available"))
    both = groups.join(wide, "group_no", "left")
    out = both.select(
        F.concat(F.lit(f"{publisher}:"), "group_no").alias("node_id"), F.col("stations").alias("location_text"), F.col("branch").alias("node_name"), "capacity_available",
        F.col("group_no").cast("int").alias("_group_no"), F.lit("NODE").alias("_entity"), *[f"_capacity_available_{y}" for y in names],
    )
    return finalize(out, publisher, jurisdiction)


def street_list(spark, path: str) -> DataFrame:
    """name, lat, lon from a JSON list of names or objects, a map of names, or either in a wrapper (streets, ulice)."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    inner = F.coalesce(F.try_variant_get("v", "$.streets", "variant"), F.try_variant_get("v", "$.ulice", "variant"), F.col("v"))
    text = raw.select(F.to_json(inner).alias("j"))
    entry = "struct<name:string,nazwa:string,lat:double,lon:double>"
    lists = text.where(F.col("j").startswith("[")).select(F.explode(F.from_json("j", T.ArrayType(T.StringType()))).alias("x"))
    made = F.from_json("x", entry)
    flat = lists.select(F.when(F.col("x").startswith("{"), F.coalesce(made["name"], made["nazwa"])).otherwise(F.col("x")).alias("name"), made["lat"].alias("lat"), made["lon"].alias("lon"))
    maps = text.where(F.col("j").startswith("{")).select(F.explode(F.from_json("j", "map<string,struct<lat:double,lon:double>>")).alias("name", "p"))
    return flat.unionByName(maps.select("name", "p.lat", "p.lon"))


def synthetic_editions(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two editions of a panel with _seq: rows leave, arrive, move on, fall back and are refused."""
    a = panel.where("_seq % 19 <> 0")
    status = F.when(F.col("_seq") % 13 == 1, "CONDITIONS_ISSUED").when(F.col("_seq") % 29 == 0, "UNDER_REVIEW").when(F.col("_seq") % 31 == 0, "REFUSED").otherwise(F.col("process_status"))
    return a, panel.where("_seq % 17 <> 3").withColumn("process_status", status)
