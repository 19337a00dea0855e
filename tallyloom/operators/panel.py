"""The panel: one row per register entry, 21 fields and three stamps; its core, validation and coverage."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import CLASSES, STATUSES, is_nullish


@dataclass(frozen=True)
class Field:
    name: str
    dtype: str
    group: str
    core: bool = False
    unit: str | None = None


# The fields of the panel in order.
FIELDS = (
    Field("application_id", "string", "identity", True),
    Field("node_id", "string", "identity"),
    Field("node_name", "string", "identity"),
    Field("location_text", "string", "identity", True),
    Field("coordinates", "geopoint", "identity", unit="WGS84"),
    Field("voltage_level", "string", "identity"),
    Field("resource_class", "string", "identity", True),
    Field("capacity_injected", "number", "capacity", unit="kW"),
    Field("capacity_withdrawn", "number", "capacity", unit="kW"),
    Field("capacity_available", "number", "capacity", unit="kW"),
    Field("capacity_reserved", "number", "capacity", unit="kW"),
    Field("constraint_flag", "boolean", "capacity"),
    Field("queue_position", "number", "capacity"),
    Field("process_status", "string", "process", True),
    Field("date_application", "date", "process"),
    Field("date_conditions", "date", "process"),
    Field("date_refusal", "date", "process"),
    Field("refusal_reason", "string", "process"),
    Field("date_agreement", "date", "process"),
    Field("date_energisation", "date", "process"),
    Field("date_published", "date", "process"),
)
STAMPS = ("publisher", "jurisdiction", "source_document")
_TYPES = {"string": T.StringType(), "geopoint": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}
SCHEMA = T.StructType([T.StructField(f.name, _TYPES[f.dtype], True, {"group": f.group, "core": f.core, "unit": f.unit or ""}) for f in FIELDS] + [T.StructField(s, T.StringType()) for s in STAMPS])
CORE = {
    "APPLICATION": (tuple(f.name for f in FIELDS if f.core), (("capacity_withdrawn", "capacity_injected"),)),
    "NODE": (("node_id",), (("capacity_available", "constraint_flag"),)),
}


def schema_table(spark: SparkSession) -> DataFrame:
    """The field catalogue, with each field's role in the core of both entities."""

    def status(name: str, entity: str) -> str:
        required, alternatives = CORE[entity]
        return "required" if name in required else "alternative" if any(name in g for g in alternatives) else "optional"

    rows = [(i, f.name, f.dtype, f.group, f.unit, status(f.name, "APPLICATION"), status(f.name, "NODE")) for i, f in enumerate(FIELDS)]
    return spark.createDataFrame(rows, "position int, field string, dtype string, group string, unit string, application string, node string")


def finalize(df: DataFrame, publisher: str, jurisdiction: str, document: str | None = None) -> DataFrame:
    """All fields in order, then the stamps, then extensions by name; fields that are missing are null."""
    fields = [F.col(f.name).cast(_TYPES[f.dtype]).alias(f.name) if f.name in df.columns else F.lit(None).cast(_TYPES[f.dtype]).alias(f.name) for f in FIELDS]
    source = F.lit(document) if document is not None else F.col("source_document") if "source_document" in df.columns else F.lit(None).cast("string")
    stamps = [F.lit(publisher).alias("publisher"), F.lit(jurisdiction).alias("jurisdiction"), source.alias("source_document")]
    return df.select(*fields, *stamps, *[F.col(c) for c in sorted(df.columns) if c.startswith("_")])


def union_panels(panels: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), panels)


def only_schema(df: DataFrame, keep_entity: bool = False) -> DataFrame:
    """The panel's own columns. Without the entity, nodes are taken for applications, as the plain export does."""
    own = [*(f.name for f in FIELDS), *STAMPS, *(["_entity"] if keep_entity else [])]
    return df.select(*[c for c in own if c in df.columns])


def entity(df: DataFrame) -> Column:
    return F.when(is_nullish(F.col("_entity")), "APPLICATION").otherwise(F.upper("_entity")) if "_entity" in df.columns else F.lit("APPLICATION")


def filled(df: DataFrame, name: str, kind: str = "core") -> Column:
    return ~is_nullish(F.col(name), kind) if name in df.columns else F.lit(False)


def core_complete(df: DataFrame) -> Column:
    """True where a row has what its entity requires; an unknown entity never has."""
    out = F.lit(False)
    for name, (required, alternatives) in CORE.items():
        own = reduce(lambda a, b: a & b, [filled(df, c) for c in required])
        for group in alternatives:
            own = own & reduce(lambda a, b: a | b, [filled(df, c) for c in group])
        out = F.when(entity(df) == name, own).otherwise(out)
    return out


def _bad_value(df: DataFrame, f: Field) -> Column | None:
    """Where a field's value is not of its kind; null if any value is."""
    c, text = F.col(f.name), F.col(f.name).cast("string")
    bad = None
    if f.dtype == "number":
        bad = text.try_cast("double").isNull() | (text.try_cast("double") < 0) if f.name != "queue_position" else text.try_cast("double").isNull()
    elif f.dtype == "date":
        bad = ~text.rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNull()
    elif f.dtype == "boolean":
        bad = ~F.lower(F.trim(text)).isin("true", "false", "tak", "nie", "0", "1")
    elif f.dtype == "geopoint":
        lat, lon = (F.get(F.split(text, ","), i).try_cast("double") for i in (0, 1))
        bad = ~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    return None if bad is None else ~is_nullish(c) & F.coalesce(bad, F.lit(True))


def outside_columns(df: DataFrame) -> list[str]:
    """Columns that are neither the schema's nor extensions, by name."""
    return sorted(c for c in df.columns if c not in SCHEMA.names and not c.startswith("_"))


def row_messages(df: DataFrame, strict: bool = False) -> Column:
    """What is wrong in a row, as an array of messages."""
    checks: list[tuple[Column, str]] = [(F.lit(True), f"outside the schema: {c}") for c in df.columns if c not in SCHEMA.names and not c.startswith("_")]
    checks += [(~filled(df, f.name), f"missing core field: {f.name}") for f in FIELDS if f.core]
    for f in FIELDS:
        bad = _bad_value(df, f) if f.name in df.columns else None
        if bad is not None:
            checks.append((bad, f"bad {f.dtype}: {f.name}"))
    if strict:
        checks += [(filled(df, c) & ~F.col(c).isin(*words), f"outside the vocabulary: {c}") for c, words in (("resource_class", CLASSES), ("process_status", STATUSES)) if c in df.columns]
    return F.filter(F.array(*[F.when(bad, F.lit(said)) for bad, said in checks]), lambda x: x.isNotNull())


def validation_report(df: DataFrame) -> DataFrame:
    """One row from one scan: n_rows, columns_outside, missing_core_columns, completion (share filled by field; 0 for fields that df lacks), violation_type (values not of their field's kind, by field where there are any), rows_with_complete_core. Values outside the vocabularies, of which there may be many, are rows of outside_vocabulary."""
    have = [f for f in FIELDS if f.name in df.columns]
    bad = {f.name: b for f in have if (b := _bad_value(df, f)) is not None}
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(core_complete(df)).alias("rows_with_complete_core"), *[F.count_if(filled(df, f.name)).alias(f"f_{f.name}") for f in have], *[F.count_if(b).alias(f"b_{c}") for c, b in bad.items()])
    share = lambda f: F.coalesce(F.round(F.try_divide(f"f_{f.name}", "n_rows"), 6), F.lit(0.0)) if f in have else F.lit(0.0)
    completion = F.map_from_arrays(F.array(*[F.lit(f.name) for f in FIELDS]), F.array(*[share(f) for f in FIELDS]))
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"b_{c}").alias("value")) for c in bad]) if bad else F.array().cast("array<struct<key:string,value:bigint>>")
    text = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    missing = [f.name for f in FIELDS if f.core and f.name not in df.columns]
    return one.select("n_rows", text(outside_columns(df)).alias("columns_outside"), text(missing).alias("missing_core_columns"), completion.alias("completion"), F.map_from_entries(F.filter(pairs, lambda x: x["value"] > 0)).alias("violation_type"), "rows_with_complete_core")


def completion_report(df: DataFrame) -> DataFrame:
    """field, n_filled, share for every field that df has: one scan."""
    names = [f.name for f in FIELDS if f.name in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(filled(df, c)).alias(c) for c in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_filled")) for c in names]))
    return one.select("n", pairs.alias("p")).select("p.field", "p.n_filled", F.round(F.try_divide("p.n_filled", "n"), 6).alias("share"))


def field_coverage(df: DataFrame, by: str = "publisher") -> DataFrame:
    """by, n, field, share of filled rows; the row without a group (is_total) is the whole panel."""
    names = [f.name for f in FIELDS if f.name in df.columns]
    flags = df.select(by, *[filled(df, c, "coverage").cast("int").alias(c) if c != by else F.col(c) for c in names])
    sums = flags.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"f_{c}") for c in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"f_{c}").alias("filled")) for c in names]))
    return sums.select(by, "is_total", "n", pairs.alias("p")).select(by, "is_total", "n", "p.field", F.round(F.try_divide("p.filled", "n"), 4).alias("share"))


def validate(df: DataFrame) -> DataFrame:
    """One row: rows, rows with a complete core, negative capacities, values outside the vocabularies."""
    out = [F.count(F.lit(1)).alias("n_rows"), F.count_if(core_complete(df)).alias("n_core")]
    capacities = [c for c in df.columns if c.startswith("capacity_")]
    negative = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in capacities], F.lit(False))
    out.append(F.count_if(negative).alias("n_negative"))
    for c, words in (("resource_class", CLASSES), ("process_status", STATUSES)):
        bad = filled(df, c) & ~F.coalesce(F.col(c).isin(*words), F.lit(False)) if c in df.columns else F.lit(False)
        out.append(F.count_if(bad).alias(f"n_bad_{c}"))
    return df.agg(*out)


def outside_vocabulary(df: DataFrame) -> DataFrame:
    """field, value, n: values of the controlled fields that are not in their vocabulary, a row for each."""
    checks = [F.when(filled(df, c) & ~F.coalesce(F.col(c).isin(*known), F.lit(False)), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))) for c, known in (("resource_class", CLASSES), ("process_status", STATUSES)) if c in df.columns]
    empty = F.array().cast("array<struct<field:string,value:string>>")
    found = df.select(F.explode(F.array_compact(F.array(*checks)) if checks else empty).alias("v"))
    return found.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select("v.field", "v.value", "n").orderBy("field", "value")


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, publishers, fields of the schema with any value, rows with a complete core."""
    publishers = F.count_distinct("publisher") if "publisher" in df.columns else F.lit(0)
    seen = [F.max(filled(df, f.name, "coverage").cast("int")) for f in FIELDS if f.name in df.columns]
    fields = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in seen], F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), publishers.cast("long").alias("n_publishers"), fields.cast("long").alias("n_fields_filled"), F.count_if(core_complete(df)).alias("n_core"))
