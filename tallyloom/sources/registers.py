"""Sources: publishers' files to panels. CSV is read by Spark; spreadsheets and PDFs come as staging tables.

Staging tables: cells(sheet, row, col, text) and words(page, text, x0, x1, top, bottom). cells_of_xlsx() fills the first
from .xlsx files with the standard library; the second comes from any PDF tool. Everything after staging is plans.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import flag, harmonize_class, harmonize_status, iso_date, known_or, number, power_kw, quarter_end, split_sum_kw, strip, voltage
from ..operators.panel import finalize, union_panels
from . import workbook


def spans_lines(spark: SparkSession, path: str, quote: str = '"') -> bool:
    """Whether a quoted field of an export holds a line feed: a record spans lines if and only if some line has an odd number of quotes. One scan, cut like any text."""
    odd = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    return not spark.read.text(path).where(odd % 2 == 1).isEmpty()


def read_export(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as text, names without a byte-order mark, _seq in file order within a file. A file is cut into tasks unless a quoted field holds a line feed, which would need the whole file to be read in order."""
    whole = spans_lines(spark, path)
    df = spark.read.csv(path, header=True, sep=sep, multiLine=whole, enforceSchema=False, escape='"')
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    # where in the file a block begins, and the row within the task: the same if a task is run again. A task has fewer rows than bytes, and no more bytes than a block, so blocks keep their order
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return df.withColumns({"source_document": F.col("_metadata.file_name"), "_seq": F.col("_metadata.file_block_start") + row})


def _first(df: DataFrame, *names: str) -> Column:
    """The first of the columns that the file has; null if none."""
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def queue_panel(df: DataFrame) -> DataFrame:
    """A connection-queue export (capacities in MW, one row a machine) as a panel. A missing flag counts as no."""
    mw = lambda *names: power_kw(_first(df, *names).cast("string"), "MW")
    yes = lambda *names: flag(F.nullif(_first(df, *names).cast("string"), F.lit("")))
    own = df.select(
        F.concat_ws("/", _first(df, "Application ID").cast("string"), _first(df, "Machine ID").cast("string")).alias("application_id"),
        _first(df, "Bus Number", "GSP").cast("string").alias("node_id"),
        _first(df, "Bus Name", "GSP").alias("node_name"),
        F.concat_ws(", ", _first(df, "Licence Area"), _first(df, "GSP")).alias("location_text"),
        harmonize_class(_first(df, "Fuel type", "Fuel Type")).alias("resource_class"),
        F.coalesce(mw("Machine Export Capacity (MW)"), mw("Site Export Capacity (MW)")).alias("capacity_injected"),
        F.coalesce(mw("Machine Import Capacity (MW)"), mw("Site Import Capacity (MW)")).alias("capacity_withdrawn"),
        known_or(yes("TANM"), yes("DANM")).alias("constraint_flag"),
        _first(df, "Position").cast("string").try_cast("double").alias("queue_position"),
        harmonize_status(_first(df, "Status")).alias("process_status"),
        *[F.col(c) for c in ("source_document", "_seq") if c in df.columns],
    )
    return finalize(own, "queue", "UK")


# The portal's columns of reception capacity with the voltage level that each stands for, from the highest, and its kinds of installation.
PORTAL_LEVELS = {
    "capacidade_de_recepcao_at_mva_ultimo_trimestre": "AT",
    "capacidade_de_recepcao_mt_30kv_mva_ultimo_trimestre": "30 kV",
    "capacidade_de_recepcao_mt_15kv_mva_ultimo_trimestre": "15 kV",
    "capacidade_de_recepcao_mt_10kv_mva_ultimo_trimestre": "10 kV",
}
PORTAL_KINDS = {"SE AT": "substation_HV", "PC AT": "cutting_point_HV"}


def portal_panel(df: DataFrame) -> DataFrame:
    """A portal's node export (semicolons, technical headers, quarter as 2T2026) as a panel of nodes.

    Its capacities are MVA, which are no kW without a power factor: they stay in extension columns, and the panel's own
    capacities are null. A reception capacity of zero is a constraint; an unknown one is neither yes nor no.
    """
    n = lambda name: number(_first(df, name))
    text = lambda name: F.nullif(strip(_first(df, name)), F.lit(""))
    capacity = n("capacidade_de_recepcao_mt_at_mva_ultimo_trimestre")
    kind = text("tipo_de_instalacao")
    named = F.lit(None).cast("string")
    for said, meant in PORTAL_KINDS.items():
        named = F.when(kind == said, meant).otherwise(named)
    own = df.select(
        text("codigo").alias("node_id"),
        text("instalacao").alias("node_name"),
        text("grupo_de_subestacoes_rari").alias("location_text"),
        F.nullif(F.concat_ws(", ", *[F.when(n(c) > 0, level) for c, level in PORTAL_LEVELS.items()]), F.lit("")).alias("voltage_level"),
        (capacity == 0).alias("constraint_flag"),
        quarter_end(F.upper(text("data_ultimo_trimestre"))).alias("date_published"),
        F.lit("NODE").alias("_entity"),
        F.lit("MVA").alias("_source_capacity_unit"),
        capacity.alias("_capacity_available_mva"),
        n("potencia_de_ligacao_ligado_mva_ultimo_trimestre").alias("_capacity_connected_mva"),
        n("potencia_de_ligacao_comprometido_mva_ultimo_trimestre").alias("_capacity_contracted_mva"),
        n("potencia_de_ligacao_em_confirmacao_mva_ultimo_trimestre").alias("_capacity_being_confirmed_mva"),
        F.coalesce(named, kind).alias("_installation_type"),
        text("distrito").alias("_district"),
        text("concelho").alias("_municipality"),
        text("nut3").alias("_nuts3"),
        text("ligacao_rnt_barramento_60kv_ultimo_trimestre").alias("_rnt_node"),
        *[F.col(c) for c in ("source_document", "_seq") if c in df.columns],
    )
    return finalize(own, "portal", "PT")


def template_panel(raw: DataFrame, publisher: str, jurisdiction: str) -> DataFrame:
    """The common application template (object_id, item_no, location, voltage, resource, power_in, power_out, status, date_*; texts) as a panel. An entry without an id gets one from its number, or from its place in the document."""
    place = F.row_number().over(Window.partitionBy("source_document").orderBy("_seq")) if {"source_document", "_seq"} <= set(raw.columns) else F.lit(1)
    item = F.nullif(F.rtrim(_first(raw, "item_no"), F.lit(".")), F.lit(""))
    dates = [iso_date(_first(raw, c)).alias(c) for c in ("date_application", "date_conditions", "date_refusal", "date_agreement", "date_energisation", "date_published")]
    own = raw.select(
        F.coalesce(F.nullif(strip(_first(raw, "object_id")), F.lit("")), F.concat(F.lit(f"{publisher}:item:"), F.coalesce(item, place.cast("string")))).alias("application_id"),
        _first(raw, "location").alias("location_text"),
        voltage(_first(raw, "voltage")).alias("voltage_level"),
        harmonize_class(_first(raw, "resource")).alias("resource_class"),
        split_sum_kw(_first(raw, "power_out")).alias("capacity_injected"),
        split_sum_kw(_first(raw, "power_in")).alias("capacity_withdrawn"),
        harmonize_status(_first(raw, "status")).alias("process_status"),
        _first(raw, "reason").alias("refusal_reason"),
        *dates,
        *[F.col(c) for c in ("source_document", "_seq") if c in raw.columns],
    )
    return finalize(own, publisher, jurisdiction)


@dataclass(frozen=True)
class Source:
    """A publisher: the pattern of its paths (lower case) and its reader."""

    pattern: str
    read: Callable[[SparkSession, str], DataFrame]


REGISTRY: dict[str, Source] = {
    "queue": Source(r"queue|ecr", lambda spark, path: queue_panel(read_export(spark, path, ","))),
    "portal": Source(r"portal|capacidade|e.?redes|\brnd\b", lambda spark, path: portal_panel(read_export(spark, path, ";"))),
}


def detect(path: str) -> str | None:
    """The first source whose pattern occurs in the path."""
    return next((k for k, s in REGISTRY.items() if re.search(s.pattern, path.lower())), None)


def detect_column(path: Column) -> Column:
    out = None
    for key, source in REGISTRY.items():
        hit = F.lower(path).rlike(source.pattern)
        out = F.when(hit, F.lit(key)) if out is None else out.when(hit, F.lit(key))
    return out


def read_sources(spark: SparkSession, paths: list[str], source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The panel of all files, and a report by document: rows and publication dates. An unknown file is named before any is read."""
    keys = [source or detect(p) for p in paths]
    for path, key in zip(paths, keys, strict=True):
        if key not in REGISTRY:
            raise ValueError(f"no source is known for {path}")
    panel = union_panels([REGISTRY[k].read(spark, p) for p, k in zip(paths, keys, strict=True)])
    report = panel.groupBy("publisher", "source_document").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("date_published")).alias("dates"))
    return panel, report


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.lower().endswith((".parquet", ".pq")) else spark.read.csv(path, header=True)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, JSON lines or CSV by the path's ending; one folder of part files."""
    kind = "parquet" if path.endswith((".parquet", ".pq")) else "json" if path.endswith((".json", ".jsonl")) else "csv"
    df.write.mode("overwrite").format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)


def _cells(data: bytes) -> Iterator[tuple[str, int, int, str, str]]:
    """(sheet, row, column, text, superscript) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name, part in workbook.sheets(z):
            for cell in workbook.cells(z, part):
                yield name, *cell


def cells_of_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """document, sheet, row, col, text, sup of .xlsx files: a workbook is read by the task that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, *c) for c in _cells(data)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], ["document", "sheet", "row", "col", "text", "sup"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "document string, sheet string, row int, col int, text string, sup string")


def sheet_rows(cells: DataFrame, header: Column, columns: dict[int, str], within: int = 12) -> DataFrame:
    """Rows below the first row (of the first so many) where header is true for a cell; columns by number become named texts."""
    head = cells.where(header & (F.col("row") <= within)).groupBy("document", "sheet").agg(F.min("row").alias("head"))
    body = cells.join(head, ["document", "sheet"]).where("row > head")
    wide = body.groupBy("document", "sheet", "row").agg(*[F.max(F.when(F.col("col") == n, F.col("text"))).alias(c) for n, c in columns.items()])
    return wide.withColumns({"source_document": F.col("document"), "_seq": F.col("row").cast("long")}).drop("document", "row")


def vocabulary(cells: DataFrame) -> DataFrame:
    """document, col, header, values of columns with two entries or more."""
    own = cells.groupBy("document", "sheet", "col").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("c")).where("size(c) >= 2")
    return own.select("document", "col", F.col("c")[0]["text"].alias("header"), F.transform(F.slice("c", 2, F.size("c")), lambda x: x["text"]).alias("values"))


def manifest_check(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """name, state: files against a manifest (name, sha256): matching, different, missing or unlisted."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    both = manifest.select("name", F.lower("sha256").alias("sha256")).join(files, "name", "full_outer")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("found") == F.col("sha256"), "matching").otherwise("different")
    return both.select("name", state.alias("state"))


# The first bytes of documents, by the ending of their names.
SIGNATURES = {"pdf": "25504446", "xlsx": "504B0304", "zip": "504B0304"}


def document_signatures(spark: SparkSession, path: str) -> DataFrame:
    """name, ending, sound: whether a file begins as its ending says; an error page under a document's name does not. Files of other endings are sound if they are not markup. Spark's reader leaves empty files out, so they have no row; manifest_check then names them missing."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.substring("content", 1, 512).alias("head"))
    ending = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    first = F.create_map(*[F.lit(x) for kv in SIGNATURES.items() for x in kv])
    markup = F.lower(F.ltrim(F.decode("head", "ISO-8859-1"))).rlike("^(<!doctype|<html)")
    signed = F.hex(F.substring("head", 1, 4)) == F.element_at(first, ending)
    return files.select("name", ending.alias("ending"), F.coalesce(signed, ~markup).alias("sound"))


def gazetteer_json(spark: SparkSession, path: str) -> DataFrame:
    """locality, name, lat, lon, length_m, axis from a nested JSON gazetteer; older key names are understood too. An axis is a list of [lat, lon]."""
    entry = "struct<lat:double,lon:double,length_m:double,dlugosc_m:double,axis:array<array<double>>,os:array<array<double>>>"
    place = f"struct<streets:map<string,{entry}>,ulice:map<string,{entry}>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"localities map<string,{place}>, miejscowosci map<string,{place}>").alias("j"))
    each = raw.select(F.explode(F.coalesce("j.localities", "j.miejscowosci")).alias("locality", "p")).select("locality", F.explode(F.coalesce("p.streets", "p.ulice")).alias("name", "e"))
    axis = F.transform(F.coalesce("e.axis", "e.os"), lambda p: F.struct(F.get(p, F.lit(0)).alias("lat"), F.get(p, F.lit(1)).alias("lon")))
    return each.select("locality", "name", "e.lat", "e.lon", F.coalesce("e.length_m", "e.dlugosc_m").alias("length_m"), axis.alias("axis"))


def synthetic_panel(spark: SparkSession, n: int = 600, seed: int = 7) -> DataFrame:
    """n made-up applications; the same for the same seed."""
    u = lambda k: F.abs(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)) % 10_000) / 10_000
    start = F.date_add(F.lit("2022-01-01").cast("date"), (u(1) * 900).cast("int"))
    cls = F.element_at(F.array(*[F.lit(x) for x in ("PV", "WIND", "BESS", "LOAD")]), (u(2) * 4).cast("int") + 1)
    done = u(3) < 0.7
    own = spark.range(n).select(
        F.concat(F.lit("syn:"), F.col("id").cast("string")).alias("application_id"), F.concat(F.lit("site "), (F.col("id") % 40).cast("string")).alias("location_text"),
        F.when(u(4) < 0.5, "110 kV").otherwise("SN").alias("voltage_level"), cls.alias("resource_class"), F.when(cls == "LOAD", None).otherwise(F.round(u(5) * 9000 + 100)).alias("capacity_injected"),
        F.when(cls == "LOAD", F.round(u(5) * 9000 + 100)).alias("capacity_withdrawn"), F.when(done, "CONDITIONS_ISSUED").otherwise("UNDER_REVIEW").alias("process_status"),
        start.alias("date_application"), F.when(done, F.date_add(start, (u(6) * 200).cast("int") + 5)).alias("date_conditions"), F.lit("2025-12-31").cast("date").alias("date_published"), F.col("id").alias("_seq"),
    )
    return finalize(own, "synthetic", "XX", "made up")
