"""Catalogue queries over staged documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import legacy
from ..operators import chartdata, editions, nodes, places
from ..sources import publishers, registers
from .queries import _ASSIGN, _assigned, _load, _pick, _read, query
from . import document_queries  # noqa: F401  adds its queries to the catalogue
from .views import view

def _k() -> F.Column:
    """The order key; made in a query, as columns need a session."""
    return F.col("o_orderkey")


@query(" SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS as_at, CAST(o_orderdate AS DATE) AS in_name, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS DOUBLE) + 0.5 END AS kva, CASE WHEN o_orderkey % 4 < 2 THEN '110 kV' END AS tag FROM orders", "base")
def document_values(spark, sf_dir):
    day = F.date_format("o_orderdate", "d.MM.yyyy")
    title = F.when(_k() % 3 == 0, "stan na jutro").when(_k() % 3 == 1, F.concat(F.lit("Wykaz, stan na dzień "), day, F.lit(" r."))).otherwise(F.concat(F.lit("STAN NA "), day))
    note = F.when(_k() % 2 == 0, F.concat(F.lit("limit = "), _k().cast("string"), F.lit(".5 kVA"))).otherwise("no limit")
    return _read(spark, sf_dir, "orders").select(_k().alias("k"), D.as_at(title).alias("as_at"), D.date_in_name(F.concat(F.lit("dir/list_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".pdf"))).alias("in_name"), D.stated_kva(note).alias("kva"), D.voltage_tag(F.when(_k() % 4 < 2, "rozdzielnia 110kV A").otherwise("none")).alias("tag"))


@query(" SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders", "base")
def written_date(spark, sf_dir):
    month = F.element_at(F.array(*[F.lit(m) for m in ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia")]), F.month("o_orderdate"))
    text = F.concat(F.lit("Aktualizacja: "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), month, F.lit(" "), F.year("o_orderdate").cast("string"))
    return _read(spark, sf_dir, "orders").select(_k().alias("k"), D.written_date(text).alias("d"))


@query(" SELECT 'st' || s_suppkey || '|' || CASE s_suppkey % 2 WHEN 0 THEN '110' ELSE '15kV' END AS node_id, CASE s_suppkey % 2 WHEN 0 THEN '110 kV' ELSE '15 kV' END AS voltage_level, s_suppkey % 3 = 0 AS constraint_flag, CAST(s_suppkey % 3 AS DOUBLE) AS free_slots FROM supplier WHERE s_suppkey % 10 > 0", "base")
def slot_sheet(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = _read(spark, sf_dir, "supplier").select(F.when(k % 10 > 0, F.concat(F.lit("st"), k.cast("string"))).otherwise(" ").alias("station"), F.when(k % 2 == 0, "110").otherwise("15kV").alias("voltage"), (k % 3).cast("string").alias("slots"))
    return publishers.slot_sheet(rows, "p", "J").select("node_id", "voltage_level", "constraint_flag", F.col("_free_slots").alias("free_slots"))


@query(" SELECT 'st' || s_suppkey AS node_id, CASE WHEN s_suppkey % 4 = 0 THEN 500.0 ELSE 1000.0 * s_suppkey + 250 END AS capacity_available, CASE WHEN s_suppkey % 3 = 0 THEN TRUE WHEN s_suppkey % 3 = 1 AND s_suppkey % 2 = 0 THEN FALSE END AS constraint_flag FROM supplier", "base")
def heat_map(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = _read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("st"), k.cast("string")).alias("station"), F.lit("38kV").alias("voltage"), F.when(k % 4 > 0, F.concat(k.cast("string"), F.lit(".25"))).alias("available_mva"), F.lit("limit = 500 kVA").alias("note"),
        F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "No").otherwise("unknown").alias("constrained"), F.when(k % 2 == 0, "no").otherwise("perhaps").alias("also_constrained"), F.lit(None).cast("string").alias("lat"), F.lit(None).cast("string").alias("lon"),
    )
    return publishers.heat_map(rows, "p", "J").select("node_id", "capacity_available", "constraint_flag")


@query(" SELECT 'N00' || s_suppkey AS node_id, 1000.0 * (1000 + s_suppkey) + 500 AS capacity_available, DATE '2025-08-01' AS date_published FROM supplier WHERE s_suppkey % 5 > 0", "base")
def wide_rows(spark, sf_dir):
    k = F.col("s_suppkey")
    cells = F.concat(F.array(F.concat(F.lit("N00"), k.cast("string")), F.lit("n"), F.lit("p"), F.lit("66"), F.concat(F.replace(F.format_number(k + 1000, 0), F.lit(","), F.lit(".")), F.lit(",5")), F.lit("0,5")), F.array_repeat(F.lit(""), 23))
    rows = _read(spark, sf_dir, "supplier").select(F.when(k % 5 > 0, cells).otherwise(F.slice(cells, 1, 20)).alias("cells"), F.lit("list_2025-08-01.pdf").alias("source_document"), k.alias("_seq"))
    return publishers.wide_rows(rows, "p", "ES").select("node_id", "capacity_available", "date_published")


@query(" SELECT 'pub:item:' || o_orderkey || '.' AS application_id, 'WIND' AS resource_class, CAST(o_orderkey AS DOUBLE) AS capacity_injected, CAST(o_orderdate AS DATE) AS date_application FROM orders WHERE o_orderkey % 4 > 0", "base")
def listed_rows(spark, sf_dir):
    cells = F.array(F.when(_k() % 4 > 0, F.concat(_k().cast("string"), F.lit("."))).otherwise("Lp."), F.lit(" "), F.lit("x"), F.lit("FW"), _k().cast("string"), F.date_format("o_orderdate", "dd.MM.yyyy"))
    rows = _read(spark, sf_dir, "orders").select(cells.alias("cells"), F.lit("d").alias("source_document"), _k().alias("_seq"))
    return publishers.listed_rows(rows, {"application_id": 1, "location_text": 2, "resource_class": 3, "capacity_injected": 4, "date_application": 5}, "pub", "PL").select("application_id", "resource_class", "capacity_injected", "date_application")


@query(""", x AS (SELECT o_orderkey // 1000 AS doc, o_orderkey AS seq, CASE WHEN o_orderkey % 50 = 1 THEN 'a' WHEN o_orderkey % 50 = 26 THEN 'b' END AS h FROM orders), y AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq) AS section FROM x) SELECT doc, section, count(*) AS n FROM y WHERE h IS NULL GROUP BY 1, 2""", "base")
def sections(spark, sf_dir):
    text = F.when(_k() % 50 == 1, "1. Wnioski").when(_k() % 50 == 26, "2. Stacje").otherwise("row")
    lines = _read(spark, sf_dir, "orders").select(F.floor(_k() / 1000).alias("doc"), _k().alias("seq"), text.alias("text"))
    return publishers.sections(lines, {"a": r"^1\.", "b": r"^2\."}, ("doc",)).groupBy("doc", "section").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT CAST(s_suppkey AS BIGINT) AS g, 'branch ' || CASE WHEN s_suppkey < 50 THEN 'A' ELSE 'B' END AS node_name, 1000.0 * s_suppkey AS capacity_available, 1000.0 * s_suppkey AS y2026, 2000.0 * s_suppkey AS y2027 FROM supplier", "base")
def node_tables(spark, sf_dir):
    s, k = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    one = s.where("s_suppkey = 1")
    doc = F.lit("d").alias("source_document")
    composition = s.select(doc, (k * 10 + 1).alias("seq"), k.cast("string").alias("group_no"), F.concat(F.lit("st"), k.cast("string")).alias("stations"))
    for at, name in ((0, "branch A"), (495, "branch B")):
        composition = composition.unionAll(one.select(doc, F.lit(at).cast("long"), F.lit(None).cast("string"), F.lit(name)))
    values = s.select(doc, (k * 10 + 1).alias("seq"), F.array(k.cast("string"), k.cast("string"), (k * 2).cast("string"), F.lit("-")).alias("cells"))
    values = values.unionAll(one.select(doc, F.lit(0).cast("long"), F.array(F.lit("nr"), F.lit("2026"), F.lit("2027"), F.lit("2028"))))
    return publishers.node_tables(composition, values, "p", "PL").select(F.col("_group_no").cast("long").alias("g"), "node_name", "capacity_available", F.col("_capacity_available_2026").alias("y2026"), F.col("_capacity_available_2027").alias("y2027"))


@query(" SELECT o_orderkey AS application_id, CASE o_orderkey % 3 WHEN 0 THEN 'WIND' WHEN 1 THEN 'LOAD' ELSE 'PV' END AS resource_class, CASE WHEN o_orderkey % 2 = 0 THEN 'REFUSED' ELSE 'UNDER_REVIEW' END AS process_status, o_totalprice AS capacity_withdrawn FROM orders", "base")
def legacy_translate(spark, sf_dir):
    old = _read(spark, sf_dir, "orders").select(_k().alias("id_wniosku"), _pick(("FW", "ODB", "PV")).alias("klasa_zasobu"), _pick(("ODMOWA", "W_ANALIZIE")).alias("status_procesu"), F.col("o_totalprice").alias("moc_pobierana"))
    return legacy.translate(old)


@query(" SELECT c_custkey AS k, 'Street ' || chr(CAST(65 + c_custkey % 26 AS INT)) AS street, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS STRING) WHEN 1 THEN c_custkey || 'A' END AS number FROM customer", "base")
def house_number(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat(F.lit("Street "), F.char((65 + k % 26).cast("int")))
    text = F.when(k % 3 == 0, F.concat_ws(" ", name, k.cast("string"))).when(k % 3 == 1, F.concat(name, F.lit(" "), k.cast("string"), F.lit("A"))).otherwise(name)
    street, number = places.house_number(text)
    return _read(spark, sf_dir, "customer").select(k.alias("k"), street.alias("street"), number.alias("number"))


@query(_ASSIGN + " SELECT group_match, count(*) AS n FROM aa GROUP BY 1", "app", "node_station")
def assignment_counts(spark, sf_dir):
    return _assigned(spark, sf_dir).groupBy("group_match").agg(F.count(F.lit(1)).alias("n"))


@query(_load("capacity_injected", "generation", None).replace(" SELECT n._group_no", ", f AS (SELECT n._group_no") + ') SELECT row_number() OVER (ORDER BY loading DESC, "group") AS rank, node_name, loading, row_number() OVER (ORDER BY loading DESC, "group") <= 12 AS labelled FROM f WHERE loading IS NOT NULL', "app", "node_station", "node")
def chart_loading_bars(spark, sf_dir):
    loaded = nodes.loading(_assigned(spark, sf_dir), view(spark, sf_dir, "node")).withColumn("loading", F.round("loading", 6))
    return chartdata.loading_bars(loaded).withColumn("rank", F.col("rank").cast("long"))


@query()
def synthetic_panel(spark, sf_dir):
    return registers.synthetic_panel(spark)


@query()
def synthetic_editions(spark, sf_dir):
    return editions.compare(*publishers.synthetic_editions(registers.synthetic_panel(spark)))
