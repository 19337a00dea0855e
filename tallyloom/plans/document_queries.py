"""Catalogue queries from documents: staged words, workbooks and exports made of the driver's tables, read back through their publishers."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions.tables import shared_dir, written
from ..operators import layout, places, quality
from ..operators.panel import FIELDS
from ..sources import adapters, workbook
from .queries import _STREETS, _R3, _R6, _RULES, _WORDS, _read, _words, query
from .views import view

_K = "o_orderkey"

# ---------------------------------------------------------------- printed documents


def _cell_words(rows: DataFrame, cells: dict[int, Column], step: float) -> DataFrame:
    """Words of rows (document, page, top): of each cell by column number, its words side by side, those after a line feed five points lower."""
    each = rows.select("document", "page", "top", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("string").alias("text")) for i, c in cells.items()])).alias("c")).where("c.text IS NOT NULL")
    lines = each.select("document", "page", "top", "c.i", F.posexplode(F.split("c.text", "\n")).alias("j", "line"))
    words = lines.select("document", "page", "top", "i", "j", F.posexplode(F.split("line", " ")).alias("n", "text"))
    x0 = F.col("i") * step + 3.0 + F.col("n") * 8.0
    return words.select("document", "page", "text", x0.alias("x0"), (x0 + 6.0).alias("x1"), (F.col("top") + F.col("j") * 5.0).alias("top"))


def _rules(words: DataFrame, width: int, step: float) -> DataFrame:
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(width)), lambda i: i * step)).alias("x0")
    return words.select("document", "page").distinct().select("document", "page", at, F.lit(0.0).alias("top"), F.lit(900.0).alias("bottom"))


def _all_fields(values: dict[str, str]) -> str:
    """The 21 fields in SQL: the values given, the others null of their kind."""
    kinds = {"number": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}
    return ", ".join(f"{values.get(f.name, f'CAST(NULL AS {kinds.get(f.dtype, 'VARCHAR')})')} AS {f.name}" for f in FIELDS)


_PRINTED = {
    "application_id": "'O-' || o_orderkey", "node_id": "'ST' || o_orderkey % 50", "location_text": "'ST' || o_orderkey % 50", "voltage_level": "CASE WHEN o_orderkey % 2 = 0 THEN '110 kV' ELSE 'SN' END", "resource_class": "CASE WHEN o_orderkey % 3 = 0 THEN 'WIND' ELSE 'PV' END",
    "capacity_injected": "1000.0 * o_orderkey + 500", "process_status": "CASE WHEN o_orderkey % 5 = 0 THEN 'REFUSED' ELSE 'CONDITIONS_ISSUED' END", "date_application": "CAST(o_orderdate AS DATE)", "date_conditions": "CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) + 30 END",
    "date_refusal": "CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 30 END", "refusal_reason": "CASE WHEN o_orderkey % 5 = 0 THEN 'brak mocy' END", "date_published": "DATE '2026-06-30'",
}


@query(f" SELECT {_all_fields(_PRINTED)}, 'list_' || CAST(o_orderkey // 2000 AS BIGINT) || '.pdf' AS source_document FROM orders", "base")
def panel_of_ruled_words(spark, sf_dir):
    """Words and rules of every order as a row of a printed list of 27 columns, its status on two lines: to the panel's 21 fields."""
    k, step = F.col(_K), 40.0
    own = _read(spark, sf_dir, "orders").withColumns({"document": F.format_string("list_%d.pdf", F.floor(k / 2000)), "page": (F.floor(k % 2000 / 50) + 1).cast("int"), "top": ((k % 50) * 14 + 40).cast("double")})
    day = lambda n: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), n), "dd.MM.yyyy")
    refused = k % 5 == 0
    cells = {
        0: k, 1: F.concat(F.lit("O-"), k.cast("string")), 4: F.concat(F.lit("ST"), (k % 50).cast("string")), 5: F.when(k % 2 == 0, "110 kV").otherwise("SN"), 7: F.when(k % 3 == 0, "FW").otherwise("PV"), 8: F.concat(k.cast("string"), F.lit(",5")),
        16: F.when(refused, "odmowa").otherwise("warunki\nprzylaczenia"), 17: day(0), 19: F.when(~refused, day(30)), 20: F.when(refused, day(30)), 21: F.when(refused, "brak\nmocy"),
    }
    words = _cell_words(own, cells, step)
    pages = own.select("document", "page").distinct()
    head = pages.select("document", "page", F.explode(F.array(F.struct(F.lit("Lp.").alias("text"), F.lit(3.0).alias("x0"), F.lit(20.0).alias("top")))).alias("w"))
    # every document states its date on its first page, also where no order falls on that page
    title = own.select("document").distinct().select("document", F.lit(1).alias("page"), F.explode(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(3.0 + 30 * i).alias("x0"), F.lit(5.0).alias("top")) for i, t in enumerate(("Stan", "na", "30.06.2026"))])).alias("w"))
    both = head.unionAll(title).select("document", "page", "w.text", "w.x0", (F.col("w.x0") + 6).alias("x1"), "w.top")
    words = written(words.unionAll(both), "words")
    out = adapters.station_list(words, written(_rules(words, 27, step), "edges"))
    return out.select(*[f.name for f in FIELDS], "source_document")


_S = "CAST(list_value(1, 3, 4)[CAST(c_custkey % 3 + 1 AS INT)] AS BIGINT)"
_SECTIONED = {
    "application_id": "'boryszew:pkt' || s || ':' || row_number() OVER (PARTITION BY doc, s ORDER BY c_custkey)", "location_text": "'Place ' || c_custkey || ' north'", "resource_class": "CASE WHEN c_custkey % 2 = 0 THEN 'WIND' ELSE 'PV' END", "capacity_withdrawn": "1000.0 * c_custkey",
    "process_status": "CASE s WHEN 1 THEN CASE WHEN c_custkey % 4 = 0 THEN 'CONNECTED' ELSE 'CONDITIONS_ISSUED' END WHEN 3 THEN 'UNDER_REVIEW' ELSE 'REFUSED' END", "date_application": "CASE WHEN s > 1 THEN d END", "date_conditions": "CASE WHEN s = 1 THEN d END",
    "date_energisation": "CASE WHEN s = 1 AND c_custkey % 4 = 0 THEN d + 400 END", "refusal_reason": "CASE WHEN s = 4 THEN 'brak mocy' END", "date_published": "DATE '2026-03-05'",
}


@query(f", x AS (SELECT c_custkey, c_custkey // 150 AS doc, {_S} AS s, DATE '2024-01-01' + CAST(c_custkey % 300 AS INT) AS d FROM customer) SELECT {_all_fields(_SECTIONED)}, 'elana_' || CAST(doc AS BIGINT) || '.pdf' AS source_document FROM x", "base")
def panel_of_banded_words(spark, sf_dir):
    """Words of every customer as a row of one of three sections without rules: columns from the corridors between them, a place on two lines."""
    k, step = F.col("c_custkey"), 70.0
    section = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), (k % 3 + 1).cast("int"))
    own = _read(spark, sf_dir, "customer").withColumns({"document": F.format_string("elana_%d.pdf", F.floor(k / 150)), "s": section, "page": section, "top": (F.floor(k % 150 / 3) * 14 + 60).cast("double")})
    start = F.lit("2024-01-01").cast("date")
    day = lambda n: F.date_format(F.date_add(start, (k % 300).cast("int") + n), "dd.MM.yyyy")
    number, place, kind = F.concat(k.cast("string"), F.lit(".")), F.concat(F.lit("Place "), k.cast("string"), F.lit("\nnorth")), F.when(k % 2 == 0, "FW").otherwise("PV")
    bodies = {
        1: (number, F.lit("osoba"), place, k, kind, day(0), F.lit("Nie"), F.when(k % 4 == 0, day(400)).otherwise("-")),
        3: (number, F.lit("firma"), place, k, kind, day(0), day(9), F.lit("w trakcie analizy")),
        4: (number, place, k, kind, day(0), day(9), F.lit("brak mocy")),
    }
    heads = {1: "1. Podmioty ubiegające się", 3: "3. Złożone wnioski", 4: "4. Wydane odmowy"}
    parts = [_cell_words(own.where(F.col("s") == s), dict(enumerate(cells)), step) for s, cells in bodies.items()]
    titles = own.select("document").distinct()
    said = {(1, 10.0): "Data aktualizacji publikacji: 5 marca 2026", **{(s, 30.0): t for s, t in heads.items()}}
    for (page, top), text in said.items():
        parts.append(_cell_words(titles.select("document", F.lit(page).alias("page"), F.lit(top).alias("top")), {0: F.lit(text)}, step))
    words = parts[0]
    for p in parts[1:]:
        words = words.unionAll(p)
    return adapters.printed_sections(written(words, "words")).select(*[f.name for f in FIELDS], "source_document")


@query(""" SELECT 'doc' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '_Tauron' ELSE '' END AS document,
   CASE WHEN c_custkey % 4 = 0 THEN 'pl_tauron' WHEN c_custkey % 4 = 1 THEN 'pl_stoen' WHEN c_custkey % 4 = 2 THEN 'pl_pse' END AS publisher FROM customer""", "base")
def document_detection(spark, sf_dir):
    """Publishers of documents by their names, or by the first 4,000 characters of their first page; a name that stands later tells nothing."""
    k = F.col("c_custkey")
    far = F.repeat(F.lit("word "), 900)
    text = F.when(k % 4 == 0, "nothing").when(k % 4 == 1, F.concat(F.lit("Wykaz STOEN "), k.cast("string"))).when(k % 4 == 2, F.concat(F.substring(far, 1, 3000), F.lit("Polskie Sieci Elektroenergetyczne"))).otherwise(F.concat(far, F.lit("stoen")))
    # dealt before the words are made of them: a short table is one file, which one task would read
    dealt = _read(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = dealt.select(F.concat(F.lit("doc"), k.cast("string"), F.when(k % 4 == 0, "_Tauron").otherwise("")).alias("document"), F.lit(1).alias("page"), F.lit(10.0).alias("top"), text.alias("t"))
    return adapters.detect_documents(_cell_words(own, {0: F.col("t")}, 40.0))


# ---------------------------------------------------------------- files


def _folder(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"


@query(""" SELECT 'C-' || c_custkey AS application_id, CASE WHEN c_custkey % 3 = 0 THEN '110; 220 kV' ELSE '400 kV' END AS voltage_level, 'BESS' AS resource_class, CASE WHEN c_custkey % 2 = 0 THEN 1000.0 * c_custkey + 240000 ELSE 1000.0 * c_custkey END AS capacity_injected,
   CASE WHEN c_custkey % 2 = 0 THEN c_custkey || '; 240' END AS components, DATE '2026-06-30' AS date_published, CASE WHEN c_custkey % 7 = 0 THEN 'location=' || c_custkey % 10 END AS footnotes, 'Client ' || c_custkey AS applicant FROM customer""", "base")
def panel_of_workbooks(spark, sf_dir):
    """Every customer as a row of the common template in workbooks, with capacities for several places and footnotes: written and read by the data source."""
    k = F.col("c_custkey")
    cell = lambda col, text, sup=None: F.struct(F.lit(col).alias("col"), text.cast("string").alias("text"), (F.lit(None) if sup is None else sup).cast("string").alias("sup"))
    values = F.array(
        cell(1, F.concat(F.lit("C-"), k.cast("string"))), cell(3, F.lit("OSD")), cell(4, F.concat(F.lit("Client "), k.cast("string"))), cell(5, F.lit("Place"), F.when(k % 7 == 0, k % 10)), cell(6, F.when(k % 3 == 0, "110; 220").otherwise("400")), cell(8, F.lit("Magazyn energii")),
        cell(9, F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit("\n240"))).otherwise(k.cast("string"))),
    )
    body = _read(spark, sf_dir, "customer").select(F.floor(k / 500).alias("book"), (k + 4).cast("int").alias("row"), F.explode(values).alias("c")).select("book", "row", "c.*")
    head = F.explode(F.array(F.struct(F.lit(1).alias("row"), cell(1, F.lit("Wykaz, stan na 30.06.2026 r.")).alias("c")), F.struct(F.lit(3).alias("row"), cell(1, F.lit("ID obiektu")).alias("c"))))
    books = body.select("book").distinct().select("book", head.alias("h")).select("book", "h.row", "h.c.*")
    path = _folder(spark, "books")
    workbook.register(spark)
    # one workbook for each task that has rows: a book's rows meet in one
    cells = body.unionByName(books)
    n = max(1, int(body.agg(F.max("book")).first()[0] or 0) + 1)
    cells = cells.repartitionByRange(n, "book").select(F.concat(F.lit("Wykaz "), F.lit("wspólny")).alias("sheet"), (F.col("row")).alias("row"), "col", "text", "sup")
    cells.write.format("workbook").mode("overwrite").save(path)
    panel = adapters.read(spark, path, "pl_pse").where("_entity = 'APPLICATION'")
    return panel.select("application_id", "voltage_level", "resource_class", "capacity_injected", F.col("_capacity_injected_components_mw").alias("components"), "date_published", F.col("_footnotes").alias("footnotes"), F.col("_applicant").alias("applicant"))


@query(" SELECT 'N' || s_suppkey AS node_id, 'Node \"' || s_suppkey || '\"' AS node_name, s_suppkey % 4 = 0 AS constraint_flag, (s_suppkey % 4) / 2.0 AS mva, DATE '2026-06-30' AS date_published, 'E-REDES S.A.' AS publisher FROM supplier", "base")
def panel_of_exports(spark, sf_dir):
    """Every supplier as a node of a portal's export: written as CSV, read in as many pieces as the file has."""
    k = F.col("s_suppkey")
    path = _folder(spark, "e-redes")
    rows = _read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("N"), k.cast("string")).alias("codigo"), F.concat(F.lit('Node "'), k.cast("string"), F.lit('"')).alias("instalacao"),
        F.concat(F.floor(k % 4 / 2).cast("string"), F.lit(","), (k % 2 * 5).cast("string")).alias("capacidade_de_recepcao_mt_at_mva_ultimo_trimestre"), F.lit("2T2026").alias("data_ultimo_trimestre"),
    )
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return adapters.read(spark, path, "pt_eredes").select("node_id", "node_name", "constraint_flag", F.col("_capacity_available_mva").alias("mva"), "date_published", "publisher")


# ---------------------------------------------------------------- lines, ranks, crossings

_ANCHORS = f""", w AS ({_WORDS}), s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round(top, 1), x0, x1, text, top) AS i FROM w),
 a(page, i, top) AS (SELECT page, i, top FROM s WHERE i = 1 UNION ALL SELECT s.page, s.i, s.top FROM (SELECT a.page, min(n.i) AS i FROM a JOIN s n ON n.page = a.page AND n.i > a.i AND abs(n.top - a.top) > 2 GROUP BY a.page) m JOIN s ON s.page = m.page AND s.i = m.i)"""


@query(_ANCHORS + ", b AS (SELECT page, i, row_number() OVER (PARTITION BY page ORDER BY i) - 1 AS line, coalesce(lead(i) OVER (PARTITION BY page ORDER BY i), 1000000000) AS upto FROM a) SELECT s.page, s.text, CAST(b.line AS INTEGER) AS line FROM s JOIN b ON b.page = s.page AND s.i >= b.i AND s.i < b.upto", "base")
def visual_lines(spark, sf_dir):
    return layout.lines(_words(spark, sf_dir)).select("page", "text", "line")


@query(_ANCHORS + " SELECT s.page, count(*) AS words, any_value(l.n) AS lines FROM s JOIN (SELECT page, count(*) AS n FROM a GROUP BY 1) l ON l.page = s.page GROUP BY 1", "base")
def line_clustering(spark, sf_dir):
    return layout.lines(_words(spark, sf_dir)).groupBy("page").agg(F.count(F.lit(1)).alias("words"), F.count_distinct("line").alias("lines"))


# pairs of streets thirteen apart that share no word and have no word of their own, with axes of which one lies east-west and the other north-south
_CROSSED = """, tok AS (SELECT name, unnest(string_split(name, ' ')) AS t FROM street), own AS (SELECT DISTINCT name FROM tok WHERE t IN (SELECT t FROM tok GROUP BY t HAVING count(*) = 1)),
 p AS (SELECT a._seq, a.name AS a, b.name AS b, a.lat AS lat0, a.lon AS lon0, CASE WHEN a._seq % 2 = 0 THEN a._seq ELSE b._seq END AS east, CASE WHEN a._seq % 2 = 0 THEN b._seq ELSE a._seq END AS north
   FROM street a JOIN street b ON b._seq = a._seq + 13 WHERE a._seq % 3 = 1 AND a.name NOT IN (SELECT name FROM own) AND b.name NOT IN (SELECT name FROM own)
     AND NOT EXISTS (SELECT 1 FROM tok x JOIN tok y ON x.t = y.t WHERE x.name = a.name AND y.name = b.name))"""


@query(_CROSSED + """, g AS (SELECT *, east % 11 > 0 AND north % 13 > 0 AS met, east % 13 > 0 AND north % 13 > 0 AS axes FROM p)
 SELECT 'Town, ' || a || ' / ' || b AS query, a || ' / ' || b AS matched, 'INTERSECTION' AS confidence, CASE WHEN axes AND met THEN round(50.005 + (east % 97) / 100.0, 6) ELSE lat0 END AS lat, CASE WHEN axes AND met THEN round(20.0 + (north % 89) / 50.0, 6) ELSE lon0 END AS lon,
   CASE WHEN axes AND NOT met THEN 'matched 2 of 2 parts; the axes do not intersect, point taken from the first part' ELSE 'matched 2 of 2 parts' END AS reason, CASE WHEN axes AND met THEN 'INTERSECTION_POINT' WHEN lat0 IS NOT NULL THEN 'STREET_AXIS_POINT' ELSE 'NO_GEOMETRY' END AS accuracy FROM g""", "street")
def geo_crossing(spark, sf_dir):
    """Streets with axes of many points, asked for in pairs: where their axes cross, where they miss each other, and where one has none."""
    street = written(view(spark, sf_dir, "street"), "street")
    words = street.select("name", F.explode(F.split("name", " ")).alias("t"))
    alone = words.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).where("n = 1").select("name").distinct()
    kept = street.join(alone, "name", "left_anti").select("_seq", "name", F.array_distinct(F.split("name", " ")).alias("ws"))
    a, b = kept.where("_seq % 3 = 1"), kept.select((F.col("_seq") - 13).alias("_seq"), F.col("name").alias("other"), F.col("ws").alias("others"))
    pairs = a.join(b, "_seq").where(~F.arrays_overlap("ws", "others"))
    asked = pairs.select(F.concat(F.lit("Town, "), "name", F.lit(" / "), "other").alias("query"))
    s, i = F.col("_seq"), F.sequence(F.lit(0), F.lit(200))
    point = lambda y, x: F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lon"))
    # one that lies east-west is far off where 11 divides its number
    east = F.transform(i, lambda n: point(F.lit(50.005) + s % 97 / 100, F.when(s % 11 == 0, 10.0).otherwise(19.99) + n / 100 + 0.003))
    north = F.transform(i, lambda n: point(F.lit(49.9) + n / 100 + 0.003, F.lit(20.0) + s % 89 / 50))
    axis = F.when(s % 13 == 0, None).when(s % 2 == 0, east).otherwise(north)
    return places.resolve(asked, places.gazetteer(street.withColumn("axis", axis))).select("query", "matched", "confidence", "lat", "lon", "reason", "accuracy")


# ---------------------------------------------------------------- values

_LETTERS = [chr(c) for c in (*range(0xC0, 0x250), *range(0xFB00, 0xFB07))]


def _expected(letter: str) -> str:
    """A letter as plain text by the standard library's own decomposition."""
    own = letter.translate(str.maketrans({"ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O"}))
    return "".join(c for c in unicodedata.normalize("NFKD", own) if not unicodedata.combining(c)).lower()


_BASES = "[" + ", ".join("'" + _expected(x).replace("'", "''") + "'" for x in _LETTERS) + "]"


@query(f" SELECT p_partkey AS k, 'x' || {_BASES}[CAST(p_partkey % {len(_LETTERS)} + 1 AS INT)] || 'x' AS norm, CASE p_partkey % 4 WHEN 0 THEN 'strassenhof' WHEN 1 THEN 'aero' WHEN 2 THEN 'oeuvre' ELSE 'final' END || ' ' || p_partkey AS station FROM part", "base")
def norm_letters(spark, sf_dir):
    """Every letter of the Latin blocks and the ligatures in its plain form, and names of stations with letters that nothing takes apart."""
    k = F.col("p_partkey")
    letter = F.element_at(F.array(*[F.lit(x) for x in _LETTERS]), (k % len(_LETTERS) + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("GPZ Straßenhof", "Ærø SE", "Œuvre", "stacja ﬁnal")]), (k % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select(k.alias("k"), C.norm_text(F.concat(F.lit("X"), letter, F.lit("x"))).alias("norm"), C.station_name(F.concat_ws(" ", name, k.cast("string"))).alias("station"))


_MAGNITUDE = "o_orderkey * pow(10.0, o_orderkey % 16 - 8)"


@query(f" SELECT o_orderkey AS k, printf('%g', CAST({_MAGNITUDE} AS DOUBLE)) AS text, CASE WHEN o_orderkey % 3 > 0 THEN printf('%g', CAST(o_orderkey AS DOUBLE)) || '; ' || printf('%g', o_orderkey % 1000 + 0.25) END AS components FROM orders", "base")
def significant_digits(spark, sf_dir):
    """Numbers of sixteen magnitudes with six significant digits, and the parts of cells that list two capacities."""
    k = F.col(_K)
    cell = F.concat(k.cast("string"), F.when(k % 3 > 0, F.concat(F.lit("\n"), (k % 1000).cast("string"), F.lit(",25"))).otherwise(""))
    # powers as they are written: Spark's pow gives 9.999999999999999e-06 for 1e-05
    power = F.element_at(F.array(*[F.lit(float(f"1e{n}")) for n in range(-8, 8)]), (k % 16 + 1).cast("int"))
    return _read(spark, sf_dir, "orders").select(k.alias("k"), C.significant(k * power).alias("text"), C.components_mw(cell).alias("components"))


# ---------------------------------------------------------------- rules

_TOTALS = f"""{_R3}, by_pub AS (SELECT publisher, count(*) AS n, {', '.join(f'sum({v}) AS {c}' for c, v in _RULES.items())}, count(application_id) - count(DISTINCT application_id) AS R6 FROM app GROUP BY 1),
 t3 AS (SELECT publisher, sum(v) AS R3 FROM r3 GROUP BY 1),
 pan AS (SELECT {', '.join(f'sum({v}) AS {c}' for c, v in _RULES.items())}, ({_R6}) AS R6, (SELECT sum(v) FROM r3) AS R3 FROM app),
 each AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS code, (SELECT CAST(sum({c}) AS BIGINT) FROM {'t3' if c == 'R3' else 'by_pub'}) AS parts, CAST({c} AS BIGINT) AS panel FROM pan" for c in (*_RULES, "R3", "R6")) + ")"


@query(_TOTALS + " SELECT (SELECT count(*) FROM app) AS n_rows, (SELECT count(DISTINCT publisher) FROM app) AS n_publishers, CAST(sum(panel) AS BIGINT) AS violations_total, coalesce(string_agg(CASE WHEN parts <> panel THEN code || ':' || parts || '/' || panel END, ',' ORDER BY code), '') AS mismatch FROM each", "app")
def quality_sum_check(spark, sf_dir):
    return quality.sum_check(view(spark, sf_dir, "app"))


@query(_TOTALS + " SELECT CAST(NULL AS VARCHAR) AS publisher, TRUE AS is_total, code, panel AS violations FROM each UNION ALL SELECT publisher, FALSE, code, CAST(v AS BIGINT) FROM (" + " UNION ALL ".join(f"SELECT publisher, '{c}' AS code, {c} AS v FROM {'t3' if c == 'R3' else 'by_pub'}" for c in (*_RULES, "R3", "R6")) + ") x", "app")
def quality_sums(spark, sf_dir):
    return quality.quality_sums(view(spark, sf_dir, "app")).select("publisher", "is_total", "code", "violations")


@query(f""", b AS (SELECT *, CASE WHEN _seq % 100 = 0 THEN 1 ELSE 0 END AS bad FROM app)
 SELECT 'R4' AS code, CAST(-1 AS BIGINT) AS violations, CAST(NULL AS DOUBLE) AS share, CAST(sum(bad) AS BIGINT) || ' values of capacity_injected are no numbers' AS error FROM b UNION ALL SELECT 'X1', -1, NULL, 'AnalysisException' FROM b HAVING count(*) > 0
 UNION ALL SELECT 'R1', CAST(sum({_RULES['R1']}) AS BIGINT), round(sum({_RULES['R1']}) / CAST(count(*) AS DOUBLE), 6), NULL FROM b UNION ALL SELECT 'R8', CAST(sum({_RULES['R8']}) AS BIGINT), round(sum({_RULES['R8']}) / CAST(count(*) AS DOUBLE), 6), NULL FROM b""", "app")
def rules_isolated(spark, sf_dir):
    """A rule over a column that is not there and one over a column with texts among its numbers fail alone; the others have their counts, in the same scan."""
    broken = view(spark, sf_dir, "app").withColumn("capacity_injected", F.when(F.col("_seq") % 100 == 0, "many").otherwise(F.col("capacity_injected").cast("string")))
    keep = {r.code: r for r in quality.ROW_RULES}
    rules = (keep["R1"], keep["R4"], keep["R8"], quality.Rule("X1", "a column that is not there", lambda df: F.col("nowhere").isNull().cast("long")))
    return quality.run_quality(broken, rules, only=("R1", "R4", "R8", "X1")).withColumn("error", F.when(F.col("code") == "X1", F.substring_index("error", ":", 1)).otherwise(F.col("error")))


@query(""" SELECT count(*) AS n_rows, 'extra,other' AS columns_outside, 'location_text' AS missing_core_columns, 'capacity_injected:' || count(*) FILTER (WHERE _seq % 100 = 0) || ',date_refusal:' || count(*) FILTER (WHERE _seq % 50 = 0) AS violations, CAST(0 AS BIGINT) AS rows_with_complete_core,
   round(count(date_conditions) / CAST(count(*) AS DOUBLE), 6) AS share_conditions, 0.0 AS share_location FROM app""", "app")
def validation_report(spark, sf_dir):
    """A panel with columns of its own, without a core column, with texts among its numbers and impossible dates."""
    from ..operators import panel

    k = F.col("_seq")
    df = view(spark, sf_dir, "app").drop("location_text").withColumns({"capacity_injected": F.when(k % 100 == 0, "many").otherwise(F.col("capacity_injected").cast("string")), "date_refusal": F.when(k % 50 == 0, "2020-13-01").otherwise(F.col("date_refusal").cast("string")), "other": F.lit(1), "extra": F.lit(2)})
    said = F.array_join(F.array_sort(F.transform(F.map_entries("violation_type"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return panel.validation_report(df).select("n_rows", F.array_join("columns_outside", ",").alias("columns_outside"), F.array_join("missing_core_columns", ",").alias("missing_core_columns"), said.alias("violations"), "rows_with_complete_core", F.col("completion")["date_conditions"].alias("share_conditions"), F.col("completion")["location_text"].alias("share_location"))


@query(f" SELECT 'APPLICATION' AS entity, count(*) AS n, CAST(sum({_RULES['R7']}) AS BIGINT) AS incomplete FROM app", "app")
def entity_rows(spark, sf_dir):
    return quality.entity_rows(view(spark, sf_dir, "app"))


@query(_TOTALS + ", o AS (SELECT publisher AS \"group\", code, CAST(v AS BIGINT) AS violations FROM (" + " UNION ALL ".join(f"SELECT publisher, '{c}' AS code, {c} AS v FROM {'t3' if c == 'R3' else 'by_pub'}" for c in (*_RULES, "R3", "R6")) + ") x), t AS (SELECT code, CAST(sum(violations) AS BIGINT) AS total FROM o GROUP BY 1) SELECT o.code, \"group\", violations, total, p.place FROM o JOIN (SELECT code, total, row_number() OVER (ORDER BY total DESC, code) AS place FROM t) p ON p.code = o.code", "app")
def chart_quality(spark, sf_dir):
    from ..operators import chartdata

    return chartdata.quality_chart(quality.quality_by_publisher(view(spark, sf_dir, "app")))
