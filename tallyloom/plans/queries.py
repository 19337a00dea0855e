"""The query catalogue over the register views, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..operators import chartdata, editions, layout, nodes, panel, places, quality, survival
from .views import oracle, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- survival

_TIMED = """, t AS (SELECT *, CASE WHEN date_application IS NOT NULL AND coalesce(date_conditions, date_published) >= date_application THEN datediff('day', date_application, coalesce(date_conditions, date_published)) END AS time_days,
    CASE WHEN date_application IS NOT NULL AND coalesce(date_conditions, date_published) >= date_application THEN CASE WHEN date_conditions IS NULL THEN 0 ELSE 1 END END AS event FROM app)"""


def _km(by: str) -> str:
    return f"""{_TIMED},
 g AS (SELECT {by} AS "group", time_days AS t, sum(event) AS d, count(*) AS c FROM t WHERE time_days IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, sum(c) OVER (PARTITION BY "group" ORDER BY t DESC) AS n FROM g),
 s AS (SELECT "group", t, n, d, product(1 - d / n) OVER w AS s, coalesce(sum(CASE WHEN n > d THEN d / (n * (n - d)) ELSE 0 END) OVER w, 0) AS v FROM (SELECT "group", t, CAST(n AS DOUBLE) AS n, CAST(d AS DOUBLE) AS d FROM r WHERE d > 0) x WINDOW w AS (PARTITION BY "group" ORDER BY t)),
 k AS (SELECT "group", t, CAST(n AS BIGINT) AS n_at_risk, CAST(d AS BIGINT) AS events, s, greatest(0, s - 1.959963984540054 * CASE WHEN s > 0 THEN s * sqrt(v) ELSE 0 END) AS lo, least(1, s + 1.959963984540054 * CASE WHEN s > 0 THEN s * sqrt(v) ELSE 0 END) AS hi FROM s)"""


def _km_by(by: str, least: int) -> str:
    return f"""{_km(by)},
 z AS (SELECT "group", sum(c) AS n, sum(d) AS events FROM g GROUP BY 1 HAVING sum(c) >= {least}),
 m AS (SELECT "group", min(CASE WHEN s <= 0.5 THEN t END) AS median, min(CASE WHEN lo <= 0.5 THEN t END) AS median_lower, min(CASE WHEN hi <= 0.5 THEN t END) AS median_upper FROM k GROUP BY 1)
SELECT z."group", CAST(n AS BIGINT) AS n, CAST(events AS BIGINT) AS events, CAST(n - events AS BIGINT) AS censored, round((n - events) / CAST(n AS DOUBLE), 6) AS censored_share, CAST(median AS DOUBLE) AS median, CAST(median_lower AS DOUBLE) AS median_lower, CAST(median_upper AS DOUBLE) AS median_upper
FROM z LEFT JOIN m ON z."group" = m."group" """


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.processing_time(view(spark, sf_dir, "app"))


@query(_TIMED + " SELECT _seq, CAST(time_days AS BIGINT) AS time_days, CAST(event AS BIGINT) AS event, date_published AS as_at FROM t", "app")
def processing_time(spark, sf_dir):
    return _timed(spark, sf_dir).select("_seq", F.col("time_days").cast("long"), F.col("event").cast("long"), "as_at")


@query(_km_by("resource_class", 30), "app")
def km_by_class(spark, sf_dir):
    return survival.km_summary(_timed(spark, sf_dir), ["resource_class"], 30)


@query(_km_by("resource_class || ' / ' || voltage_level", 30), "app")
def km_by_class_voltage(spark, sf_dir):
    return survival.km_summary(_timed(spark, sf_dir), ["resource_class", "voltage_level"], 30)


@query(_km("resource_class") + ' SELECT "group", CAST(t AS BIGINT) AS t, n_at_risk, events, floor(s * 1e9 + 0.5) / 1e9 AS s, floor(lo * 1e9 + 0.5) / 1e9 AS s_lower, floor(hi * 1e9 + 0.5) / 1e9 AS s_upper FROM k', "app")
def km_table(spark, sf_dir):
    t = survival.km_table(_timed(spark, sf_dir), ["resource_class"])
    # engines round ties in their own ways
    near = lambda c: F.floor(F.col(c) * 1e9 + 0.5) / 1e9
    return t.select("group", F.col("t").cast("long"), F.col("n_at_risk").cast("long"), F.col("events").cast("long"), near("S").alias("s"), near("S_lower").alias("s_lower"), near("S_upper").alias("s_upper"))


@query(_TIMED + " SELECT publisher, resource_class, count(*) AS n, quantile_cont(CAST(time_days AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(time_days AS DOUBLE), 0.5) AS median, quantile_cont(CAST(time_days AS DOUBLE), 0.75) AS q75 FROM t WHERE event = 1 GROUP BY 1, 2 HAVING count(*) >= 30", "app")
def complete_case_medians(spark, sf_dir):
    return survival.complete_case_medians(_timed(spark, sf_dir), ["publisher", "resource_class"])


# ---------------------------------------------------------------- quality

_RULES = {
    "R1": "CASE WHEN coalesce(date_application > date_conditions, FALSE) OR coalesce(date_conditions > date_agreement, FALSE) OR coalesce(date_agreement > date_energisation, FALSE) THEN 1 ELSE 0 END",
    "R2": "CASE WHEN coalesce(_date_expiry > CAST(date_conditions + INTERVAL 2 YEAR AS DATE), FALSE) THEN 1 ELSE 0 END + CASE WHEN coalesce(date_agreement > CAST(date_conditions + INTERVAL 2 YEAR AS DATE), FALSE) THEN 1 ELSE 0 END",
    "R4": "CASE WHEN coalesce(capacity_injected <> 0 AND (capacity_injected < 1 OR capacity_injected > 5000000), FALSE) OR coalesce(capacity_withdrawn <> 0 AND (capacity_withdrawn < 1 OR capacity_withdrawn > 5000000), FALSE) THEN 1 ELSE 0 END",
    "R5": "CASE WHEN NOT coalesce(least(date_application, date_conditions, date_refusal, date_agreement, date_energisation, date_published, _date_expiry) >= DATE '1990-01-01', TRUE) OR NOT coalesce(greatest(date_application, date_conditions, date_refusal, date_agreement, date_energisation, date_published, _date_expiry) <= DATE '2100-01-01', TRUE) OR coalesce(capacity_injected < 0, FALSE) OR coalesce(capacity_withdrawn < 0, FALSE) THEN 1 ELSE 0 END",
    "R7": "CASE WHEN application_id IS NULL OR location_text IS NULL OR resource_class IS NULL OR process_status IS NULL OR (capacity_injected IS NULL AND capacity_withdrawn IS NULL) THEN 1 ELSE 0 END",
    "R8": "CASE WHEN process_status = 'BOGUS' THEN 1 ELSE 0 END",
}
_R3 = """, shown AS (SELECT publisher, max(CASE WHEN date_conditions IS NOT NULL THEN 1 ELSE 0 END) AS c, max(CASE WHEN date_refusal IS NOT NULL THEN 1 ELSE 0 END) AS f FROM app GROUP BY 1),
 r3 AS (SELECT a.publisher, CASE WHEN (process_status = 'CONDITIONS_ISSUED' AND ((s.c = 1 AND date_conditions IS NULL) OR date_refusal IS NOT NULL)) OR (process_status = 'REFUSED' AND ((s.f = 1 AND date_refusal IS NULL) OR date_agreement IS NOT NULL OR date_energisation IS NOT NULL))
   OR (process_status IN ('APPLICATION_FILED', 'UNDER_REVIEW') AND (date_agreement IS NOT NULL OR date_energisation IS NOT NULL)) THEN 1 ELSE 0 END AS v FROM app a JOIN shown s ON a.publisher = s.publisher)"""
_R6 = "SELECT count(*) - count(DISTINCT application_id) FROM app"


def _rule(code: str) -> None:
    sql = f"{_R3} SELECT 'R3' AS code, CAST(sum(v) AS BIGINT) AS violations FROM r3" if code == "R3" else f" SELECT 'R6' AS code, ({_R6}) AS violations" if code == "R6" else f" SELECT '{code}' AS code, CAST(sum({_RULES[code]}) AS BIGINT) AS violations FROM app"

    def run(spark, sf_dir):
        return quality.run_quality(view(spark, sf_dir, "app"), only=(code,)).select("code", "violations")

    run.__name__ = f"rule_{code.lower()}"
    query(sql, "app")(run)


for _code in ("R1", "R2", "R3", "R4", "R5", "R6", "R7", "R8"):
    _rule(_code)

_FAULTS = (
    ("CONDITIONS_ISSUED", "missing", "date_conditions", "s.c = 1 AND date_conditions IS NULL"),
    ("CONDITIONS_ISSUED", "unexpected", "date_refusal", "date_refusal IS NOT NULL"),
    ("REFUSED", "missing", "date_refusal", "s.f = 1 AND date_refusal IS NULL"),
    *((status, "unexpected", c, f"{c} IS NOT NULL") for status in ("REFUSED", "APPLICATION_FILED", "UNDER_REVIEW") for c in ("date_agreement", "date_energisation")),
)


@query(_R3 + ", d AS (" + " UNION ALL ".join(f"SELECT '{status}' AS status, '{fault}' AS fault, '{c}' AS field, count(*) AS n FROM app a JOIN shown s ON a.publisher = s.publisher WHERE process_status = '{status}' AND {wrong}" for status, fault, c, wrong in _FAULTS) + ") SELECT * FROM d WHERE n > 0 ORDER BY n DESC, status, fault, field LIMIT 20", "app")
def rule_r3_details(spark, sf_dir):
    return quality.r3_details(view(spark, sf_dir, "app"))


_LACKS = (*((c, f"{c} IS NULL") for c in ("application_id", "location_text", "resource_class", "process_status")), ("at least one of: capacity_withdrawn, capacity_injected", "capacity_injected IS NULL AND capacity_withdrawn IS NULL"))


@query(", d AS (" + " UNION ALL ".join(f"SELECT 'APPLICATION' AS entity, '{label}' AS field, count(*) AS n FROM app WHERE {lack}" for label, lack in _LACKS) + ") SELECT * FROM d WHERE n > 0", "app")
def rule_r7_details(spark, sf_dir):
    return quality.r7_details(view(spark, sf_dir, "app"))


@query(_R3 + "".join(f" {'UNION ALL ' if i else ''}SELECT publisher, '{c}' AS code, CAST(sum({s}) AS BIGINT) AS violations FROM app GROUP BY 1" for i, (c, s) in enumerate(_RULES.items())) + " UNION ALL SELECT publisher, 'R3' AS code, CAST(sum(v) AS BIGINT) AS violations FROM r3 GROUP BY 1 UNION ALL SELECT publisher, 'R6' AS code, count(*) - count(DISTINCT application_id) AS violations FROM app GROUP BY 1", "app")
def quality_by_publisher(spark, sf_dir):
    return quality.quality_by_publisher(view(spark, sf_dir, "app"))


@query(", d AS (SELECT datediff('day', CAST(date_conditions + INTERVAL 2 YEAR AS DATE), _date_expiry) AS d FROM app WHERE _date_expiry > CAST(date_conditions + INTERVAL 2 YEAR AS DATE)) SELECT count(*) AS n, CAST(list_sort(list(d))[count(*) // 2 + 1] AS BIGINT) AS median, CAST(min(d) AS BIGINT) AS least, CAST(max(d) AS BIGINT) AS most, count(*) FILTER (WHERE d > 30) AS beyond_30 FROM d", "app")
def surplus_days(spark, sf_dir):
    return quality.surplus_days(view(spark, sf_dir, "app")).select("n", *[F.col(c).cast("long") for c in ("median", "least", "most", "beyond_30")])


@query(", n AS (SELECT application_id, count(*) AS n FROM app GROUP BY 1) SELECT CAST(sum(n - 1) AS BIGINT) AS violations, count(*) AS n_unique, count(*) FILTER (WHERE n > 1) AS n_repeated, CAST(max(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS max_multiplicity FROM n", "app")
def dup_identifiers(spark, sf_dir):
    return quality.duplicates(view(spark, sf_dir, "app")).withColumn("max_multiplicity", F.col("max_multiplicity").cast("long"))


@query(" SELECT NULL AS field, count(*) AS rows FROM app WHERE voltage_level IN ('none') UNION ALL SELECT unnest(['date_application', 'date_conditions', 'date_refusal', 'date_agreement', 'date_energisation', 'capacity_injected', 'capacity_withdrawn', 'resource_class', 'process_status', 'voltage_level']) AS field, 0 AS rows", "app")
def column_shift(spark, sf_dir):
    return quality.column_shift(view(spark, sf_dir, "app"))


@query(""" , s AS (SELECT CASE WHEN _seq % 9 = 0 THEN CAST(date_application AS STRING) ELSE process_status END AS process_status, CASE WHEN _seq % 10 = 0 THEN resource_class ELSE CAST(CAST(capacity_injected AS BIGINT) AS STRING) END AS capacity_injected, _seq FROM app)
 SELECT 'process_status' AS field, count(*) AS rows FROM s WHERE _seq % 9 = 0 AND process_status IS NOT NULL UNION ALL SELECT 'capacity_injected' AS field, count(*) AS rows FROM s WHERE _seq % 10 = 0 UNION ALL SELECT NULL AS field, count(*) AS rows FROM s WHERE (_seq % 9 = 0 AND process_status IS NOT NULL) OR _seq % 10 = 0""", "app")
def column_shift_planted(spark, sf_dir):
    app = view(spark, sf_dir, "app")
    moved = app.select(
        F.when(F.col("_seq") % 9 == 0, F.col("date_application").cast("string")).otherwise(F.col("process_status")).alias("process_status"),
        F.when(F.col("_seq") % 10 == 0, F.col("resource_class")).otherwise(F.col("capacity_injected").cast("long").cast("string")).alias("capacity_injected"),
    )
    return quality.column_shift(moved)


# ---------------------------------------------------------------- panel


@query(f" SELECT count(*) AS n_rows, count(*) - CAST(sum({_RULES['R7']}) AS BIGINT) AS n_core, CAST(0 AS BIGINT) AS n_negative, CAST(0 AS BIGINT) AS n_bad_resource_class, CAST(sum({_RULES['R8']}) AS BIGINT) AS n_bad_process_status FROM app", "app")
def validate_panel(spark, sf_dir):
    return panel.validate(view(spark, sf_dir, "app"))


@query(f" SELECT _seq, ({_RULES['R7']}) = 0 AS complete FROM app", "app")
def core_complete(spark, sf_dir):
    app = view(spark, sf_dir, "app")
    return app.select("_seq", panel.core_complete(app).alias("complete"))


_HAVE = [f.name for f in panel.FIELDS if f.name in ("application_id", "node_id", "location_text", "voltage_level", "resource_class", "capacity_injected", "capacity_withdrawn", "process_status", "date_application", "date_conditions", "date_refusal", "date_agreement", "date_energisation", "date_published")]


@query(" " + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n_filled, round(count({c}) / CAST(count(*) AS DOUBLE), 6) AS share FROM app" for c in _HAVE), "app")
def completion_report(spark, sf_dir):
    return panel.completion_report(view(spark, sf_dir, "app"))


@query(" " + " UNION ALL ".join(f"SELECT publisher, CAST(grouping(publisher) AS BIGINT) AS is_total, count(*) AS n, '{c}' AS field, round(count({c}) / CAST(count(*) AS DOUBLE), 4) AS share FROM app GROUP BY GROUPING SETS ((publisher), ())" for c in _HAVE), "app")
def field_coverage(spark, sf_dir):
    return panel.field_coverage(view(spark, sf_dir, "app")).withColumn("is_total", F.col("is_total").cast("long"))


@query(" SELECT source, count(*) AS n, count(node_id) AS nodes, count(application_id) AS applications FROM (SELECT 'app' AS source, application_id, node_id FROM app UNION ALL SELECT 'node' AS source, NULL AS application_id, node_name AS node_id FROM node) x GROUP BY 1", "app", "node")
def scan_panel_union(spark, sf_dir):
    app = panel.finalize(view(spark, sf_dir, "app"), "orders", "X", "app")
    own = panel.finalize(view(spark, sf_dir, "node").withColumn("node_id", F.col("node_name")).withColumn("_entity", F.lit("NODE")), "nodes", "X", "node")
    return panel.union_panels([app, own]).groupBy(F.col("source_document").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count("node_id").alias("nodes"), F.count("application_id").alias("applications"))


@query(" SELECT application_id, location_text, capacity_injected, CAST(NULL AS DOUBLE) AS capacity_reserved, 'P' AS publisher, 'J' AS jurisdiction, 'D' AS source_document, _seq FROM app", "app")
def finalize_columns(spark, sf_dir):
    return panel.finalize(view(spark, sf_dir, "app"), "P", "J", "D").select("application_id", "location_text", "capacity_injected", "capacity_reserved", "publisher", "jurisdiction", "source_document", "_seq")


@query(" SELECT 'process_status' AS field, process_status AS value, count(*) AS n FROM app WHERE process_status = 'BOGUS' GROUP BY 2", "app")
def outside_vocabulary(spark, sf_dir):
    return panel.outside_vocabulary(view(spark, sf_dir, "app"))


@query(f" SELECT count(*) AS n_rows, CAST(22 AS BIGINT) AS n_columns, count(DISTINCT publisher) AS n_publishers, CAST(" + " + ".join(f"CASE WHEN count({c}) > 0 THEN 1 ELSE 0 END" for c in _HAVE) + f" AS BIGINT) AS n_fields_filled, count(*) - CAST(sum({_RULES['R7']}) AS BIGINT) AS n_core FROM app", "app")
def panel_summary(spark, sf_dir):
    return panel.summary(view(spark, sf_dir, "app"))


@query(" SELECT count(*) AS n, least(count(date_application), count(date_conditions)) / CAST(count(*) AS DOUBLE) AS coverage FROM app", "app")
def date_coverage(spark, sf_dir):
    return survival.date_coverage(view(spark, sf_dir, "app"))


@query(_km_by("resource_class", 30) + " ORDER BY n DESC, 1 LIMIT 3", "app")
def km_largest(spark, sf_dir):
    return survival.km_summary(_timed(spark, sf_dir), ["resource_class"], 30, max_groups=3)


@query(""", c AS (SELECT count(*) AS n, least(count(date_application), count(date_conditions)) AS d, count(process_status) AS s, count(resource_class) FILTER (WHERE resource_class IS NOT NULL) AS r FROM app)
 SELECT unnest(['field_coverage', 'quality_rules', 'column_shift', 'status_distribution', 'capacity_by_class', 'processing_time', 'location_resolution', 'node_loading']) AS chart,
  unnest([NULL, NULL, NULL, CASE WHEN s = 0 THEN 'no process status disclosed' END, CASE WHEN r = 0 THEN 'no resource class disclosed' END, CASE WHEN d < 0.8 * n THEN printf('date coverage %.1f%% is below the 80%% inclusion criterion', 100.0 * d / n) END, 'no coordinates', 'needs both node rows and application rows']) AS reason FROM c""", "app")
def chart_inclusion(spark, sf_dir):
    return chartdata.chart_inclusion(view(spark, sf_dir, "app"))


# ---------------------------------------------------------------- editions

_PAIRS = """, fa AS (SELECT publisher p, location_text l, voltage_level v, resource_class r, capacity_injected i, capacity_withdrawn w, arg_min(coalesce(process_status, ''), _seq) AS s, arg_min(coalesce(_applicant, ''), _seq) AS ap, arg_min(coalesce(_facility_name, ''), _seq) AS fn, min(_seq) AS q, count(*) AS n FROM ed_a GROUP BY ALL),
 fb AS (SELECT publisher p, location_text l, voltage_level v, resource_class r, capacity_injected i, capacity_withdrawn w, arg_min(coalesce(process_status, ''), _seq) AS s, arg_min(coalesce(_applicant, ''), _seq) AS ap, arg_min(coalesce(_facility_name, ''), _seq) AS fn, min(_seq) AS q, count(*) AS n FROM ed_b GROUP BY ALL),
 x AS (SELECT fa.s AS sa, fb.s AS sb, fa.n AS na, fb.n AS nb, fa.ap AS apa, fb.ap AS apb, fa.fn AS fna, fb.fn AS fnb FROM fa FULL OUTER JOIN fb ON fa.p IS NOT DISTINCT FROM fb.p AND fa.l IS NOT DISTINCT FROM fb.l AND fa.v IS NOT DISTINCT FROM fb.v AND fa.r IS NOT DISTINCT FROM fb.r AND fa.i IS NOT DISTINCT FROM fb.i AND fa.w IS NOT DISTINCT FROM fb.w),
 o AS (SELECT *, CASE sa WHEN 'APPLICATION_FILED' THEN 0 WHEN 'UNDER_REVIEW' THEN 2 WHEN 'CONDITIONS_ISSUED' THEN 3 END AS oa, CASE sb WHEN 'APPLICATION_FILED' THEN 0 WHEN 'UNDER_REVIEW' THEN 2 WHEN 'CONDITIONS_ISSUED' THEN 3 END AS ob FROM x)"""


@query(_PAIRS + """ SELECT CAST(sum(na) AS BIGINT) AS rows_a, CAST(sum(nb) AS BIGINT) AS rows_b, count(na) AS unique_a, count(nb) AS unique_b, count(*) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL) AS shared, count(*) FILTER (WHERE na IS NULL) AS new, count(*) FILTER (WHERE nb IS NULL) AS gone,
 count(*) FILTER (WHERE sa <> sb) AS status_changes, count(*) FILTER (WHERE na IS NULL AND sb = 'REFUSED') AS new_closed, count(*) FILTER (WHERE nb IS NULL AND oa IS NOT NULL) AS gone_active, count(*) FILTER (WHERE sa <> sb AND ob < oa) AS backward,
 CAST(sum(CASE WHEN na > 1 THEN na ELSE 0 END) AS BIGINT) AS collision_rows_a, CAST(sum(CASE WHEN nb > 1 THEN nb ELSE 0 END) AS BIGINT) AS collision_rows_b, count(*) FILTER (WHERE sa <> sb AND (ob > oa OR (oa IS NOT NULL AND sb = 'REFUSED'))) / CAST(count(*) FILTER (WHERE sa <> sb AND oa IS NOT NULL AND (ob IS NOT NULL OR sb = 'REFUSED')) AS DOUBLE) AS forward_share,
 count(*) FILTER (WHERE sa <> sb AND ob < oa) = 0 AND count(*) FILTER (WHERE nb IS NULL AND oa IS NOT NULL) = 0 AS is_monotone FROM o""", "ed_a", "ed_b")
def edition_flows(spark, sf_dir):
    return editions.compare(view(spark, sf_dir, "ed_a"), view(spark, sf_dir, "ed_b"))


@query(_PAIRS + " SELECT sa AS status_a, sb AS status_b, count(*) AS n, CASE WHEN sa = sb THEN 'same' WHEN oa IS NOT NULL AND (coalesce(ob > oa, FALSE) OR sb = 'REFUSED') THEN 'forward' WHEN ob < oa THEN 'backward' ELSE 'unordered' END AS direction FROM o WHERE sa IS NOT NULL AND sb IS NOT NULL GROUP BY 1, 2, 4", "ed_a", "ed_b")
def edition_transitions(spark, sf_dir):
    return editions.transitions(view(spark, sf_dir, "ed_a"), view(spark, sf_dir, "ed_b"))


_CORE = "regexp_replace(replace(upper({c}), ' S.A.', ''), '[^A-Z0-9]+', '', 'g')"
_AUDIT = _PAIRS + f", c AS (SELECT {_CORE.format(c='apa')} AS a1, {_CORE.format(c='apb')} AS b1, {_CORE.format(c='fna')} AS a2, {_CORE.format(c='fnb')} AS b2, upper(apa) AS xa, upper(apb) AS xb, upper(fna) AS ya, upper(fnb) AS yb FROM o WHERE na IS NOT NULL AND nb IS NOT NULL)"


@query(_AUDIT + """, w AS (SELECT CASE WHEN a1 <> '' AND b1 <> '' AND NOT contains(a1, b1) AND NOT contains(b1, a1) THEN 1 ELSE 0 END + CASE WHEN a2 <> '' AND b2 <> '' AND NOT contains(a2, b2) AND NOT contains(b2, a2) THEN 1 ELSE 0 END AS k FROM c)
 SELECT count(*) AS pairs, count(*) FILTER (WHERE k = 0) AS confirmed, count(*) FILTER (WHERE k = 1) AS uncertain, count(*) FILTER (WHERE k = 2) AS false_matches, count(*) FILTER (WHERE k = 0) / CAST(count(*) AS DOUBLE) AS precision_lower, count(*) FILTER (WHERE k < 2) / CAST(count(*) AS DOUBLE) AS precision_upper FROM w""", "ed_a", "ed_b")
def linkage_audit(spark, sf_dir):
    return editions.linkage_audit(view(spark, sf_dir, "ed_a"), view(spark, sf_dir, "ed_b"))


@query(_AUDIT + """, d AS (SELECT '_applicant' AS field, xa AS x, xb AS y, a1 AS p, b1 AS q FROM c UNION ALL SELECT '_facility_name' AS field, ya AS x, yb AS y, a2 AS p, b2 AS q FROM c)
 SELECT field, CASE WHEN x = '' OR y = '' THEN 'one_sided_supplement' WHEN p = q THEN 'alternate_spelling_same_name' WHEN contains(p, q) OR contains(q, p) THEN 'name_extended_or_short' ELSE 'content_conflict' END AS category, count(*) AS n FROM d WHERE x <> y GROUP BY 1, 2""", "ed_a", "ed_b")
def linkage_discrepancies(spark, sf_dir):
    return editions.linkage_discrepancies(view(spark, sf_dir, "ed_a"), view(spark, sf_dir, "ed_b"), held_out=editions.IDENTITY)


_REST = """, k AS (SELECT publisher, location_text, voltage_level, resource_class, capacity_injected, capacity_withdrawn FROM ed_a INTERSECT SELECT publisher, location_text, voltage_level, resource_class, capacity_injected, capacity_withdrawn FROM ed_c),
 m AS (SELECT publisher p, coalesce(location_text, '') l, voltage_level v, resource_class r, coalesce(capacity_injected, -1) i, coalesce(capacity_withdrawn, -1) w FROM k),
 ra AS (SELECT upper(trim(coalesce(_applicant, ''))) || '|' || upper(trim(coalesce(_facility_name, ''))) AS d, e.* FROM ed_a e WHERE (publisher, coalesce(location_text, ''), voltage_level, resource_class, coalesce(capacity_injected, -1), coalesce(capacity_withdrawn, -1)) NOT IN (SELECT (p, l, v, r, i, w) FROM m)),
 rb AS (SELECT upper(trim(coalesce(_applicant, ''))) || '|' || upper(trim(coalesce(_facility_name, ''))) AS d, e.* FROM ed_c e WHERE (publisher, coalesce(location_text, ''), voltage_level, resource_class, coalesce(capacity_injected, -1), coalesce(capacity_withdrawn, -1)) NOT IN (SELECT (p, l, v, r, i, w) FROM m)),
 ua AS (SELECT d FROM ra GROUP BY d HAVING count(*) = 1), ub AS (SELECT d FROM rb GROUP BY d HAVING count(*) = 1)"""


@query(_REST + """ SELECT (SELECT count(*) FROM (SELECT DISTINCT publisher, location_text, voltage_level, resource_class, capacity_injected, capacity_withdrawn FROM ed_a) t) AS unique_a, (SELECT count(*) FROM (SELECT DISTINCT publisher, location_text, voltage_level, resource_class, capacity_injected, capacity_withdrawn FROM ed_c) t) AS unique_b,
 (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM ua JOIN ub ON ua.d = ub.d) AS recovered, (SELECT count(*) FROM m) / CAST((SELECT count(*) FROM m) + (SELECT count(*) FROM ua JOIN ub ON ua.d = ub.d) AS DOUBLE) AS sensitivity""", "ed_a", "ed_c")
def linkage_recall(spark, sf_dir):
    return editions.linkage_recall(view(spark, sf_dir, "ed_a"), view(spark, sf_dir, "ed_c"))


@query(" SELECT count(*) AS n_rows, count(DISTINCT (publisher, coalesce(location_text, ''), voltage_level, resource_class, coalesce(capacity_injected, -1), coalesce(capacity_withdrawn, -1))) AS n_keys FROM app", "app")
def surrogate_key_stats(spark, sf_dir):
    keyed = editions.with_key(view(spark, sf_dir, "app"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


_SPLIT_APP = "SELECT _seq, 'P' AS publisher, CASE WHEN _seq % 10 = 9 THEN 'NODE' ELSE 'APPLICATION' END AS _entity, CASE WHEN _seq % 50 = 7 THEN NULL WHEN _seq % 10 = 9 THEN CAST('2024-01-01' AS DATE) + CAST(_seq % 400 AS INT) ELSE CASE WHEN _seq % 3 = 0 THEN CAST('2024-03-31' AS DATE) WHEN _seq % 3 = 1 THEN CAST('2024-06-30' AS DATE) ELSE CAST('2024-09-30' AS DATE) END END AS date_published FROM app"


@query(f""", e AS ({_SPLIT_APP}), d AS (SELECT DISTINCT date_published AS d FROM e WHERE _entity <> 'NODE' AND date_published IS NOT NULL)
 SELECT e._seq, CASE WHEN e.date_published IS NULL THEN (SELECT max(d) FROM d) ELSE arg_min(d.d, abs(datediff('day', d.d, e.date_published)) * 100000 - datediff('day', DATE '2000-01-01', d.d)) END AS edition FROM e CROSS JOIN d GROUP BY e._seq, e.date_published""", "app")
def split_editions(spark, sf_dir):
    app = view(spark, sf_dir, "app")
    return editions.split_editions(spark.sql(_SPLIT_APP.replace("FROM app", "FROM {app}"), app=app)).select("_seq", "edition")


@query(_PAIRS + """ SELECT 'shared' AS segment, 'both' AS edition, count(*) AS n FROM o WHERE na IS NOT NULL AND nb IS NOT NULL UNION ALL SELECT 'gone' AS segment, 'a' AS edition, count(*) AS n FROM o WHERE nb IS NULL UNION ALL SELECT 'new' AS segment, 'b' AS edition, count(*) AS n FROM o WHERE na IS NULL
 UNION ALL SELECT 'repeated' AS segment, 'a' AS edition, CAST(sum(na - 1) AS BIGINT) AS n FROM o UNION ALL SELECT 'repeated' AS segment, 'b' AS edition, CAST(sum(nb - 1) AS BIGINT) AS n FROM o""", "ed_a", "ed_b")
def chart_edition_flows(spark, sf_dir):
    return chartdata.edition_flows(editions.compare(view(spark, sf_dir, "ed_a"), view(spark, sf_dir, "ed_b")))


# ---------------------------------------------------------------- nodes

_MAP = """, sm AS (SELECT _group_no AS g, node_name, station, lower(station) AS norm, _seq FROM node_station)"""
_ASSIGN = _MAP + """, q AS (SELECT DISTINCT location_text AS t, CASE WHEN location_text LIKE 'GPZ %' THEN lower(substr(location_text, 5)) ELSE lower(location_text) END AS norm, location_text LIKE 'w linii%' AS line FROM app WHERE location_text IS NOT NULL),
 ex AS (SELECT q.t, list(DISTINCT sm.g) AS gs FROM q JOIN sm ON q.norm = sm.norm WHERE NOT line GROUP BY 1),
 en AS (SELECT q.t, list(DISTINCT sm.g) AS gs FROM q JOIN sm ON contains(' ' || q.norm || ' ', ' ' || sm.norm || ' ') WHERE NOT line AND q.t NOT IN (SELECT t FROM ex) GROUP BY 1),
 asg AS (SELECT q.t, CASE WHEN line THEN 'LINE' WHEN len(coalesce(ex.gs, en.gs)) > 1 THEN 'AMBIGUOUS' WHEN ex.t IS NOT NULL THEN 'EXACT' WHEN en.t IS NOT NULL THEN 'EXTENDED' ELSE 'NONE' END AS m, CASE WHEN NOT line AND len(coalesce(ex.gs, en.gs)) = 1 THEN coalesce(ex.gs, en.gs)[1] END AS g FROM q LEFT JOIN ex ON q.t = ex.t LEFT JOIN en ON q.t = en.t),
 aa AS (SELECT app.*, coalesce(asg.m, 'NONE') AS group_match, asg.g AS "group" FROM app LEFT JOIN asg ON app.location_text = asg.t)"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.assign(view(spark, sf_dir, "app"), nodes.station_map(view(spark, sf_dir, "node_station")))


@query(_MAP + ' SELECT g AS "group", node_name, station, norm AS station_norm FROM sm', "node_station")
def station_node_map(spark, sf_dir):
    return nodes.station_map(view(spark, sf_dir, "node_station")).drop("_seq")


@query(_ASSIGN + ' SELECT _seq, group_match, "group" FROM aa', "app", "node_station")
def assign_nodes(spark, sf_dir):
    return _assigned(spark, sf_dir).select("_seq", "group_match", "group")


def _load(field: str, direction: str, voltage: str | None) -> str:
    where = f" AND contains(voltage_level, '{voltage}')" if voltage else ""
    return _ASSIGN + f""", ld AS (SELECT "group" AS g, sum({field}) AS req, count(*) AS n FROM aa WHERE process_status IN ('APPLICATION_FILED', 'UNDER_REVIEW', 'CONDITIONS_ISSUED') AND "group" IS NOT NULL{where} GROUP BY 1)
 SELECT n._group_no AS "group", n.node_name, n.capacity_available AS available, coalesce(ld.req, 0.0) AS requested, coalesce(ld.n, 0) AS applications, round(coalesce(ld.req, 0.0) / nullif(n.capacity_available, 0), 6) AS loading, n.capacity_available = 0 AS zero_capacity FROM node n LEFT JOIN ld ON ld.g = n._group_no WHERE n._direction = '{direction}'"""


def _loading(name: str, field: str, direction: str, voltage: str | None) -> None:
    def run(spark, sf_dir):
        return nodes.loading(_assigned(spark, sf_dir), view(spark, sf_dir, "node"), field, voltage=voltage).withColumn("loading", F.round("loading", 6))

    run.__name__ = name
    query(_load(field, direction, voltage), "app", "node_station", "node")(run)


_loading("node_loading_generation", "capacity_injected", "generation", None)
_loading("node_loading_demand", "capacity_withdrawn", "demand", None)
_loading("node_loading_110kv", "capacity_injected", "generation", "110 kV")


@query(_load("capacity_injected", "generation", None).replace(" SELECT n._group_no", ", f AS (SELECT n._group_no") + ") SELECT count(*) AS nodes, count(*) FILTER (WHERE zero_capacity) AS zero, median(loading) AS median, count(*) FILTER (WHERE loading > 1) AS above_one FROM f", "app", "node_station", "node")
def chart_loading(spark, sf_dir):
    return chartdata.loading_title(nodes.loading(_assigned(spark, sf_dir), view(spark, sf_dir, "node")).withColumn("loading", F.round("loading", 6)))


# ---------------------------------------------------------------- places

_STREETS = """, q AS (SELECT DISTINCT query, trim(substr(query, instr(query, ',') + 1)) AS street FROM queries),
 w AS (SELECT query, street, list_filter(string_split(regexp_replace(trim(regexp_replace(regexp_replace(lower(street), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')), '^ul ', 'ul '), ' '), lambda x: x NOT IN ('ul', '') AND NOT regexp_matches(x, '^[0-9]+$')) AS ts, trim(regexp_replace(regexp_replace(lower(street), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM q),
 ex AS (SELECT w.query, s.name FROM w JOIN street s ON w.norm = s.name)"""


@query(_STREETS + " SELECT query, name AS matched FROM ex", "queries", "street")
def geo_exact(spark, sf_dir):
    done = places.resolve(view(spark, sf_dir, "queries"), places.gazetteer(view(spark, sf_dir, "street")))
    return done.where("confidence = 'EXACT'").select("query", "matched")


_CASCADE = _STREETS + """, tk AS (SELECT name, unnest(string_split(name, ' ')) AS t FROM street), al AS (SELECT t, min(name) AS name FROM tk GROUP BY t HAVING count(*) = 1),
 un AS (SELECT query, min(al.name) AS name FROM (SELECT query, unnest(ts) AS t FROM w) x JOIN al ON al.t = x.t GROUP BY 1 HAVING count(DISTINCT al.name) = 1),
 su AS (SELECT w.query, min(s.name) AS name FROM w JOIN street s ON len(w.ts) > 0 AND len(list_intersect(list_distinct(w.ts), string_split(s.name, ' '))) = len(list_distinct(w.ts)) GROUP BY 1 HAVING count(DISTINCT s.name) = 1)"""


@query(_CASCADE + " SELECT w.query, CASE WHEN ex.name IS NOT NULL THEN 'EXACT' WHEN un.name IS NOT NULL THEN 'UNIQUE_TOKEN' ELSE 'TOKEN_SUBSET' END AS confidence, coalesce(ex.name, un.name, su.name) AS matched FROM w LEFT JOIN ex ON w.query = ex.query LEFT JOIN un ON w.query = un.query LEFT JOIN su ON w.query = su.query WHERE coalesce(ex.name, un.name, su.name) IS NOT NULL", "queries", "street")
def geo_cascade(spark, sf_dir):
    done = places.resolve(view(spark, sf_dir, "queries"), places.gazetteer(view(spark, sf_dir, "street")))
    return done.where("confidence IN ('EXACT', 'UNIQUE_TOKEN', 'TOKEN_SUBSET')").select("query", "confidence", "matched")


# all confidences and reasons of whole streets, of words in another order, and of crossings
_RESOLVED = _CASCADE + """, st AS (SELECT name, lat, lon, list_sort(list_distinct(string_split(name, ' '))) AS ws FROM street),
 rv AS (SELECT w.query, min(st.name) AS name FROM w JOIN st ON st.ws = list_sort(list_distinct(w.ts)) GROUP BY 1 HAVING count(DISTINCT st.name) = 1),
 ix AS (SELECT query, count(*) AS parts, count(s.name) AS hit, string_agg(s.name, ' / ') AS name, min(s.lat) AS lat, min(s.lon) AS lon FROM (SELECT query, trim(unnest(string_split(street, '/'))) AS part FROM w WHERE contains(street, '/')) x LEFT JOIN street s ON s.name = lower(part) GROUP BY 1 HAVING count(s.name) >= 2),
 kn AS (SELECT DISTINCT query FROM (SELECT query, unnest(ts) AS t FROM w) x JOIN tk ON tk.t = x.t),
 na AS (SELECT w.query, w.ts, coalesce(ex.name, un.name, su.name, rv.name) AS name, CASE WHEN ex.name IS NOT NULL THEN 'EXACT' WHEN un.name IS NOT NULL THEN 'UNIQUE_TOKEN' WHEN su.name IS NOT NULL THEN 'TOKEN_SUBSET' WHEN rv.name IS NOT NULL THEN 'REVERSED' END AS how
        FROM w LEFT JOIN ex ON w.query = ex.query LEFT JOIN un ON w.query = un.query LEFT JOIN su ON w.query = su.query LEFT JOIN rv ON w.query = rv.query),
 res AS (SELECT na.query, coalesce(na.name, ix.name) AS matched, CASE WHEN na.name IS NOT NULL THEN st.lat ELSE ix.lat END AS lat, CASE WHEN na.name IS NOT NULL THEN st.lon ELSE ix.lon END AS lon, coalesce(how, CASE WHEN ix.name IS NOT NULL THEN 'INTERSECTION' ELSE 'NONE' END) AS confidence,
        CASE WHEN na.name IS NOT NULL THEN NULL WHEN ix.name IS NOT NULL THEN 'matched ' || hit || ' of ' || parts || ' parts' WHEN len(ts) = 0 THEN 'no_distinguishing_tokens' WHEN kn.query IS NULL THEN 'no_candidates' ELSE 'multiple_candidates' END AS reason
        FROM na LEFT JOIN st ON st.name = na.name LEFT JOIN ix ON ix.query = na.query LEFT JOIN kn ON kn.query = na.query),
 rs AS (SELECT *, CASE WHEN matched IS NULL THEN NULL WHEN lat IS NOT NULL THEN 'STREET_AXIS_POINT' ELSE 'NO_GEOMETRY' END AS accuracy FROM res)"""


@query(_RESOLVED + " SELECT DISTINCT trim(query) AS query, matched, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, confidence, reason, accuracy FROM rs", "queries", "street")
def geo_resolved(spark, sf_dir):
    return places.resolve(view(spark, sf_dir, "queries"), places.gazetteer(view(spark, sf_dir, "street"))).select("query", "matched", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "confidence", "reason", "accuracy")


@query(_RESOLVED + " SELECT level, value, count(*) AS n FROM (SELECT 'confidence' AS level, confidence AS value FROM rs UNION ALL SELECT 'accuracy', accuracy FROM rs UNION ALL SELECT 'reason', reason FROM rs) x WHERE value IS NOT NULL GROUP BY 1, 2", "queries", "street")
def geo_summary(spark, sf_dir):
    return places.summarize(places.resolve(view(spark, sf_dir, "queries"), places.gazetteer(view(spark, sf_dir, "street"))))


@query(", l AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment <> 'MACHINERY') SELECT DISTINCT query, s AS locality, trim(substr(query, instr(query, ',') + 1)) AS street, CASE WHEN s IS NULL THEN 'locality_not_in_gazetteer' ELSE 'routed' END AS routed FROM queries LEFT JOIN l ON l.s = string_split(query, ',')[1]", "queries")
def geo_routing(spark, sf_dir):
    known = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct().where("name <> 'MACHINERY'")
    return places.route(view(spark, sf_dir, "queries"), known)


_PLACES = """, s AS (SELECT name, lat, lon, _seq, CASE _seq % 4 WHEN 0 THEN 'SEKOCIN NOWY' WHEN 1 THEN 'MIASTO' WHEN 2 THEN 'WOLA DOLNA' ELSE 'WOLA GORNA' END AS locality, CAST(floor(_seq / 4) AS BIGINT) % 6 AS form FROM street),
 a AS (SELECT s.*, CASE form WHEN 0 THEN locality || ', ' || name || ' 12' WHEN 1 THEN CASE WHEN _seq % 4 = 0 THEN 'SEKOCIN' WHEN _seq % 4 = 1 THEN 'MIASTO' ELSE 'WOLA' END || ', ' || name || ' 12'
   WHEN 2 THEN name WHEN 3 THEN 'ELSEWHERE, ' || name WHEN 4 THEN locality || ', qqq ' || CAST(_seq AS STRING) ELSE locality || ', ' || name END AS query FROM s)"""


@query(_PLACES + """, r AS (SELECT *, NOT (form IN (2, 3) OR (form = 1 AND _seq % 4 > 1)) AS routed FROM a), m AS (SELECT *, routed AND form <> 4 AS hit, routed AND form IN (0, 1) AND _seq % 8 < 4 AS address FROM r)
 SELECT query, CASE WHEN routed THEN locality END AS locality, CASE WHEN hit THEN name END AS matched, CASE WHEN address THEN 60.0 + _seq / 64.0 WHEN hit THEN lat WHEN routed THEN 10.5 END AS lat, CASE WHEN address THEN 30.0 + _seq / 32.0 WHEN hit THEN lon WHEN routed THEN 11.5 END AS lon,
   CASE WHEN address THEN 'house_number=12' WHEN hit THEN NULL WHEN routed THEN 'no_candidates' WHEN form = 2 THEN 'no_locality_declared' WHEN form = 3 THEN 'locality_not_in_gazetteer' ELSE 'ambiguous_locality:wola dolna|wola gorna' END AS reason,
   CASE WHEN address THEN 'ADDRESS_POINT' WHEN hit AND lat IS NOT NULL THEN 'STREET_AXIS_POINT' WHEN hit THEN 'NO_GEOMETRY' WHEN routed THEN 'LOCALITY_CENTROID' END AS accuracy FROM m""", "street")
def geo_addresses(spark, sf_dir):
    asked = spark.sql(f"WITH{_PLACES[1:]} SELECT * FROM a".replace("FROM street", "FROM {street}"), street=view(spark, sf_dir, "street"))
    known = asked.select(F.col("locality").alias("name")).distinct().withColumns({"lat": F.lit(10.5), "lon": F.lit(11.5)})
    points = asked.where("_seq % 8 < 4").select("locality", F.col("name").alias("street"), F.lit("12").alias("number"), (60.0 + F.col("_seq") / 64.0).alias("lat"), (30.0 + F.col("_seq") / 32.0).alias("lon"))
    done = places.resolve_in(asked, places.gazetteer(asked.drop("query")), known, points, allow_centroid=True)
    return done.select("query", "locality", "matched", "lat", "lon", "reason", "accuracy")


@query(" SELECT _seq AS id, round(50 + (_seq % 7) / 10.0, 6) AS lat, round(20 + (_seq % 5) / 10.0, 6) AS lon FROM street", "street")
def axis_crossing(spark, sf_dir):
    s = view(spark, sf_dir, "street").select(F.col("_seq").alias("id"), (F.lit(50.0) + F.col("_seq") % 7 / 10).alias("y"), (F.lit(20.0) + F.col("_seq") % 5 / 10).alias("x"))
    point = lambda y, x: F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lon"))
    y, x = F.col("y"), F.col("x")
    return places.axis_crossing(s.select("id", F.array(point(y, x - 1), point(y, x + 1)).alias("axis_a"), F.array(point(y - 1, x), point(y + 1, x)).alias("axis_b")))


# ---------------------------------------------------------------- functions


@query(" SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN round(o_totalprice, 2) * 1000 WHEN 2 THEN NULL WHEN 3 THEN CAST(o_orderkey AS DOUBLE) * 1000000 ELSE o_orderkey * 1000.0 + 500 END AS kw FROM orders", "base")
def power_kw_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "n/d").when(k % 5 == 1, F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(","))).when(k % 5 == 2, F.concat(k.cast("string"), F.lit("d"))).when(k % 5 == 3, F.concat(k.cast("string"), F.lit(" 000"))).otherwise(F.concat(k.cast("string"), F.lit(",5 ")))
    return _read(spark, sf_dir, "orders").select(k.alias("k"), C.power_kw(text, "MW").alias("kw"))


@query(" SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderdate AS DATE) END AS d FROM orders", "base")
def date_parse(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    forms = ["d.MM.yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "d-M-yyyy"]
    text = F.when(k % 6 == 4, "31.02.2026").when(k % 6 == 5, "nie dotyczy")
    for i, f in enumerate(forms):
        text = text.when(k % 6 == i, F.concat(F.date_format(d, f), F.lit(" r." if i == 0 else "")))
    return _read(spark, sf_dir, "orders").select(k.alias("k"), C.iso_date(text).alias("d"))


_CLASS_WORDS = ("FW", "Fotowoltaika", "magazyn energii", "Instalacja odbiorcza", "biogazownia", "bgp", "mfw", "hydro", "osd", "blok węglowy", "pv ", "")
_CLASS_CODES = ("WIND", "PV", "BESS", "LOAD", "BIOGAS", "GAS", "WIND", "HYDRO", "GRID", "OTHER", "PV", "UNSPECIFIED")
_STATUS_WORDS = ("wniosek kompletny", "wniosek niekompletny", "wniosek złożony", "odmowa wydania", "warunki przyłączenia wydane", "umowa o przyłączenie", "UMOWA O PRZYŁĄCZENIE rozwiązana", "obiekt przyłączony", "utracił ważność", "wniosek wycofany", "something", "CONNECTED")
_STATUS_CODES = ("UNDER_REVIEW", "APPLICATION_INCOMPLETE", "APPLICATION_FILED", "REFUSED", "CONDITIONS_ISSUED", "AGREEMENT_IN_FORCE", "AGREEMENT_TERMINATED", "CONNECTED", "CONDITIONS_EXPIRED", "APPLICATION_WITHDRAWN", "UNSPECIFIED", "CONNECTED")


def _pick(words: tuple[str, ...]) -> F.Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("o_orderkey") % len(words) + 1).cast("int"))


@query(f" SELECT o_orderkey AS k, {list(_CLASS_CODES)}[CAST(o_orderkey % 12 + 1 AS INT)] AS code FROM orders", "base")
def harmonize_class(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), C.harmonize_class(_pick(_CLASS_WORDS)).alias("code"))


@query(f" SELECT o_orderkey AS k, {list(_STATUS_CODES)}[CAST(o_orderkey % 12 + 1 AS INT)] AS code FROM orders", "base")
def harmonize_status(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), C.harmonize_status(_pick(_STATUS_WORDS)).alias("code"))


@query(" SELECT p_partkey AS k, lower(p_name) AS norm FROM part", "base")
def norm_name(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), C.station_name(F.concat(F.lit(" GPZ  "), F.upper("p_name"), F.lit(" (stacja)"))).alias("norm"))


@query(" SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '110 kV' WHEN 1 THEN '15 kV' WHEN 2 THEN 'SN' END AS v FROM orders", "base")
def voltage_norm(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), C.voltage(_pick(("110,0kV", "15 KV", "sn", "---"))).alias("v"))


@query(" SELECT o_orderkey AS k, round(o_totalprice, 2) AS es, CAST(o_orderkey AS DOUBLE) + 0.25 AS pt FROM orders", "base")
def number_locale(spark, sf_dir):
    es = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    pt = F.concat(F.col("o_orderkey").cast("string"), F.lit(",25"))
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), C.number(es, ".", ",").alias("es"), C.number(pt, "", ",").alias("pt"))


@query(" , t AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS a, CASE (o_orderkey // 3) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS b FROM orders) SELECT k, a OR b AS known, coalesce(a, FALSE) OR coalesce(b, FALSE) AS counted FROM t", "base")
def tri_state_or(spark, sf_dir):
    k = F.col("o_orderkey")
    three = lambda m: F.when(m == 0, True).when(m == 1, False)
    a, b = three(k % 3), three(F.floor(k / 3) % 3)
    return _read(spark, sf_dir, "orders").select(k.alias("k"), C.both_known_or(a, b).alias("known"), C.known_or(a, b).alias("counted"))


@query(" SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 > 0 THEN CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) END AS d FROM orders", "base")
def quarter_date(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 7 == 0, "5T2026").otherwise(F.concat(F.quarter("o_orderdate").cast("string"), F.lit("T"), F.year("o_orderdate").cast("string")))
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), C.quarter_end(text).alias("d"))


@query(" SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (CAST(o_orderkey AS DOUBLE) + 2.5) * 1000 END AS kw FROM orders", "base")
def multi_point_capacity(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, "-\n---").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("\n2,5; -")))
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), C.split_sum_kw(text).alias("kw"))


# ---------------------------------------------------------------- charts


@query(""", e AS (SELECT resource_class, voltage_level AS level, sum(CASE WHEN capacity_injected > 0 THEN capacity_injected ELSE coalesce(capacity_withdrawn, 0) END) / 1000 AS mw, count(*) AS n FROM app GROUP BY 1, 2), r AS (SELECT level, row_number() OVER (ORDER BY sum(mw) DESC, level) AS k FROM e GROUP BY 1)
 SELECT resource_class, CASE WHEN k <= 2 THEN e.level ELSE 'other levels' END AS hue, round(sum(mw), 3) AS mw, CAST(sum(n) AS BIGINT) AS applications FROM e JOIN r ON e.level = r.level GROUP BY 1, 2""", "app")
def capacity_by_class(spark, sf_dir):
    return chartdata.capacity_by_class(view(spark, sf_dir, "app"), top=2).withColumn("mw", F.round("mw", 3))


@query(""", c AS (SELECT publisher AS "group", process_status AS status, count(*) AS n FROM app GROUP BY 1, 2) SELECT "group", status, n, CAST(CASE status WHEN 'APPLICATION_FILED' THEN 0 WHEN 'UNDER_REVIEW' THEN 2 WHEN 'CONDITIONS_ISSUED' THEN 3 ELSE 6 END AS BIGINT) AS "order", round(n / CAST(sum(n) OVER (PARTITION BY "group") AS DOUBLE), 6) AS share FROM c""", "app")
def status_distribution(spark, sf_dir):
    return chartdata.status_distribution(view(spark, sf_dir, "app")).withColumn("order", F.col("order").cast("long"))


@query(_RESOLVED + " SELECT CASE WHEN accuracy = 'STREET_AXIS_POINT' THEN 'street point' WHEN accuracy = 'NO_GEOMETRY' THEN 'street without geometry' ELSE 'unresolved' END AS category, count(*) AS n FROM queries q JOIN rs ON rs.query = q.query GROUP BY 1", "queries", "street")
def location_category(spark, sf_dir):
    done = places.resolve(view(spark, sf_dir, "queries"), places.gazetteer(view(spark, sf_dir, "street")))
    return chartdata.location_category(places.geocode(view(spark, sf_dir, "queries"), done, "query"))


# ---------------------------------------------------------------- layout

_WORDS = "SELECT CAST(o_orderkey // 100 AS BIGINT) AS page, CAST(o_orderkey AS STRING) AS text, (o_orderkey % 4) * 60.0 + (o_orderkey % 3) AS x0, (o_orderkey % 4) * 60.0 + (o_orderkey % 3) + 20 AS x1, CAST(floor((o_orderkey % 100) / 4) * 12.0 + (o_orderkey % 2) AS DOUBLE) AS top FROM orders"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x0 = ((k % 4) * 60.0 + k % 3).cast("double")
    return _read(spark, sf_dir, "orders").select(F.floor(k / 100).alias("page"), k.cast("string").alias("text"), x0.alias("x0"), (x0 + 20).alias("x1"), (F.floor((k % 100) / 4) * 12.0 + k % 2).cast("double").alias("top"))


@query(f", w AS ({_WORDS}), e AS (SELECT DISTINCT page, x0 AS x FROM w), g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x) > 1.5 THEN 1 ELSE 0 END AS nw FROM e), c AS (SELECT page, x, sum(nw) OVER (PARTITION BY page ORDER BY x) AS k FROM g) SELECT page, CAST(k AS BIGINT) AS \"column\", round(CAST(avg(x) AS DOUBLE), 6) AS x FROM c GROUP BY 1, 2", "base")
def ruled_columns(spark, sf_dir):
    edges = _words(spark, sf_dir).select("page", "x0", F.lit(0.0).alias("top"), F.lit(10.0).alias("bottom")).distinct()
    return layout.ruled_columns(edges).withColumn("x", F.round("x", 6))


@query(f", w AS ({_WORDS}), m AS (SELECT *, min(x0) OVER (PARTITION BY page) AS m0 FROM w), a AS (SELECT page, m0, CAST(floor((x0 - m0) / 0.5) AS BIGINT) AS a, max(CAST(floor((x1 - m0) / 0.5) AS BIGINT)) AS b FROM m GROUP BY 1, 2, 3), r AS (SELECT *, max(b) OVER (PARTITION BY page ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a) SELECT page, CAST(m0 + (p + 1 + a) / 2.0 * 0.5 AS DOUBLE) AS x FROM r WHERE (a - p - 1) * 0.5 >= 4", "base")
def banded_columns(spark, sf_dir):
    return layout.banded_columns(_words(spark, sf_dir))


@query(f", w AS ({_WORDS}) SELECT page, text, CAST(least(greatest(floor((x0 + x1) / 2 / 55), 0), 3) AS BIGINT) AS \"column\" FROM w", "base")
def word_columns(spark, sf_dir):
    bounds = F.array(*[F.lit(55.0 * i) for i in range(5)])
    return _words(spark, sf_dir).select("page", "text", layout.column_of(F.col("x0"), F.col("x1"), bounds).cast("long").alias("column"))


@query(", r AS (SELECT o_orderkey // 100 AS page, o_orderkey AS seq, o_orderkey % 4 = 0 AS st, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS t FROM orders), c AS (SELECT *, greatest(1, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY seq)) AS rec FROM r) SELECT page, CAST(rec AS BIGINT) AS record, coalesce(string_agg(t, ' ' ORDER BY seq) FILTER (WHERE t <> ''), '') AS t FROM c GROUP BY 1, 2", "base")
def merge_continuation(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select(F.floor(k / 100).alias("page"), k.alias("seq"), F.when(k % 3 == 0, "").otherwise(k.cast("string")).alias("t"))
    return layout.merge_continuation(rows, F.col("seq") % 4 == 0, ["t"], ["page"]).withColumn("record", F.col("record").cast("long"))


@query(", r AS (SELECT o_orderkey // 1000 AS doc, o_orderkey AS seq, CASE WHEN o_orderkey % 9 = 0 THEN o_orderpriority END AS h FROM orders) SELECT doc, seq, last_value(h IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM r", "base")
def carry_forward(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select(F.floor(k / 1000).alias("doc"), k.alias("seq"), F.when(k % 9 == 0, F.col("o_orderpriority")).alias("h"))
    return layout.carry_forward(rows, F.col("h"), ["doc"]).select("doc", "seq", "carried")


@query(" SELECT count(*) FILTER (WHERE l_linenumber % 2 = 0) AS closed, count(*) AS checked FROM lineitem", "base")
def identity_closure(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_quantity").alias("b"), (F.col("l_quantity") * 2 + F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(1.0)).alias("t"))
    return layout.identity_closure(rows, ["a", "b"], "t")
