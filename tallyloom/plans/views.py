"""Register views over the driver's tables: the SQL text that both Spark and the oracle engine read.

The driver's tables hold no register, so orders become connection applications, part names become stations, and two
samples of the orders become two editions. {name} stands for a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_CTES: dict[str, str] = {
    "base": """
        SELECT o.o_orderkey AS k, o.o_custkey AS custkey, o.o_orderstatus AS st, CAST(o.o_orderdate AS DATE) AS od, substr(o.o_orderpriority, 1, 1) AS pr,
               min(l.l_partkey) AS pk, sum(l.l_quantity) AS q, min(CAST(l.l_shipdate AS DATE)) AS s0,
               min(CASE WHEN CAST(l.l_shipdate AS DATE) >= CAST(o.o_orderdate AS DATE) THEN CAST(l.l_shipdate AS DATE) END) AS s1
        FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
        GROUP BY o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority""",
    "app0": """
        SELECT b.k AS _seq, 'ord:' || CAST(b.k - CASE WHEN b.k % 40 = 1 THEN 1 ELSE 0 END AS STRING) AS application_id,
               CASE WHEN b.k % 13 = 0 THEN NULL WHEN b.k % 11 = 0 THEN 'w linii 110 kV relacji ' || p.p_name WHEN b.k % 7 = 0 THEN 'GPZ ' || upper(p.p_name)
                    WHEN b.k % 7 = 1 THEN 'site ' || p.p_name || ' north' ELSE p.p_name END AS location_text,
               CASE b.k % 3 WHEN 0 THEN '110 kV' WHEN 1 THEN '15 kV' ELSE 'SN' END AS voltage_level,
               CASE b.pr WHEN '1' THEN 'PV' WHEN '2' THEN 'WIND' WHEN '3' THEN 'BESS' WHEN '4' THEN 'UNSPECIFIED' ELSE 'LOAD' END AS resource_class,
               CASE WHEN b.k % 23 = 0 THEN 'BOGUS' WHEN b.k % 17 = 0 THEN 'REFUSED' WHEN b.st = 'F' THEN 'CONDITIONS_ISSUED' WHEN b.st = 'O' THEN 'UNDER_REVIEW' ELSE 'APPLICATION_FILED' END AS process_status,
               CASE WHEN b.pr = '5' THEN NULL ELSE 100.0 * b.q END AS capacity_injected, CASE WHEN b.pr = '5' THEN 100.0 * b.q END AS capacity_withdrawn,
               b.od AS date_application, CASE WHEN b.k % 37 = 0 THEN b.s0 WHEN b.st IN ('F', 'O') THEN b.s1 END AS date_conditions,
               n.n_name AS publisher, r.r_name AS jurisdiction, c.c_name AS _applicant, 'orders' AS source_document, b.k
        FROM base b JOIN {customer} c ON c.c_custkey = b.custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
             LEFT JOIN {part} p ON p.p_partkey = b.pk""",
    "app": """
        SELECT _seq, application_id, CAST(NULL AS STRING) AS node_id, location_text, voltage_level, resource_class, capacity_injected, capacity_withdrawn, process_status,
               date_application, date_conditions,
               CASE WHEN process_status = 'REFUSED' AND k % 2 = 0 THEN date_application + 40 END AS date_refusal,
               CASE WHEN k % 29 = 1 THEN date_conditions + 800 WHEN k % 29 = 2 THEN date_conditions + 90 END AS date_agreement,
               CASE WHEN k % 31 = 1 THEN date_application + 10 END AS date_energisation,
               CASE WHEN date_conditions IS NOT NULL THEN date_conditions + CASE WHEN k % 5 = 0 THEN 765 WHEN k % 5 = 1 THEN 740 ELSE 720 END END AS _date_expiry,
               CAST('2001-12-31' AS DATE) AS date_published, publisher, jurisdiction, source_document, _applicant,
               'site ' || CAST(k % 50 AS STRING) AS _facility_name, 'APPLICATION' AS _entity
        FROM app0""",
    "station": "SELECT p_name, dense_rank() OVER (ORDER BY p_name) AS r FROM (SELECT DISTINCT p_name FROM {part}) x",
    "station_group": "SELECT r % 25 AS g, p_name, r FROM station UNION ALL SELECT (r + 1) % 25 AS g, p_name, r FROM station WHERE r % 8 = 0",
    "node_station": "SELECT CAST(g AS INT) AS _group_no, 'NODE ' || CAST(g AS STRING) AS node_name, p_name AS station, r AS _seq FROM station_group",
    "node": """
        SELECT CAST(g AS INT) AS _group_no, 'NODE ' || CAST(g AS STRING) AS node_name, d.direction AS _direction,
               CAST(CASE WHEN g = 24 THEN 0 ELSE 1000 * (1 + g) END AS DOUBLE) AS capacity_available
        FROM (SELECT DISTINCT g FROM station_group) s CROSS JOIN (SELECT 'generation' AS direction UNION ALL SELECT 'demand' AS direction) d""",
    "ed_a": "SELECT * FROM app WHERE _seq % 19 <> 0",
    "ed_b": """
        SELECT _seq, application_id, node_id, location_text, voltage_level, resource_class, capacity_injected, capacity_withdrawn,
               CASE WHEN _seq % 13 = 1 AND process_status = 'UNDER_REVIEW' THEN 'CONDITIONS_ISSUED' WHEN _seq % 29 = 0 AND process_status = 'CONDITIONS_ISSUED' THEN 'UNDER_REVIEW' WHEN _seq % 31 = 0 THEN 'REFUSED' ELSE process_status END AS process_status,
               date_application, date_conditions, date_refusal, date_agreement, date_energisation, _date_expiry, date_published, publisher, jurisdiction, source_document,
               CASE WHEN _seq % 43 = 0 THEN upper(_applicant) || ' S.A.' WHEN _seq % 47 = 0 THEN NULL WHEN _seq % 53 = 0 THEN 'Other Holder' ELSE _applicant END AS _applicant,
               CASE WHEN _seq % 53 = 0 THEN 'elsewhere' ELSE _facility_name END AS _facility_name, _entity
        FROM app WHERE _seq % 17 <> 3""",
    "ed_c": "SELECT _seq, application_id, location_text, CASE WHEN _seq % 5 = 0 THEN voltage_level || ' ' ELSE voltage_level END AS voltage_level, resource_class, capacity_injected, capacity_withdrawn, process_status, publisher, _applicant, _facility_name FROM ed_b",
    "queries": "SELECT c_custkey AS _seq, c_mktsegment || ', ' || CASE c_custkey % 6 WHEN 0 THEN 'ul. ' || p.p_name WHEN 1 THEN upper(p.p_name) || ' 12' WHEN 2 THEN substr(p.p_name, 1, 4) WHEN 3 THEN p.p_name || ' / ' || p.p_name ELSE p.p_name END AS query FROM {customer} c JOIN {part} p ON p.p_partkey = c.c_custkey",
    "street": "SELECT p_name AS name, CASE WHEN r % 5 = 0 THEN NULL ELSE 50.0 + r / 64.0 END AS lat, CASE WHEN r % 5 = 0 THEN NULL ELSE 20.0 + r / 32.0 END AS lon, r AS _seq FROM station WHERE r % 3 <> 0",
}
_NEEDS = {"app0": ("base",), "app": ("app0",), "station_group": ("station",), "node_station": ("station_group",), "node": ("station_group",), "ed_a": ("app",), "ed_b": ("app",), "ed_c": ("ed_b",), "street": ("station",)}


def with_views(*names: str) -> str:
    """The WITH clause that defines the views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({_CTES[n]})" for n in order)


def oracle(sql: str, *names: str) -> str:
    """sql over views, as text for the oracle engine. A sql that begins with a comma adds its own steps."""
    head = with_views(*names).format(**{t: t for t in BASE})
    if re.search(r"\b(\w+)\([\w, ]+\) AS \(SELECT", sql):  # a step that names its columns refers to itself
        head = head.replace("WITH", "WITH RECURSIVE", 1)
    return f"{head}{sql}" if sql.lstrip().startswith(",") else f"{head} {sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables of sf_dir."""
    text = f"{with_views(name)} SELECT * FROM {name}"
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if "{" + t + "}" in text}
    return spark.sql(text, **tables)
