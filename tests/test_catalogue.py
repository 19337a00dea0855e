"""Every catalogue query with SQL gives the same rows as that SQL on the smallest tables."""

import math

import duckdb
import pytest

from tallyloom.plans import queries as register
from tallyloom.plans import source_queries  # noqa: F401  adds its queries to the catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(df):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "~"
        if type(v).__name__.startswith("bool"):
            return str(bool(v))
        if isinstance(v, (int, float)) or "int" in type(v).__name__ or "float" in type(v).__name__:
            return f"{float(v):.6g}"
        return str(v).replace(" 00:00:00", "")

    columns = sorted(df.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(register.ORACLES))
def test_same_as_sql(spark, oracle, name):
    assert canonical(register.QUERIES[name](spark, DATA).toPandas()) == canonical(oracle.execute(register.ORACLES[name]).df())


def test_wide_rows_of_a_larger_table(spark, tmp_path):
    keys = [1, 999, 1000, 1001, 8_999, 9_001, 1_234_567]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    want = con.execute("SELECT 'N00' || s_suppkey AS node_id, 1000.0 * (1000 + s_suppkey) + 500 AS capacity_available FROM supplier WHERE s_suppkey % 5 > 0").df()
    got = register.QUERIES["wide_rows"](spark, str(tmp_path)).select("node_id", "capacity_available").toPandas()
    assert len(got) == 6 and canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(register.QUERIES) - set(register.ORACLES)))
def test_rows_only(spark, name):
    assert register.QUERIES[name](spark, DATA).count() > 0


def test_llm_is_not_imported_by_the_rest():
    from pathlib import Path

    root = Path(register.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
