"""The pipeline against a brute-force version of its decisions."""

import hashlib

import duckdb
import pytest

import corpus_pipeline
from tallyloom.llm import decontaminate, entry

from .test_ops import brute_classes

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert len(stages) == 5
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    left = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    last = {}
    for i, t in left.items():
        last[t] = max(i, last.get(t, i))
    left = {i: t for t, i in last.items()}
    left = {i: left[i] for (i, c) in brute_classes(sorted(left.items())) if i == c}
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(x in t for x in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(left)
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for i, t in list(left.items())[:40]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rows_are_dropped_not_ids(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in "xyz")
    near, item = one + " end", "Plain words without any slot stand here in a row for all of us."
    table = lambda *rows: spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    exact = table((1, one), (2, one), (1, two), (3, three), (3, three), (None, two), (None, near), (None, near), (4, None), (5, ""))
    assert left(corpus_pipeline.exact(spark, exact, "")) == sorted([(2, one), (1, two), (3, three), (None, near), (5, "")], key=str)
    alike = table((1, one), (2, near), (2, two), (3, three), (3, three), (None, one), (None, two), (6, None), (6, None), (None, near + " it"))
    assert left(corpus_pipeline.near(spark, alike, "")) == sorted([(1, one), (2, two), (3, three), (6, None), (6, None)], key=str)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert left(decontaminate.keep_clean(table((1, item), (1, one), (None, "So: " + item), (None, two), (2, None)), items)) == sorted([(1, one), (None, two), (2, None)], key=str)


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(entry.ORACLES[name]).df()
    got = entry.QUERIES[name](spark, DATA).toPandas()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert key(got) == key(want)
