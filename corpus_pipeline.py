"""A corpus pipeline over documents: language ID, exact and near deduplication, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the docs of
the next one. All stages but the last return the columns of documents. Rows are dropped by their own id and text, so
a repeated doc_id takes no other text along, and rows with a null doc_id are compared too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, dart_minhash, decontaminate, exact_dedup, langid
from tallyloom.llm._common import materialize, table
from tallyloom.llm.entry import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without any letter (`und`) go. An ambiguous one stays: it is in one of two languages."""
    model = langid.fit(docs.where(~langid.held_out(docs, 5) & F.col("doc_id").isNotNull()))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return langid.identify(docs, model, prefix="_tl_").where(F.col("_tl_lang_pred") != "und").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest doc_id."""
    return exact_dedup.keep_distinct(docs, one=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the one with the least doc_id."""
    return dart_minhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, packed token ids, and what they and their decoding amount to."""
    path = tokenizer_path(spark)
    done = bpe.encode_decode(docs.select("doc_id", "text"), path)
    return done.select("doc_id", "token_ids", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("minhash", near), ("decontaminate", decontaminated), ("bpe", encoded)]

#: The stages' methods have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
