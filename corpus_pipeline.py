"""The corpus pipeline: five stages over the documents table, each written and read again before the next.

A document stands for a risk report of the operators: doc_id is the user, text the report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, langid, lines, mixing, order_minhash
from ledgerlens.llm.queries import benchmark, mixture_weights, with_domain
from ledgerlens.session import cut_lineage


# rows of long texts that Spark hands to a Python worker at once
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go; it is trained on the labelled rows of this input."""
    _small_batches(spark)
    model = langid.train_language_model(docs, "text", "lang", "doc_id")
    return langid.keep_identified(docs, model, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    _small_batches(spark)
    return order_minhash.keep_one_each(docs, "doc_id", "text")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has already are cut out of the text; n_chars follows."""
    _small_batches(spark)
    out = lines.drop_repeated_lines(docs, "doc_id", "text")
    return _columns(out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs)


def test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, judged by the operator's rule against the whole benchmark."""
    _small_batches(spark)
    return decontaminate.decontaminate(docs, benchmark(spark, sf_dir), "text")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, with the columns of documents, copies, part_tokens and taken_tokens."""
    weights, budget = mixture_weights(spark, docs, "text")
    out = mixing.mix_to_weights(with_domain(docs), weights, budget, ("domain", "lang", "source"), "doc_id", "text")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "copies", "part_tokens", "taken_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_lines", repeated_lines),
    ("test_passages", test_passages),
    ("mixture", mixture),
]

# a trained classifier and sketches of random hashes have no SQL; tests check every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
