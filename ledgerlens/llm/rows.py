"""Carrying whole rows through an operator, whatever their columns are called."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_written

__all__ = ["byte_batches", "cut_lineage", "drop_written", "packed", "unpacked", "join_small"]

SMALL_ROWS = 100_000
SALTS = 256


@contextmanager
def byte_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Within the block, Spark hands a Python worker batches of about ``size`` bytes at most."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def packed(df: DataFrame, **needed: str) -> DataFrame:
    """One struct ``row`` with all columns, and copies of the needed ones under the operator's names."""
    return df.select(F.struct("*").alias("row"), *[F.col(f"`{c}`").alias(name) for name, c in needed.items()])


def unpacked(df: DataFrame, **added: Column | str) -> DataFrame:
    """The original columns and the added ones; an added name replaces a column of that name."""
    names = [f.name for f in df.schema["row"].dataType.fields if f.name.lower() not in {a.lower() for a in added}]
    return df.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in added.items()],
    )


def join_small(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner", limit: int = SMALL_ROWS) -> DataFrame:
    """Join a table of one row per key to a table in which one key may own a third of all rows.

    Broadcast when a count shows at most ``limit`` rows; otherwise the key is salted
    by ``spread`` (a well mixed integer column of ``big``) and the small side repeated.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")
