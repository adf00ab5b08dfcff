"""Columns of numeric vectors: which are usable, and fixed-point entries that sum exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """True for a vector whose entries are all there and finite; a null vector is not usable, an empty one is."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vec, finite), F.lit(False))


def fixed_point(vec: Column, scale: float, offset: int = 0) -> Column:
    """floor(scale * entry) + offset of each entry, as long."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint") + F.lit(offset).cast("bigint"))


def common_length(vectors: DataFrame, vec: str) -> int:
    """The length most usable vectors have (of equally frequent ones the larger); 0 without any."""
    sizes = vectors.where(usable(F.col(f"`{vec}`"))).groupBy(F.size(f"`{vec}`").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.agg(F.max(F.struct("n", "d")).alias("top")).first()["top"]
    return top["d"] if top else 0
