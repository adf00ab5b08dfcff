"""IP address features over fiat, crypto and order-book rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_night
from ..session import cut_lineage


def ip_usage(fiat: DataFrame, crypto: DataFrame, trades: DataFrame) -> DataFrame:
    """(user_id, ip) with the number of uses and of uses at night.

    Collapsing to distinct pairs first means a busy address or user is combined
    map-side and later steps see each pair once.
    """
    parts = [
        t.select("user_id", F.col("source_ip_hash").alias("ip"), F.col(ts).alias("ts"))
        for t, ts in ((fiat, "created_at"), (crypto, "created_at"), (trades, "updated_at"))
    ]
    rows = reduce(DataFrame.unionByName, parts).where(F.col("ip").isNotNull())
    return rows.groupBy("user_id", "ip").agg(
        F.count("*").alias("uses"), F.count_if(is_night(F.col("ts"))).alias("night_uses")
    )


def ip_shared_users(usage: DataFrame) -> DataFrame:
    """Distinct users per address."""
    return usage.groupBy("ip").agg(F.count("*").alias("ip_shared_user_count"))


def ip_features(fiat: DataFrame, crypto: DataFrame, trades: DataFrame) -> DataFrame:
    # read twice below: written once as pairs, so the three tables are read and shuffled once
    usage = cut_lineage(ip_usage(fiat, crypto, trades))
    return (
        usage.join(ip_shared_users(usage), "ip")
        .groupBy("user_id")
        .agg(
            F.count("*").alias("ip_unique_count"),
            F.sum("uses").alias("ip_total_count"),
            (F.sum("night_uses") / F.greatest(F.sum("uses"), F.lit(1))).alias("ip_night_ratio"),
            F.max("ip_shared_user_count").alias("ip_max_shared"),
        )
    )
