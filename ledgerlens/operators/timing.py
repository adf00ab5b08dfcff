"""Features over the unified transaction timeline.

A user may own a large part of all rows, so nothing here sorts a whole user in one
task. Equal (user, instant) rows collapse to a count first; windows are partitioned by
(user, hour); what crosses an hour boundary is resolved on a table with one row per
active hour, whose size per user is bounded by the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..functions.scalars import (
    EPS,
    MICROS_PER_DAY,
    MICROS_PER_HOUR,
    MICROS_PER_SECOND,
    SCALE,
    clip,
    fill_zero,
    is_weekend,
)
from ..session import WHOLE_USER, cut_lineage, split_busy

BURST_SIZE = 5


def unified_tx(fiat: DataFrame, crypto: DataFrame, trades: DataFrame, swaps: DataFrame) -> DataFrame:
    """(user_id, ts, raw_amount) over all four tables; the amount is scaled but not priced."""
    spec = (
        (fiat, "created_at", "ori_samount"),
        (crypto, "created_at", "ori_samount"),
        (trades, "updated_at", "trade_samount"),
        (swaps, "created_at", "twd_samount"),
    )
    parts = [
        t.select("user_id", F.col(ts).alias("ts"), F.col(amount).cast("long").alias("raw_amount"))
        for t, ts, amount in spec
    ]
    return reduce(DataFrame.unionByName, parts).where(F.col("ts").isNotNull())


def tx_instants(tx: DataFrame) -> DataFrame:
    """Number of transactions per (user, microsecond)."""
    return tx.groupBy("user_id", F.unix_micros("ts").alias("us")).agg(F.count("*").alias("n"))


def _hour(us="us"):
    return F.floor(F.col(us) / F.lit(float(MICROS_PER_HOUR))).cast("long")


def tx_bursts(instants: DataFrame) -> DataFrame:
    """Transactions that start a one-hour span with at least five transactions.

    Among n rows at one instant with m rows from it to an hour later, the row at
    position j sees m - j rows, so min(n, m - 4) of them qualify. Every row is placed in
    its own hour and in the one before, which makes each (user, hour) self-contained.
    """
    placed = instants.select(
        "user_id", "us", "n", _hour().alias("own"), F.explode(F.array(_hour(), _hour() - 1)).alias("hour")
    )
    ahead = Window.partitionBy("user_id", "hour").orderBy("us").rangeBetween(0, MICROS_PER_HOUR)
    counted = placed.withColumn("m", F.sum("n").over(ahead)).where(F.col("hour") == F.col("own"))
    qualifying = F.least(F.col("n"), F.greatest(F.col("m") - (BURST_SIZE - 1), F.lit(0)))
    return counted.groupBy("user_id").agg(F.sum(qualifying).alias("tx_burst_count"))


def tx_gaps(instants: DataFrame) -> DataFrame:
    """(user_id, gap in microseconds, how often) between consecutive transactions."""
    hourly = instants.withColumn("hour", _hour())
    in_hour = Window.partitionBy("user_id", "hour").orderBy("us")
    inside = (
        hourly.withColumn("gap", F.col("us") - F.lag("us").over(in_hour))
        .where(F.col("gap").isNotNull())
        .select("user_id", "gap", F.lit(1).cast("long").alias("n"))
    )
    ties = hourly.where("n > 1").select("user_id", F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("n"))
    edges = hourly.groupBy("user_id", "hour").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    by_hour = Window.partitionBy("user_id").orderBy("hour")
    between = (
        edges.withColumn("gap", F.col("lo") - F.lag("hi").over(by_hour))
        .where(F.col("gap").isNotNull())
        .select("user_id", "gap", F.lit(1).cast("long").alias("n"))
    )
    return inside.unionByName(ties).unionByName(between)


def tx_intervals(instants: DataFrame) -> DataFrame:
    """Mean, sample deviation, minimum and median of the gaps, in seconds."""
    # read by the sums and by the percentiles
    gaps = cut_lineage(tx_gaps(instants))
    # The gaps of a user add up to its time span, so both integer sums fit 38 digits.
    gap, n = F.col("gap").cast("decimal(18,0)"), F.col("n").cast("decimal(18,0)")
    sums = gaps.groupBy("user_id").agg(
        F.sum("n").alias("cnt"),
        F.sum((gap * n).cast("decimal(28,0)")).alias("s1"),
        F.sum((gap * gap * n).cast("decimal(38,0)")).cast("decimal(38,0)").alias("s2"),
        F.min("gap").alias("lo"),
    )
    mean = F.col("s1").cast("double") / F.col("cnt")
    s1 = F.col("s1").cast("decimal(19,0)")
    centred = (F.col("s2") - (s1 * s1 / F.col("cnt").cast("decimal(19,0)"))).cast("double")
    std = F.sqrt(F.greatest(centred, F.lit(0.0)) / (F.col("cnt") - 1))
    sums = sums.join(exact_percentiles(gaps, "user_id", "gap", "n", {"median": 0.5}), "user_id")
    sec = float(MICROS_PER_SECOND)
    return sums.select(
        "user_id",
        (mean / sec).alias("tx_interval_mean"),
        F.when(F.col("cnt") > 1, std / sec).otherwise(F.lit(0.0)).alias("tx_interval_std"),
        (F.col("lo") / sec).alias("tx_interval_min"),
        (F.col("median") / sec).alias("tx_interval_median"),
    )


def amount_spread(tx: DataFrame) -> DataFrame:
    """90th over 10th percentile of the positive amounts, capped at 1000."""
    values = (
        tx.where(F.col("raw_amount") > 0)
        .groupBy("user_id", "raw_amount")
        .agg(F.count("*").alias("n"))
    )
    p = exact_percentiles(values, "user_id", "raw_amount", "n", {"p90": 0.9, "p10": 0.1})
    ratio = F.col("p90") * SCALE / (F.col("p10") * SCALE + EPS)
    return p.select("user_id", clip(ratio, high=1000.0).alias("amount_p90_p10_ratio"))


def temporal_features(users: DataFrame, tx: DataFrame, instants: DataFrame | None = None) -> DataFrame:
    """Seven features for every user.

    The timeline is read five times below, so it is written once as a narrow table; pass
    it in when it exists already.
    """
    instants = cut_lineage(tx_instants(tx)) if instants is None else instants
    days = instants.groupBy("user_id").agg(
        F.count_distinct(F.floor(F.col("us") / F.lit(float(MICROS_PER_DAY)))).alias("active_days")
    )
    out = users.select("user_id")
    for part in (tx_intervals(instants), tx_bursts(instants), amount_spread(tx), days):
        out = out.join(part, "user_id", "left")
    return fill_zero(out)


def cross_table_features(instants: DataFrame, latest: int | None = None) -> DataFrame:
    """Four features; the 7 and 30 day cutoffs count back from the latest transaction of all (``latest``, if the users are only some)."""
    latest = instants.agg(F.max("us")).scalar() if latest is None else F.lit(latest)
    recent = lambda days: F.sum(
        F.when(F.col("us") >= F.col("latest") - days * MICROS_PER_DAY, F.col("n")).otherwise(F.lit(0))
    )
    weekend = is_weekend(F.timestamp_micros("us"))
    span = F.floor((F.max("us") - F.min("us")) / F.lit(float(MICROS_PER_DAY))).cast("long")
    return (
        instants.withColumn("latest", latest)
        .groupBy("user_id")
        .agg(
            F.sum("n").alias("total_tx_count"),
            span.alias("first_to_last_tx_days"),
            (F.sum(F.when(weekend, F.col("n")).otherwise(F.lit(0))) / F.sum("n")).alias("weekend_tx_ratio"),
            recent(7).alias("c7"),
            recent(30).alias("c30"),
        )
        .select(
            "user_id",
            "total_tx_count",
            "first_to_last_tx_days",
            "weekend_tx_ratio",
            ((F.col("c7") / 7) / (F.col("c30") / 30 + EPS)).alias("velocity_ratio_7d_vs_30d"),
        )
    )


CROSS = ["total_tx_count", "first_to_last_tx_days", "weekend_tx_ratio", "velocity_ratio_7d_vs_30d"]
TEMPORAL = ["tx_interval_mean", "tx_interval_std", "tx_interval_min", "tx_interval_median", "tx_burst_count", "amount_p90_p10_ratio", "active_days"]


def _between(values, share: float):
    """The interpolated percentile of a sorted array of whole numbers."""
    position = F.lit(share) * (F.size(values) - 1)
    low = F.floor(position).cast("int")
    first = F.get(values, low).cast("double")
    return first + (F.get(values, F.least(low + 1, F.size(values) - 1)).cast("double") - first) * (position - low)


def _calm_timeline(tx: DataFrame, latest: int) -> DataFrame:
    """``CROSS`` and ``TEMPORAL`` from two sorted arrays a user, so the timeline is shuffled once."""
    sec, us, amount = float(MICROS_PER_SECOND), F.unix_micros("ts"), F.col("raw_amount")
    a, n = F.col("a"), F.size("a")
    held = tx.groupBy("user_id").agg(F.sort_array(F.collect_list(us)).alias("a"), F.sort_array(F.collect_list(F.when(amount > 0, amount))).alias("v"))
    steps = held.withColumn("gaps", F.when(n > 1, F.sort_array(F.zip_with(F.slice(a, 2, n - 1), F.slice(a, 1, n - 1), lambda x, y: x - y))))
    zero, square = F.lit(0).cast("decimal(38,0)"), lambda g: g.cast("decimal(18,0)") * g.cast("decimal(18,0)")
    steps = steps.select(
        "*", F.size("gaps").cast("long").alias("cnt"), (F.array_max(a) - F.array_min(a)).alias("span"),
        F.aggregate("gaps", zero, lambda acc, g: (acc + square(g)).cast("decimal(38,0)")).alias("s2"),
    )
    s1, cnt = F.col("span").cast("decimal(19,0)"), F.col("cnt")
    centred = (F.col("s2") - (s1 * s1 / cnt.cast("decimal(19,0)"))).cast("double")
    std = F.sqrt(F.greatest(centred, F.lit(0.0)) / (cnt - 1))
    some = F.col("gaps").isNotNull()
    ahead = F.filter(F.slice(a, 1, F.greatest(n - (BURST_SIZE - 1), F.lit(0))), lambda x, i: F.get(a, i + (BURST_SIZE - 1)) - x <= MICROS_PER_HOUR)
    recent = lambda days: F.size(F.filter(a, lambda x: x >= latest - days * MICROS_PER_DAY))
    ratio = _between(F.col("v"), 0.9) * SCALE / (_between(F.col("v"), 0.1) * SCALE + EPS)
    return steps.select(
        "user_id",
        n.cast("long").alias("total_tx_count"),
        F.floor(F.col("span") / F.lit(float(MICROS_PER_DAY))).cast("long").alias("first_to_last_tx_days"),
        (F.size(F.filter(a, lambda x: is_weekend(F.timestamp_micros(x)))) / n).alias("weekend_tx_ratio"),
        ((recent(7) / 7) / (recent(30) / 30 + EPS)).alias("velocity_ratio_7d_vs_30d"),
        F.when(some, F.col("span").cast("double") / cnt / sec).alias("tx_interval_mean"),
        F.when(some, F.when(cnt > 1, std / sec).otherwise(F.lit(0.0))).alias("tx_interval_std"),
        F.when(some, F.get("gaps", F.lit(0)) / sec).alias("tx_interval_min"),
        F.when(some, _between(F.col("gaps"), 0.5) / sec).alias("tx_interval_median"),
        F.size(ahead).cast("long").alias("tx_burst_count"),
        F.when(F.size("v") > 0, clip(ratio, high=1000.0)).alias("amount_p90_p10_ratio"),
        F.size(F.array_distinct(F.transform(a, lambda x: F.floor(x / F.lit(float(MICROS_PER_DAY)))))).cast("long").alias("active_days"),
    )


def timeline_features(users: DataFrame, tx: DataFrame, limit: int = WHOLE_USER) -> tuple[DataFrame, DataFrame]:
    """``cross_table_features`` of the users with transactions and ``temporal_features`` of all users, from one pass.

    Users of at most ``limit`` transactions are arrays; the few others go through the windows by hour and the value ranges.
    """
    latest = tx.agg(F.max(F.unix_micros("ts"))).first()[0]
    calm, busy = split_busy(tx, limit)
    rows = _calm_timeline(calm, 0 if latest is None else latest)
    if busy is not None:
        rows_of_busy = cut_lineage(busy)
        instants = cut_lineage(tx_instants(rows_of_busy))
        slow = cross_table_features(instants, latest).join(temporal_features(instants.select("user_id").distinct(), rows_of_busy, instants), "user_id")
        rows = rows.unionByName(slow)
    rows = cut_lineage(rows)
    temporal = fill_zero(users.select("user_id").join(rows.select("user_id", *TEMPORAL), "user_id", "left"))
    return rows.select("user_id", *CROSS), temporal
