"""Money-in / money-out timing and red-flag features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPS, MICROS_PER_SECOND, amount_twd, clip, flag, seconds_between
from ..session import WHOLE_USER, split_busy


def transfers(fiat: DataFrame, crypto: DataFrame) -> DataFrame:
    """Fiat and crypto transfers with a TWD amount and the table they came from."""
    return fiat.select(
        F.lit("fiat").alias("src"),
        "user_id",
        F.col("created_at").alias("ts"),
        "kind",
        amount_twd("ori_samount").alias("amount"),
    ).unionByName(
        crypto.select(
            F.lit("crypto").alias("src"),
            "user_id",
            F.col("created_at").alias("ts"),
            "kind",
            amount_twd("ori_samount", "twd_srate").alias("amount"),
        )
    )


TABLES = ("fiat", "crypto")


def fund_stay(fiat: DataFrame, crypto: DataFrame, limit: int = WHOLE_USER) -> DataFrame:
    """Seconds from the last deposit to the first withdrawal strictly after it, least over tables.

    A user of at most ``limit`` transfers is one row of arrays; the few others go by days.
    """
    rows = transfers(fiat, crypto).select("src", "user_id", "ts", "kind").where(F.col("kind").isin(0, 1))
    calm, busy = split_busy(rows, limit)
    of = {s: F.col("src") == s for s in TABLES}
    us = F.unix_micros("ts")
    held = calm.groupBy("user_id").agg(
        *[F.max(F.when(of[s] & (F.col("kind") == 0), us)).alias(f"{s}_in") for s in TABLES],
        *[F.collect_list(F.when(of[s] & (F.col("kind") == 1), us)).alias(f"{s}_out") for s in TABLES],
    )
    wait = lambda s: F.array_min(F.filter(f"{s}_out", lambda x: x > F.col(f"{s}_in"))) - F.col(f"{s}_in")
    out = held.select("user_id", (F.least(*[wait(s) for s in TABLES]) / F.lit(float(MICROS_PER_SECOND))).alias("fund_stay_sec"))
    if busy is not None:
        out = out.unionByName(_stay_by_days(busy))
    return out.where("fund_stay_sec IS NOT NULL")


def _stay_by_days(transferred: DataFrame) -> DataFrame:
    """The same for users of any size.

    Days come first: they spread a busy user, and only withdrawals of the last deposit's own
    day have to be looked at one by one.
    """
    keys = ["src", "user_id", "day"]
    rows = transferred.select("src", "user_id", F.to_date("ts").alias("day"), "ts", "kind")
    daily = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("ts"))).alias("dep"), F.min(F.when(F.col("kind") == 1, F.col("ts"))).alias("wit")
    )
    last = daily.groupBy("src", "user_id").agg(F.max("dep").alias("last_dep")).where("last_dep IS NOT NULL")
    later = daily.join(last, ["src", "user_id"]).where(F.col("day") > F.to_date("last_dep")).select("src", "user_id", F.col("wit").alias("ts"), "last_dep")
    same = rows.where("kind = 1").join(last.withColumn("day", F.to_date("last_dep")), keys).where(F.col("ts") > F.col("last_dep"))
    stay = F.min(seconds_between(F.col("ts"), F.col("last_dep"))).alias("fund_stay_sec")
    return later.unionByName(same.select("src", "user_id", "ts", "last_dep")).groupBy("user_id").agg(stay)


def same_day_in_out(fiat: DataFrame, crypto: DataFrame) -> DataFrame:
    """Days with both a deposit and a withdrawal, counted per table and added."""
    return (
        transfers(fiat, crypto)
        .groupBy("src", "user_id", F.to_date("ts").alias("day"))
        .agg(F.bool_or(F.col("kind") == 0).alias("came_in"), F.bool_or(F.col("kind") == 1).alias("went_out"))
        .groupBy("user_id")
        .agg(F.count_if(F.col("came_in") & F.col("went_out")).alias("same_day_in_out_count"))
    )


def rapid_kyc_trade(users: DataFrame, fiat: DataFrame, crypto: DataFrame) -> DataFrame:
    """1 when the first transfer falls within 48 hours after KYC level 2, ends included."""
    first = transfers(fiat, crypto).groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    hours = seconds_between(F.col("first_ts"), F.col("level2_finished_at")) / 3600
    return users.join(first, "user_id", "left").select(
        "user_id", flag(hours.between(0, 48)).alias("rapid_kyc_then_trade")
    )


def _flows_of_calm(rows: DataFrame) -> DataFrame:
    """Per user: wait, sums by table, first transfer, days with both sides, and the spread of the amounts, in one aggregate."""
    is_in, is_out, day = F.col("kind") == 0, F.col("kind") == 1, F.to_date("ts")
    aggregates = [F.min("ts").alias("first_ts"), F.avg("amount").alias("m"), F.stddev_samp("amount").alias("s"), F.count("amount").alias("n")]
    for s in TABLES:
        here = F.col("src") == s
        for side, cond in (("in", here & is_in), ("out", here & is_out)):
            aggregates += [
                F.min(F.when(cond, F.col("ts"))).alias(f"{s}_first_{side}"), F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0.0)).alias(f"{s}_{side}"),
                F.collect_set(F.when(cond, day)).alias(f"{s}_days_{side}"),
            ]
    c = F.col
    wait = lambda s: F.when(c(f"{s}_first_out") >= c(f"{s}_first_in"), seconds_between(c(f"{s}_first_out"), c(f"{s}_first_in")) / 3600)
    both = lambda s: F.size(F.array_intersect(f"{s}_days_in", f"{s}_days_out")).cast("long")
    return rows.groupBy("user_id").agg(*aggregates).select(
        "user_id", F.least(*[wait(s) for s in TABLES]).alias("dep_to_first_wit_hours"), "fiat_in", "crypto_in", "crypto_out", "first_ts",
        sum((both(s) for s in TABLES[1:]), both(TABLES[0])).alias("same_day_in_out_count"), _cv().alias("tx_amount_cv"),
    )


def _cv():
    return F.when(F.col("n") < 3, F.lit(0.0)).otherwise(F.col("s") / (F.col("m") + EPS))


def _flows_of_busy(rows: DataFrame) -> DataFrame:
    """The same columns for users of any size; one shuffle by (table, user), then by user."""
    is_in, is_out = F.col("kind") == 0, F.col("kind") == 1
    # First level by day: it spreads a busy user over its days and already holds
    # everything the coarser levels need, except the spread of the amounts.
    daily = rows.groupBy("src", "user_id", F.to_date("ts").alias("day")).agg(
        F.min(F.when(is_in, F.col("ts"))).alias("first_in"),
        F.min(F.when(is_out, F.col("ts"))).alias("first_out"),
        F.min("ts").alias("first_ts"),
        F.sum(F.when(is_in, F.col("amount"))).alias("in_sum"),
        F.sum(F.when(is_out, F.col("amount"))).alias("out_sum"),
    )
    both = F.col("first_in").isNotNull() & F.col("first_out").isNotNull()
    per_table = daily.groupBy("src", "user_id").agg(
        F.min("first_in").alias("first_in"),
        F.min("first_out").alias("first_out"),
        F.min("first_ts").alias("first_ts"),
        F.coalesce(F.sum("in_sum"), F.lit(0.0)).alias("in_sum"),
        F.coalesce(F.sum("out_sum"), F.lit(0.0)).alias("out_sum"),
        F.count_if(both).alias("same_days"),
    )
    wait = F.when(
        F.col("first_out") >= F.col("first_in"), seconds_between(F.col("first_out"), F.col("first_in")) / 3600
    )
    of = {name: F.col("src") == name for name in TABLES}
    per_user = per_table.groupBy("user_id").agg(
        F.min(wait).alias("dep_to_first_wit_hours"),
        F.coalesce(F.sum(F.when(of["fiat"], F.col("in_sum"))), F.lit(0.0)).alias("fiat_in"),
        F.coalesce(F.sum(F.when(of["crypto"], F.col("in_sum"))), F.lit(0.0)).alias("crypto_in"),
        F.coalesce(F.sum(F.when(of["crypto"], F.col("out_sum"))), F.lit(0.0)).alias("crypto_out"),
        F.min("first_ts").alias("first_ts"),
        F.sum("same_days").alias("same_day_in_out_count"),
    )
    spread = rows.groupBy("user_id").agg(F.avg("amount").alias("m"), F.stddev_samp("amount").alias("s"), F.count("amount").alias("n"))
    return per_user.join(spread.select("user_id", _cv().alias("tx_amount_cv")), "user_id", "left")


def red_flag_features(users: DataFrame, fiat: DataFrame, crypto: DataFrame, limit: int = WHOLE_USER) -> DataFrame:
    """Six features for every user; a user of at most ``limit`` transfers is one row of a single aggregate."""
    calm, busy = split_busy(transfers(fiat, crypto), limit)
    per_user = _flows_of_calm(calm)
    if busy is not None:
        per_user = per_user.unionByName(_flows_of_busy(busy))
    hours = seconds_between(F.col("first_ts"), F.col("level2_finished_at")) / 3600
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        users.select("user_id", "level2_finished_at")
        .join(per_user, "user_id", "left")
        .select(
            "user_id",
            zero(F.col("dep_to_first_wit_hours")).alias("dep_to_first_wit_hours"),
            zero(clip(F.col("fiat_in") / (F.col("crypto_out") + EPS), high=100.0)).alias("twd_to_crypto_out_ratio"),
            zero(F.col("tx_amount_cv")).alias("tx_amount_cv"),
            flag(hours.between(0, 48)).alias("rapid_kyc_then_trade"),
            zero(clip(F.col("crypto_out") / (F.col("crypto_in") + EPS), high=10.0)).alias("crypto_out_in_ratio"),
            F.coalesce(F.col("same_day_in_out_count"), F.lit(0)).alias("same_day_in_out_count"),
        )
    )
