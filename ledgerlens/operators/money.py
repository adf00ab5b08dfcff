"""Per-user aggregates over fiat, crypto, order-book and swap amounts.

Each table is aggregated in one pass with conditional aggregates, so the deposit and
withdrawal sides share a single shuffle on user_id and never need an outer join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPS, amount_twd, clip, fill_zero


def _side(amount: Column, cond: Column, prefix: str, with_std: bool) -> list[Column]:
    v = F.when(cond, amount)
    out = [
        F.count(v).alias(f"{prefix}_count"),
        F.sum(v).alias(f"{prefix}_sum"),
        F.avg(v).alias(f"{prefix}_mean"),
        F.max(v).alias(f"{prefix}_max"),
    ]
    if with_std:
        out.insert(3, F.stddev_samp(v).alias(f"{prefix}_std"))
    return out


def _non_null_share(col: str, cond: Column) -> Column:
    return F.avg(F.when(cond, F.col(col).isNotNull().cast("double")))


def _came_in() -> Column:
    return F.col("kind") == 0


def _went_out() -> Column:
    return F.col("kind") == 1


def twd_features(fiat: DataFrame, cap: float | None = 10.0, net_flow: bool = True) -> DataFrame:
    amount = amount_twd("ori_samount")
    base = fill_zero(
        fiat.where(F.col("kind").isin(0, 1))
        .groupBy("user_id")
        .agg(
            *_side(amount, _came_in(), "twd_dep", True),
            *_side(amount, _went_out(), "twd_wit", True),
            _non_null_share("source_ip_hash", _went_out()).alias("twd_wit_ip_ratio"),
        )
    )
    ratio = F.col("twd_wit_sum") / (F.col("twd_dep_sum") + EPS)
    smurf = (F.col("twd_dep_std") < F.col("twd_dep_mean") * 0.05) & (F.col("twd_dep_count") >= 5)
    extra = {
        "twd_withdraw_ratio": ratio if cap is None else clip(ratio, high=cap),
        "twd_smurf_flag": smurf.cast("int"),
    }
    if net_flow:
        extra["twd_net_flow"] = F.col("twd_dep_sum") - F.col("twd_wit_sum")
    return base.withColumns(extra)


def twd_features_lite(fiat: DataFrame) -> DataFrame:
    """Variant: withdraw ratio not capped, no net flow."""
    return twd_features(fiat, cap=None, net_flow=False)


def _crypto_base(crypto: DataFrame) -> DataFrame:
    """Aggregates that combine map-side; a busy user is one row per task."""
    amount = amount_twd("ori_samount", "twd_srate")
    side = {"crypto_dep": F.when(_came_in(), amount), "crypto_wit": F.when(_went_out(), amount)}
    base = crypto.groupBy("user_id").agg(
        *[f(v).alias(f"{p}_{n}") for p, v in side.items() for n, f in (("count", F.count), ("sum", F.sum))],
        *[F.max(v).alias(f"{p}_max") for p, v in side.items()],
        *[F.try_divide(F.sum(v), F.count(v)).alias(f"{p}_mean") for p, v in side.items()],
        F.count_if((F.col("sub_kind") == 0) & _went_out()).alias("crypto_external_wit_count"),
        F.count_if(F.col("sub_kind") == 1).alias("crypto_internal_count"),
        F.try_divide(F.count_if(_went_out() & F.col("source_ip_hash").isNotNull()), F.count_if(_went_out())).alias("crypto_wit_ip_ratio"),
        F.count_if(F.col("kind").isin(0, 1)).alias("_known"),
    )
    return base.where(F.col("_known") > 0).drop("_known")


def _distinct_counts(crypto: DataFrame) -> DataFrame:
    """Distinct currencies, protocols, wallets (either side) and internal peers per user.

    All four meet in one shuffle of distinct (user, kind of name, name); a busy user is spread over its names.
    """
    tagged = lambda tag, col: F.struct(F.lit(tag).alias("tag"), col.cast("string").alias("id"))
    peer = F.when(F.col("sub_kind") == 1, F.col("relation_user_id"))
    named = F.array(tagged("c", F.col("currency")), tagged("q", F.col("protocol")), tagged("w", F.col("from_wallet")), tagged("w", F.col("to_wallet")), tagged("p", peer))
    counts = {"crypto_currency_diversity": "c", "crypto_protocol_diversity": "q", "crypto_wallet_hash_nunique": "w", "crypto_internal_peer_count": "p"}
    return (
        crypto.select("user_id", F.inline(named))
        .where(F.col("id").isNotNull())
        .distinct()
        .groupBy("user_id")
        .agg(*[F.count_if(F.col("tag") == tag).alias(name) for name, tag in counts.items()])
    )


def crypto_features(crypto: DataFrame) -> DataFrame:
    """Fifteen features for users with a deposit or a withdrawal."""
    out = fill_zero(_crypto_base(crypto).join(_distinct_counts(crypto), "user_id", "left"))
    sides = [f"{p}_{n}" for p in ("crypto_dep", "crypto_wit") for n in ("count", "sum")]
    return out.select(
        "user_id", *sides, "crypto_dep_max", "crypto_wit_max", "crypto_dep_mean", "crypto_wit_mean", "crypto_external_wit_count", "crypto_internal_count",
        "crypto_currency_diversity", "crypto_protocol_diversity", "crypto_wit_ip_ratio", "crypto_wallet_hash_nunique", "crypto_internal_peer_count",
    )


def crypto_features_lite(crypto: DataFrame) -> DataFrame:
    """Variant without wallet and internal-transfer counts."""
    return crypto_features(crypto).drop("crypto_wallet_hash_nunique", "crypto_internal_count")


def trading_features(trades: DataFrame, swaps: DataFrame) -> DataFrame:
    traded, swapped = amount_twd("trade_samount", "twd_srate"), amount_twd("twd_samount")
    book = trades.groupBy("user_id").agg(
        F.count(traded).alias("trading_count"),
        F.sum(traded).alias("trading_sum"),
        F.avg(traded).alias("trading_mean"),
        F.max(traded).alias("trading_max"),
        F.avg("is_buy").alias("trading_buy_ratio"),
        F.avg("is_market").alias("trading_market_order_ratio"),
    )
    quick = swaps.groupBy("user_id").agg(
        F.count(swapped).alias("swap_count"), F.sum(swapped).alias("swap_sum")
    )
    both = fill_zero(book.join(quick, "user_id", "full_outer"))
    return both.withColumn("total_trading_volume", F.col("trading_sum") + F.col("swap_sum"))
