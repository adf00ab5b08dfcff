"""The per-user feature marts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import composite_risk, composite_risk_v2
from ..functions.scalars import fill_zero
from ..session import cut_by_user
from .addresses import ip_features
from .flows import fund_stay, red_flag_features
from .money import (
    crypto_features,
    crypto_features_lite,
    trading_features,
    twd_features,
    twd_features_lite,
)
from .profile import user_features, user_features_lite
from .timing import timeline_features, unified_tx


def _left_chain(users: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """All parts are keyed and hash-partitioned by user_id, so the chain shuffles only the users."""
    out = users
    for part in parts:
        out = out.join(part, "user_id", "left")
    return fill_zero(out)


def by_user(tables):
    """The tables with fiat and crypto transfers written once, users side by side: nearly all parts read them."""
    return replace(tables, fiat=cut_by_user(tables.fiat), crypto=cut_by_user(tables.crypto))


def feature_mart(tables, as_of: str, graph: DataFrame | None = None) -> DataFrame:
    """user_id and the full feature set; pass the graph feature frame to include its five columns."""
    t = by_user(tables)
    cross, temporal = timeline_features(t.users, unified_tx(t.fiat, t.crypto, t.trades, t.swaps))
    parts = [
        twd_features(t.fiat),
        crypto_features(t.crypto),
        trading_features(t.trades, t.swaps),
        ip_features(t.fiat, t.crypto, t.trades),
        fund_stay(t.fiat, t.crypto),
        cross,
        red_flag_features(t.users, t.fiat, t.crypto),
        temporal,
    ]
    if graph is not None:
        parts.insert(5, graph)
    return _left_chain(user_features(t.users, as_of), parts).withColumn("composite_risk_score", composite_risk())


def interaction_features(df: DataFrame) -> DataFrame:
    """Ten products and rules over a mart whose nulls are already 0."""
    c = F.col
    rule = lambda cond: cond.cast("int")
    many = (c("ip_unique_count") > 5) | (c("crypto_currency_diversity") > 3) | (c("twd_withdraw_ratio") > 0.7)
    return df.withColumns(
        {
            "quick_kyc_quick_withdraw": rule(
                (c("kyc_speed_sec") < 3600) & (c("fund_stay_sec") < 86400) & (c("twd_withdraw_ratio") > 0.8)
            ),
            "new_account_high_risk": rule((c("account_age_days") < 30) & many),
            "night_high_frequency": c("ip_night_ratio") * F.log1p(c("twd_dep_count") + c("crypto_wit_count")),
            "large_fast_turnover": F.log1p(c("swap_sum") + c("total_trading_volume"))
            / F.log1p(c("fund_stay_sec") + 1),
            "smurf_withdraw_pattern": c("twd_smurf_flag") * c("twd_withdraw_ratio"),
            "currency_protocol_complexity": c("crypto_currency_diversity") * c("crypto_protocol_diversity"),
            "risky_career_low_kyc": rule((c("is_high_risk_career") == 1) & (c("has_kyc_level2") == 0)),
            "withdraw_velocity": c("twd_wit_sum") / (c("fund_stay_sec") + 1),
            "ip_diversity_frequency": c("ip_unique_count") * F.log1p(c("twd_dep_count") + c("twd_wit_count")),
            "age_volume_mismatch": F.when(
                c("age") < 25, F.log1p(c("twd_dep_sum") + c("crypto_wit_sum"))
            ).otherwise(F.lit(0.0)),
        }
    )


def feature_mart_lite(tables, as_of: str, written: bool = False) -> DataFrame:
    """The sixty-feature variant; ``written``: the tables come from ``by_user``."""
    t = tables if written else by_user(tables)
    parts = [
        twd_features_lite(t.fiat),
        crypto_features_lite(t.crypto),
        trading_features(t.trades, t.swaps),
        ip_features(t.fiat, t.crypto, t.trades),
        fund_stay(t.fiat, t.crypto),
    ]
    base = _left_chain(user_features_lite(t.users, as_of), parts)
    return interaction_features(base).withColumn("composite_risk_score", composite_risk_v2())


def risk_scores(tables, as_of: str) -> DataFrame:
    """(user_id, status, risk_score): the first composite from just the features it needs."""
    t = tables
    profile = user_features_lite(t.users, as_of).select("user_id", "has_kyc_level2", "career_income_risk")
    ip = ip_features(t.fiat, t.crypto, t.trades).select("user_id", "ip_night_ratio")
    twd = twd_features(t.fiat).select("user_id", "twd_withdraw_ratio")
    coins = t.crypto.where(F.col("kind").isin(0, 1)).groupBy("user_id").agg(
        F.count_distinct("currency").alias("crypto_currency_diversity")
    )
    joined = _left_chain(profile, [twd, ip, coins]).withColumn("risk_score", composite_risk())
    return joined.join(t.users.select("user_id", "status"), "user_id").select("user_id", "status", "risk_score")
