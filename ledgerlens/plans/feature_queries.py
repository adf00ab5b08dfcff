"""Feature mart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import addresses, flows, mart, money, profile, timing
from ..session import cut_lineage
from ..sources.fixtures import AS_OF, tables
from .registry import query

USER_RATIO = "kyc_speed_sec age"
TWD_MONEY = (
    "twd_dep_sum twd_dep_mean twd_dep_std twd_dep_max twd_wit_sum twd_wit_mean twd_wit_std twd_wit_max"
)
CRYPTO_MONEY = "crypto_dep_sum crypto_dep_mean crypto_dep_max crypto_wit_sum crypto_wit_mean crypto_wit_max"
TRADE_MONEY = "trading_sum trading_mean trading_max swap_sum total_trading_volume"
TRADE_RATIO = "trading_buy_ratio trading_market_order_ratio"
RED_RATIO = "dep_to_first_wit_hours twd_to_crypto_out_ratio tx_amount_cv crypto_out_in_ratio"
TIME_MONEY = "tx_interval_mean tx_interval_std tx_interval_min tx_interval_median"
CROSS_RATIO = "weekend_tx_ratio velocity_ratio_7d_vs_30d"


@query(
    "amount_twd",
    "SELECT kind, currency, count(*) AS n, sum(amount) AS amount_sum, max(amount) AS amount_max FROM c_rows GROUP BY ALL",
    money="amount_sum amount_max",
)
def _(spark, sf):
    amount = money.amount_twd("ori_samount", "twd_srate")
    return tables(spark, sf).crypto.groupBy("kind", "currency").agg(
        F.count("*").alias("n"), F.sum(amount).alias("amount_sum"), F.max(amount).alias("amount_max")
    )


@query("user_features", "SELECT * FROM f_user", ratio=USER_RATIO)
def _(spark, sf):
    return profile.user_features(tables(spark, sf).users, AS_OF)


@query(
    "user_features_lite",
    "SELECT user_id, has_kyc_level2, kyc_speed_sec, account_age_days, age, is_high_risk_career, is_high_risk_income,"
    " career_income_risk, is_app_user FROM f_user",
    ratio=USER_RATIO,
)
def _(spark, sf):
    return profile.user_features_lite(tables(spark, sf).users, AS_OF)


@query("twd_features", "SELECT * FROM f_twd", money=TWD_MONEY + " twd_net_flow", ratio="twd_withdraw_ratio twd_wit_ip_ratio")
def _(spark, sf):
    return money.twd_features(tables(spark, sf).fiat)


@query(
    "twd_features_lite",
    "SELECT * FROM f_twd_lite",
    money=TWD_MONEY + " twd_withdraw_ratio",
    ratio="twd_wit_ip_ratio",
)
def _(spark, sf):
    return money.twd_features_lite(tables(spark, sf).fiat)


@query("crypto_features", "SELECT * FROM f_crypto", money=CRYPTO_MONEY, ratio="crypto_wit_ip_ratio")
def _(spark, sf):
    return money.crypto_features(tables(spark, sf).crypto)


@query("crypto_features_lite", "SELECT * FROM f_crypto_lite", money=CRYPTO_MONEY, ratio="crypto_wit_ip_ratio")
def _(spark, sf):
    return money.crypto_features_lite(tables(spark, sf).crypto)


@query("trading_features", "SELECT * FROM f_trading", money=TRADE_MONEY, ratio=TRADE_RATIO)
def _(spark, sf):
    t = tables(spark, sf)
    return money.trading_features(t.trades, t.swaps)


@query("ip_shared_users", "SELECT * FROM ip_users")
def _(spark, sf):
    t = tables(spark, sf)
    return addresses.ip_shared_users(addresses.ip_usage(t.fiat, t.crypto, t.trades))


@query("ip_features", "SELECT * FROM f_ip", ratio="ip_night_ratio")
def _(spark, sf):
    t = tables(spark, sf)
    return addresses.ip_features(t.fiat, t.crypto, t.trades)


@query("fund_stay", "SELECT * FROM f_stay", ratio="fund_stay_sec")
def _(spark, sf):
    t = tables(spark, sf)
    return flows.fund_stay(t.fiat, t.crypto)


@query("same_day_in_out", "SELECT * FROM f_sameday")
def _(spark, sf):
    t = tables(spark, sf)
    return flows.same_day_in_out(t.fiat, t.crypto)


@query("rapid_kyc_trade", "SELECT * FROM f_rapid")
def _(spark, sf):
    t = tables(spark, sf)
    return flows.rapid_kyc_trade(t.users, t.fiat, t.crypto)


@query("red_flag_features", "SELECT * FROM f_red", ratio=RED_RATIO)
def _(spark, sf):
    t = tables(spark, sf)
    return flows.red_flag_features(t.users, t.fiat, t.crypto)


def _tx(spark, sf):
    t = tables(spark, sf)
    return timing.unified_tx(t.fiat, t.crypto, t.trades, t.swaps)


@query(
    "unified_tx",
    "SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sum(raw_amount * 1e-8::DOUBLE) AS amount"
    " FROM all_tx GROUP BY user_id",
    money="amount",
)
def _(spark, sf):
    return _tx(spark, sf).groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(money.amount_twd("raw_amount")).alias("amount"),
    )


@query("tx_burst", "SELECT * FROM burst_users")
def _(spark, sf):
    return timing.tx_bursts(timing.tx_instants(_tx(spark, sf)))


@query("tx_intervals", "SELECT * FROM interval_users", money=TIME_MONEY)
def _(spark, sf):
    instants = cut_lineage(timing.tx_instants(_tx(spark, sf)))
    return timing.tx_intervals(instants)


@query("cross_table_features", "SELECT * FROM f_cross", ratio=CROSS_RATIO)
def _(spark, sf):
    return timing.cross_table_features(cut_lineage(timing.tx_instants(_tx(spark, sf))))


@query("temporal_features", "SELECT * FROM f_temporal", money=TIME_MONEY, ratio="amount_p90_p10_ratio")
def _(spark, sf):
    return timing.temporal_features(tables(spark, sf).users, _tx(spark, sf))


LITE_MONEY = " ".join([TWD_MONEY, CRYPTO_MONEY, TRADE_MONEY, "withdraw_velocity twd_withdraw_ratio smurf_withdraw_pattern"])
INTERACTION_RATIO = "night_high_frequency large_fast_turnover ip_diversity_frequency age_volume_mismatch"
INTERACTIONS = (
    "user_id, quick_kyc_quick_withdraw, new_account_high_risk, night_high_frequency, large_fast_turnover,"
    " smurf_withdraw_pattern, currency_protocol_complexity, risky_career_low_kyc, withdraw_velocity,"
    " ip_diversity_frequency, age_volume_mismatch"
)


@query(
    "interaction_features",
    f"SELECT {INTERACTIONS} FROM f_mart_lite",
    money="withdraw_velocity smurf_withdraw_pattern",
    ratio=INTERACTION_RATIO,
)
def _(spark, sf):
    return mart.feature_mart_lite(tables(spark, sf), AS_OF).select(*[c.strip() for c in INTERACTIONS.split(",")])


@query(
    "feature_mart_lite",
    "SELECT * FROM f_mart_lite",
    money=LITE_MONEY,
    ratio=f"kyc_speed_sec age twd_wit_ip_ratio crypto_wit_ip_ratio {TRADE_RATIO} ip_night_ratio fund_stay_sec"
    f" {INTERACTION_RATIO} composite_risk_score",
)
def _(spark, sf):
    return mart.feature_mart_lite(tables(spark, sf), AS_OF)


@query("composite_risk", "SELECT * FROM risk_users", ratio="risk_score")
def _(spark, sf):
    return mart.risk_scores(tables(spark, sf), AS_OF)


@query(
    "composite_risk_v2",
    "SELECT user_id, composite_risk_score AS risk_score FROM f_mart_lite",
    ratio="risk_score",
)
def _(spark, sf):
    return mart.feature_mart_lite(tables(spark, sf), AS_OF).select(
        "user_id", F.col("composite_risk_score").alias("risk_score")
    )
