"""Hand-made edge frames with literal expectations."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.quantiles import exact_percentiles
from ledgerlens.operators import flows, money, profile, timing

T0 = datetime(2001, 1, 1, 12)
FIAT = "user_id long, created_at timestamp, kind int, ori_samount long, source_ip_hash string"
CRYPTO = (
    "user_id long, created_at timestamp, kind int, sub_kind int, ori_samount long, twd_srate long,"
    " relation_user_id long, from_wallet string, to_wallet string, protocol int, currency string, source_ip_hash string"
)
USERS = (
    "user_id long, sex int, age int, career int, income_source int, user_source int,"
    " confirmed_at timestamp, level1_finished_at timestamp, level2_finished_at timestamp"
)


def fiat(spark, rows):
    return spark.createDataFrame([(u, t, k, int(a * 1e8), ip) for u, t, k, a, ip in rows], FIAT)


def no_crypto(spark):
    return spark.createDataFrame([], CRYPTO)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_single_deposit(spark):
    r = one(money.twd_features(fiat(spark, [(1, T0, 0, 100.0, None)])))
    assert (r["twd_dep_std"], r["twd_smurf_flag"], r["twd_withdraw_ratio"], r["twd_dep_count"]) == (0, 0, 0, 1)


def test_withdrawals_only_hits_cap(spark):
    rows = fiat(spark, [(1, T0, 1, 50.0, "a"), (1, T0, 1, 60.0, None)])
    r = one(money.twd_features(rows))
    assert r["twd_withdraw_ratio"] == 10 and r["twd_wit_ip_ratio"] == 0.5
    assert money.twd_features_lite(rows).first()["twd_withdraw_ratio"] > 1e9
    assert flows.fund_stay(rows, no_crypto(spark)).count() == 0


def test_smurf_flag_needs_five(spark):
    rows = [(u, T0 + timedelta(hours=i), 0, 1000.0 + i, None) for u, n in ((1, 5), (2, 4)) for i in range(n)]
    got = {r["user_id"]: r["twd_smurf_flag"] for r in money.twd_features(fiat(spark, rows)).collect()}
    assert got == {1: 1, 2: 0}


def test_fund_stay_uses_last_deposit(spark):
    rows = [(1, T0, 0, 1.0, None), (1, T0 + timedelta(hours=1), 1, 1.0, None),
            (1, T0 + timedelta(hours=2), 0, 1.0, None), (1, T0 + timedelta(hours=2), 1, 1.0, None),
            (1, T0 + timedelta(hours=5), 1, 1.0, None)]
    assert one(flows.fund_stay(fiat(spark, rows), no_crypto(spark)))["fund_stay_sec"] == 3 * 3600


def user(spark, kyc1, kyc2, joined=T0):
    return spark.createDataFrame([(1, 2, 30, 14, 4, 1, joined, kyc1, kyc2)], USERS)


def test_no_second_kyc(spark):
    r = one(profile.user_features(user(spark, T0, None), "2002-01-01 00:00:00"))
    assert r["has_kyc_level2"] == 0 and r["kyc_speed_sec"] is None and r["kyc_gap_days"] is None
    assert r["career_income_risk"] == 1 and r["career_freq"] == 1 and r["is_female"] == 1


def test_second_kyc_before_first(spark):
    r = one(profile.user_features(user(spark, T0, T0 - timedelta(hours=1)), "2002-01-01 00:00:00"))
    assert r["kyc_speed_sec"] == 0 and r["kyc_gap_days"] == 0


@pytest.mark.parametrize("delay,expected", [(0, 1), (48 * 3600, 1), (48 * 3600 + 1, 0), (-1, 0)])
def test_rapid_kyc_ends_are_inclusive(spark, delay, expected):
    rows = fiat(spark, [(1, T0 + timedelta(seconds=delay), 0, 1.0, None)])
    r = one(flows.rapid_kyc_trade(user(spark, T0, T0), rows, no_crypto(spark)))
    assert r["rapid_kyc_then_trade"] == expected


def test_same_day_counts_add_over_tables(spark):
    f = fiat(spark, [(1, T0, 0, 1.0, None), (1, T0 + timedelta(hours=1), 1, 1.0, None)])
    c = spark.createDataFrame(
        [(1, T0, k, 0, 10**8, 10**8, None, None, None, 0, "btc", None) for k in (0, 1)], CRYPTO
    )
    assert one(flows.same_day_in_out(f, c))["same_day_in_out_count"] == 2


def tx(spark, times, amounts=None):
    rows = [(1, t, int((amounts or [1.0] * len(times))[i] * 1e8)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "user_id long, ts timestamp, raw_amount long")


def test_equal_timestamps_burst(spark):
    assert one(timing.tx_bursts(timing.tx_instants(tx(spark, [T0] * 6))))["tx_burst_count"] == 2


def reference_timeline(times, amounts):
    """Plain restatement of the timeline rules for one user."""
    s = pd.Series(sorted(times))
    gaps = s.diff().dt.total_seconds().dropna()
    bursts = sum((s.iloc[i:] <= s.iloc[i] + timedelta(hours=1)).sum() >= 5 for i in range(len(s)))
    a = pd.Series([x for x in amounts if x > 0])
    return gaps.mean(), gaps.std(), gaps.min(), gaps.median(), bursts, a.quantile(0.9) / (a.quantile(0.1) + 1e-9)


def test_timeline_against_plain_rules(spark):
    import random

    rng = random.Random(7)
    # clusters with ties, gaps over hour borders, long pauses
    times, at = [], T0
    for _ in range(300):
        at += timedelta(seconds=rng.choice([0, 0, 1, 600, 1799, 3600, 90000]))
        times.append(at)
    amounts = [rng.choice([0.0, 5.0, 10.0, 99.5]) for _ in times]
    frame = tx(spark, times, amounts)
    inst = timing.tx_instants(frame)
    want = reference_timeline(times, amounts)
    r = one(timing.tx_intervals(inst))
    got = (r["tx_interval_mean"], r["tx_interval_std"], r["tx_interval_min"], r["tx_interval_median"])
    assert got == pytest.approx(want[:4])
    assert one(timing.tx_bursts(inst))["tx_burst_count"] == want[4]
    assert one(timing.amount_spread(frame))["amount_p90_p10_ratio"] == pytest.approx(min(want[5], 1000))


def test_percentiles_of_a_key_with_most_rows(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") < 3900, 1).otherwise(2 + F.col("id") % 3).cast("long").alias("k"),
        F.when(F.col("id") < 900, 77).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**12))).alias("v"),
        (1 + F.col("id") % 3).alias("w"),
    )
    ps = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    plain = df.groupBy("k").agg(F.percentile("v", [0.1, 0.5, 0.9], F.col("w")).alias("p"))
    plain = {r["k"]: r["p"] for r in plain.collect()}
    for ranges in (256, 3, 1):
        got = {r["k"]: r for r in exact_percentiles(df, "k", "v", "w", ps, ranges).collect()}
        assert set(got) == set(plain)
        for k in plain:
            assert [got[k][p] for p in ps] == pytest.approx(plain[k], rel=1e-12)


def test_fund_stay_of_a_busy_user(spark):
    times = [T0 + timedelta(hours=h) for h in (0, 5, 6, 30, 31)]
    rows = [(7, times[1], 0), (7, times[0], 1), (7, times[2], 1), (7, times[3], 1), (8, times[4], 0), (8, times[3], 1), (9, times[1], 0), (9, times[3], 1)]
    df = spark.createDataFrame([(u, t, k, 1) for u, t, k in rows], "user_id long, created_at timestamp, kind int, ori_samount long")
    got = {r["user_id"]: r["fund_stay_sec"] for r in flows.fund_stay(df, no_crypto(spark)).collect()}
    assert got == {7: 3600.0, 9: 90000.0}


def test_user_without_transfers_has_zero_red_flags(spark):
    r = one(flows.red_flag_features(user(spark, T0, T0), fiat(spark, []), no_crypto(spark)))
    assert all(v == 0 for k, v in r.items() if k != "user_id")


def test_calm_and_busy_users_agree(spark, sf_dir):
    """Arrays and the paths for users of any size give the same features, also where users of both kinds meet."""
    from ledgerlens.sources.fixtures import tables

    t = tables(spark, sf_dir)
    all_tx = timing.unified_tx(t.fiat, t.crypto, t.trades, t.swaps)

    def features(limit):
        cross, temporal = timing.timeline_features(t.users, all_tx, limit)
        frames = [cross, temporal, flows.fund_stay(t.fiat, t.crypto, limit), flows.red_flag_features(t.users, t.fiat, t.crypto, limit)]
        return [{r["user_id"]: r.asDict() for r in f.collect()} for f in frames]

    calm, busy, mixed = features(10**6), features(0), features(60)
    for some in (busy, mixed):
        for a, b in zip(calm, some):
            assert set(a) == set(b)
            for key in a:
                assert list(a[key].values()) == pytest.approx(list(b[key].values()), rel=1e-9, abs=1e-9)


def test_timeline_of_arrays_against_plain_rules(spark):
    times = [T0 + timedelta(seconds=s) for s in (0, 0, 0, 1, 3599, 3600, 3600, 90000, 90001)]
    amounts = [0.0, 5.0, 10.0, 99.5, 1.0, 2.0, 3.0, 4.0, 0.0]
    want = reference_timeline(times, amounts)
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    cross, temporal = timing.timeline_features(users, tx(spark, times, amounts))
    r = {row["user_id"]: row for row in temporal.collect()}
    got = [r[1][c] for c in ("tx_interval_mean", "tx_interval_std", "tx_interval_min", "tx_interval_median", "tx_burst_count", "amount_p90_p10_ratio")]
    assert got == pytest.approx(want) and r[1]["active_days"] == 2
    assert all(v == 0 for k, v in r[2].asDict().items() if k != "user_id")
    assert one(cross)["total_tx_count"] == 9


def test_mart_joins_the_transfers_once(spark, sf_dir):
    """No part of the mart derives the crypto transfers again: they are written, users side by side."""
    from ledgerlens.operators import mart
    from ledgerlens.sources.fixtures import AS_OF, tables

    plan = mart.feature_mart_lite(tables(spark, sf_dir), AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "l_orderkey" not in plan
