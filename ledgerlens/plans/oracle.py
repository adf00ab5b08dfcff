"""Independent SQL statements of the same results, as named building blocks.

``compose`` puts the blocks a statement mentions, and those they mention in turn, in
front of it as common table expressions.
"""

from __future__ import annotations

import re

BASE = {
    "user_info": """
SELECT CAST(c_custkey AS BIGINT) AS user_id,
  CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INT) AS status,
  CAST(c_custkey % 3 AS INT) AS sex,
  CAST(18 + (c_custkey * 7) % 60 AS INT) AS age,
  CAST(1 + (c_custkey * 11) % 31 AS INT) AS career,
  CAST(1 + c_nationkey % 10 AS INT) AS income_source,
  CAST(c_custkey % 2 AS INT) AS user_source,
  make_timestamp(788918400000000 + ((c_custkey * 7919) % 31536000) * 1000000) AS confirmed_at,
  make_timestamp(788918400000000 + ((c_custkey * 7919) % 31536000 + (c_custkey * 131) % 900000 - 3600) * 1000000) AS level1_finished_at,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE
  make_timestamp(788918400000000 + ((c_custkey * 7919) % 31536000 + (c_custkey * 131) % 900000 + (c_custkey * 977) % 700000) * 1000000) END AS level2_finished_at
FROM customer""",
    "twd_transfer": """
SELECT make_timestamp(epoch_us(o_orderdate) + ((o_orderkey * 7919) % 86400) * 1000000) AS created_at,
  CAST(o_custkey AS BIGINT) AS user_id,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS kind,
  CASE WHEN o_custkey % 20 = 3 THEN (5000000 + o_orderkey % 1000) * 1000000
       ELSE CAST(round(o_totalprice * 100) AS BIGINT) * 1000000 END AS ori_samount,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('ip_', CAST((o_custkey * 5 + o_orderkey % 3) % 997 AS STRING)) END AS source_ip_hash
FROM orders""",
    "crypto_transfer": """
SELECT make_timestamp(epoch_us(l_shipdate) + ((l_orderkey * 3607) % 86400) * 1000000) AS created_at,
  CAST(o_custkey AS BIGINT) AS user_id,
  CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS INT) AS kind,
  CAST(CASE WHEN l_returnflag = 'N' AND l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS INT) AS sub_kind,
  CAST(l_quantity AS BIGINT) * 100000000 AS ori_samount,
  CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) * 1000000 AS twd_srate,
  CASE WHEN l_returnflag = 'N' AND l_orderkey % 10 = 0 THEN
    CASE WHEN l_orderkey % 50 = 0 THEN 1000000 + o_custkey - o_custkey % 16
         ELSE o_custkey - o_custkey % 16 + l_partkey % 16 END END AS relation_user_id,
  CASE WHEN l_linestatus = 'O' AND NOT (l_returnflag = 'N' AND l_orderkey % 10 = 0) THEN concat('w', CAST(l_suppkey AS STRING)) END AS from_wallet,
  CASE WHEN l_linestatus = 'F' AND NOT (l_returnflag = 'N' AND l_orderkey % 10 = 0) THEN concat('w', CAST(l_partkey AS STRING)) END AS to_wallet,
  CAST(l_suppkey % 7 AS INT) AS protocol,
  CASE l_partkey % 5 WHEN 0 THEN 'btc' WHEN 1 THEN 'eth' WHEN 2 THEN 'usdt' WHEN 3 THEN 'ada' ELSE 'trx' END AS currency,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('ip_', CAST((o_custkey * 3 + l_suppkey % 4) % 997 AS STRING)) END AS source_ip_hash
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "usdt_twd_trading": """
SELECT make_timestamp(1003968000000000 + CAST(floor((epoch_us(ts) - 1704067200000000) / 12) AS BIGINT)) AS updated_at, user_id,
  CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INT) AS is_buy,
  CAST(round(value * 100) AS BIGINT) * 1000000 AS trade_samount,
  3000000000 + (event_id % 100) * 1000000 AS twd_srate,
  concat('ip_', CAST((user_id * 7 + event_id % 5) % 211 AS STRING)) AS source_ip_hash,
  CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS is_market,
  CAST(event_id % 3 AS INT) AS source
FROM events WHERE event_type IN ('purchase', 'click', 'view')""",
    "usdt_swap": """
SELECT make_timestamp(1003968000000000 + CAST(floor((epoch_us(ts) - 1704067200000000) / 12) AS BIGINT)) AS created_at, user_id,
  CAST(event_id % 2 AS INT) AS kind,
  CAST(round(value * 100) AS BIGINT) * 30000000 AS twd_samount,
  CAST(round(value * 100) AS BIGINT) * 1000000 AS currency_samount
FROM events WHERE event_type IN ('signup', 'error')""",
}

FEATURES = {
    "f_user": """
SELECT user_id,
  CASE WHEN level2_finished_at IS NULL THEN 0 ELSE 1 END AS has_kyc_level2,
  CASE WHEN level2_finished_at IS NOT NULL THEN
    greatest((epoch_us(level2_finished_at) - epoch_us(level1_finished_at)) / 1e6, 0.0) END AS kyc_speed_sec,
  CAST(greatest(floor((epoch_us(TIMESTAMP '2002-01-01 00:00:00') - epoch_us(confirmed_at)) / 86400e6), 0) AS BIGINT) AS account_age_days,
  CAST(least(greatest(age, 0), 120) AS DOUBLE) AS age,
  CASE WHEN sex = 2 THEN 1 ELSE 0 END AS is_female,
  CASE WHEN career IN (14, 22, 23, 29) THEN 1 ELSE 0 END AS is_high_risk_career,
  CASE WHEN income_source IN (4, 8, 9) THEN 1 ELSE 0 END AS is_high_risk_income,
  CASE WHEN career IN (14, 22, 23, 29) AND income_source IN (4, 8, 9) THEN 1 ELSE 0 END AS career_income_risk,
  count(*) OVER (PARTITION BY career) AS career_freq,
  CASE WHEN user_source = 1 THEN 1 ELSE 0 END AS is_app_user,
  CAST(hour(confirmed_at) AS INT) AS reg_hour,
  CASE WHEN hour(confirmed_at) BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS reg_is_night,
  CASE WHEN isodow(confirmed_at) IN (6, 7) THEN 1 ELSE 0 END AS reg_is_weekend,
  CASE WHEN level2_finished_at IS NOT NULL THEN CAST(greatest(floor((epoch_us(level2_finished_at) - epoch_us(level1_finished_at)) / 86400e6), 0) AS BIGINT) END AS kyc_gap_days,
  CAST(greatest(floor((epoch_us(level1_finished_at) - epoch_us(confirmed_at)) / 86400e6), 0) AS BIGINT) AS reg_to_kyc1_days
FROM user_info""",
    "f_twd0": """
SELECT user_id, kind, ori_samount * 1e-8::DOUBLE AS amount, source_ip_hash FROM twd_transfer""",
    "f_twd": """
SELECT user_id,
  count(amount) FILTER (kind = 0) AS twd_dep_count,
  coalesce(sum(amount) FILTER (kind = 0), 0) AS twd_dep_sum,
  coalesce(avg(amount) FILTER (kind = 0), 0) AS twd_dep_mean,
  coalesce(stddev_samp(amount) FILTER (kind = 0), 0) AS twd_dep_std,
  coalesce(max(amount) FILTER (kind = 0), 0) AS twd_dep_max,
  count(amount) FILTER (kind = 1) AS twd_wit_count,
  coalesce(sum(amount) FILTER (kind = 1), 0) AS twd_wit_sum,
  coalesce(avg(amount) FILTER (kind = 1), 0) AS twd_wit_mean,
  coalesce(stddev_samp(amount) FILTER (kind = 1), 0) AS twd_wit_std,
  coalesce(max(amount) FILTER (kind = 1), 0) AS twd_wit_max,
  coalesce(sum(amount) FILTER (kind = 0), 0) - coalesce(sum(amount) FILTER (kind = 1), 0) AS twd_net_flow,
  least(coalesce(sum(amount) FILTER (kind = 1), 0) / (coalesce(sum(amount) FILTER (kind = 0), 0) + 1e-9), 10.0) AS twd_withdraw_ratio,
  CASE WHEN coalesce(stddev_samp(amount) FILTER (kind = 0), 0) < 0.05 * coalesce(avg(amount) FILTER (kind = 0), 0)
        AND count(amount) FILTER (kind = 0) >= 5 THEN 1 ELSE 0 END AS twd_smurf_flag,
  coalesce(avg(CASE WHEN source_ip_hash IS NULL THEN 0.0 ELSE 1.0 END) FILTER (kind = 1), 0) AS twd_wit_ip_ratio
FROM f_twd0 GROUP BY user_id""",
    "f_twd_lite": """
SELECT * EXCLUDE (twd_net_flow, twd_withdraw_ratio), twd_wit_sum / (twd_dep_sum + 1e-9) AS twd_withdraw_ratio FROM f_twd""",
    "c_rows": """
SELECT *, ori_samount * 1e-8::DOUBLE * twd_srate * 1e-8::DOUBLE AS amount FROM crypto_transfer""",
    "c_wallets": """
SELECT user_id, count(DISTINCT w) AS n FROM (
  SELECT user_id, from_wallet AS w FROM crypto_transfer UNION ALL SELECT user_id, to_wallet FROM crypto_transfer)
WHERE w IS NOT NULL GROUP BY user_id""",
    "f_crypto": """
SELECT c.user_id,
  count(amount) FILTER (kind = 0) AS crypto_dep_count,
  coalesce(sum(amount) FILTER (kind = 0), 0) AS crypto_dep_sum,
  coalesce(avg(amount) FILTER (kind = 0), 0) AS crypto_dep_mean,
  coalesce(max(amount) FILTER (kind = 0), 0) AS crypto_dep_max,
  count(amount) FILTER (kind = 1) AS crypto_wit_count,
  coalesce(sum(amount) FILTER (kind = 1), 0) AS crypto_wit_sum,
  coalesce(avg(amount) FILTER (kind = 1), 0) AS crypto_wit_mean,
  coalesce(max(amount) FILTER (kind = 1), 0) AS crypto_wit_max,
  count(*) FILTER (sub_kind = 0 AND kind = 1) AS crypto_external_wit_count,
  count(DISTINCT currency) AS crypto_currency_diversity,
  count(DISTINCT protocol) AS crypto_protocol_diversity,
  coalesce(any_value(w.n), 0) AS crypto_wallet_hash_nunique,
  count(*) FILTER (sub_kind = 1) AS crypto_internal_count,
  count(DISTINCT relation_user_id) FILTER (sub_kind = 1) AS crypto_internal_peer_count,
  coalesce(avg(CASE WHEN source_ip_hash IS NULL THEN 0.0 ELSE 1.0 END) FILTER (kind = 1), 0) AS crypto_wit_ip_ratio
FROM c_rows c LEFT JOIN c_wallets w ON c.user_id = w.user_id
GROUP BY c.user_id HAVING count(*) FILTER (kind IN (0, 1)) > 0""",
    "f_crypto_lite": """
SELECT * EXCLUDE (crypto_wallet_hash_nunique, crypto_internal_count) FROM f_crypto""",
    "t_agg": """
SELECT user_id, count(*) AS trading_count, sum(a) AS trading_sum, avg(a) AS trading_mean, max(a) AS trading_max,
  avg(is_buy) AS trading_buy_ratio, avg(is_market) AS trading_market_order_ratio
FROM (SELECT *, trade_samount * 1e-8::DOUBLE * twd_srate * 1e-8::DOUBLE AS a FROM usdt_twd_trading) GROUP BY user_id""",
    "s_agg": """
SELECT user_id, count(*) AS swap_count, sum(twd_samount * 1e-8::DOUBLE) AS swap_sum FROM usdt_swap GROUP BY user_id""",
    "f_trading": """
SELECT coalesce(t.user_id, s.user_id) AS user_id, coalesce(trading_count, 0) AS trading_count,
  coalesce(trading_sum, 0) AS trading_sum, coalesce(trading_mean, 0) AS trading_mean, coalesce(trading_max, 0) AS trading_max,
  coalesce(trading_buy_ratio, 0) AS trading_buy_ratio, coalesce(trading_market_order_ratio, 0) AS trading_market_order_ratio,
  coalesce(swap_count, 0) AS swap_count, coalesce(swap_sum, 0) AS swap_sum,
  coalesce(trading_sum, 0) + coalesce(swap_sum, 0) AS total_trading_volume
FROM t_agg t FULL JOIN s_agg s ON t.user_id = s.user_id""",
    "ip_rows": """
SELECT user_id, source_ip_hash AS ip, created_at AS ts FROM twd_transfer WHERE source_ip_hash IS NOT NULL
UNION ALL SELECT user_id, source_ip_hash, created_at FROM crypto_transfer WHERE source_ip_hash IS NOT NULL
UNION ALL SELECT user_id, source_ip_hash, updated_at FROM usdt_twd_trading WHERE source_ip_hash IS NOT NULL""",
    "ip_users": """
SELECT ip, count(DISTINCT user_id) AS ip_shared_user_count FROM ip_rows GROUP BY ip""",
    "f_ip": """
SELECT user_id, count(DISTINCT r.ip) AS ip_unique_count, count(*) AS ip_total_count,
  count(*) FILTER (hour(ts) BETWEEN 0 AND 5) / count(*) AS ip_night_ratio,
  max(ip_shared_user_count) AS ip_max_shared
FROM ip_rows r JOIN ip_users u ON r.ip = u.ip GROUP BY user_id""",
    "move_rows": """
SELECT 'fiat' AS src, user_id, created_at AS ts, kind, ori_samount * 1e-8::DOUBLE AS amount FROM twd_transfer
UNION ALL SELECT 'crypto', user_id, created_at, kind, amount FROM c_rows""",
    "stay_rows": """
SELECT m.src, m.user_id, min(epoch_us(m.ts) - epoch_us(d.last_dep)) / 1e6 AS stay
FROM move_rows m JOIN (SELECT src, user_id, max(ts) AS last_dep FROM move_rows WHERE kind = 0 GROUP BY ALL) d
  ON m.src = d.src AND m.user_id = d.user_id AND m.ts > d.last_dep
WHERE m.kind = 1 GROUP BY ALL""",
    "f_stay": "SELECT user_id, min(stay) AS fund_stay_sec FROM stay_rows GROUP BY user_id",
    "f_sameday": """
SELECT user_id, count(*) FILTER (i AND o) AS same_day_in_out_count FROM (
  SELECT src, user_id, CAST(ts AS DATE) AS d, bool_or(kind = 0) AS i, bool_or(kind = 1) AS o FROM move_rows GROUP BY ALL)
GROUP BY user_id""",
    "f_rapid": """
SELECT u.user_id, CASE WHEN (epoch_us(f) - epoch_us(level2_finished_at)) / 3600e6 BETWEEN 0 AND 48 THEN 1 ELSE 0 END AS rapid_kyc_then_trade
FROM user_info u LEFT JOIN (SELECT user_id, min(ts) AS f FROM move_rows GROUP BY user_id) m ON u.user_id = m.user_id""",
    "f_wait": """
SELECT user_id, min(h) AS dep_to_first_wit_hours FROM (
  SELECT src, user_id, (epoch_us(min(ts) FILTER (kind = 1)) - epoch_us(min(ts) FILTER (kind = 0))) / 3600e6 AS h
  FROM move_rows GROUP BY src, user_id)
WHERE h >= 0 GROUP BY user_id""",
    "f_sums": """
SELECT user_id,
  coalesce(sum(amount) FILTER (src = 'fiat' AND kind = 0), 0) AS fi,
  coalesce(sum(amount) FILTER (src = 'crypto' AND kind = 0), 0) AS ci,
  coalesce(sum(amount) FILTER (src = 'crypto' AND kind = 1), 0) AS co,
  CASE WHEN count(*) < 3 THEN 0 ELSE stddev_samp(amount) / (avg(amount) + 1e-9) END AS cv
FROM move_rows GROUP BY user_id""",
    "f_red": """
SELECT u.user_id, coalesce(w.dep_to_first_wit_hours, 0) AS dep_to_first_wit_hours,
  CASE WHEN s.user_id IS NULL THEN 0 ELSE least(s.fi / (s.co + 1e-9), 100.0) END AS twd_to_crypto_out_ratio,
  coalesce(s.cv, 0) AS tx_amount_cv, r.rapid_kyc_then_trade,
  CASE WHEN s.user_id IS NULL THEN 0 ELSE least(s.co / (s.ci + 1e-9), 10.0) END AS crypto_out_in_ratio,
  coalesce(d.same_day_in_out_count, 0) AS same_day_in_out_count
FROM user_info u JOIN f_rapid r ON u.user_id = r.user_id
LEFT JOIN f_wait w ON u.user_id = w.user_id LEFT JOIN f_sums s ON u.user_id = s.user_id
LEFT JOIN f_sameday d ON u.user_id = d.user_id""",
    "all_tx": """
SELECT user_id, created_at AS ts, ori_samount AS raw_amount FROM twd_transfer
UNION ALL SELECT user_id, created_at, ori_samount FROM crypto_transfer
UNION ALL SELECT user_id, updated_at, trade_samount FROM usdt_twd_trading
UNION ALL SELECT user_id, created_at, twd_samount FROM usdt_swap""",
    "burst_users": """
SELECT user_id, count(*) FILTER (seen >= 5) AS tx_burst_count FROM (
  SELECT user_id,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 1 HOUR FOLLOWING)
    - (row_number() OVER (PARTITION BY user_id ORDER BY ts) - rank() OVER (PARTITION BY user_id ORDER BY ts)) AS seen
  FROM all_tx)
GROUP BY user_id""",
    "interval_users": """
SELECT user_id, avg(g) AS tx_interval_mean, coalesce(stddev_samp(g), 0) AS tx_interval_std, min(g) AS tx_interval_min,
  median(g) AS tx_interval_median
FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS g FROM all_tx)
WHERE g IS NOT NULL GROUP BY user_id""",
    "spread_users": """
SELECT user_id, least(quantile_cont(raw_amount * 1e-8::DOUBLE, 0.9) / (quantile_cont(raw_amount * 1e-8::DOUBLE, 0.1) + 1e-9), 1000.0) AS amount_p90_p10_ratio
FROM all_tx WHERE raw_amount > 0 GROUP BY user_id""",
    "f_temporal": """
SELECT u.user_id, coalesce(tx_interval_mean, 0) AS tx_interval_mean, coalesce(tx_interval_std, 0) AS tx_interval_std,
  coalesce(tx_interval_min, 0) AS tx_interval_min, coalesce(tx_interval_median, 0) AS tx_interval_median,
  coalesce(tx_burst_count, 0) AS tx_burst_count, coalesce(amount_p90_p10_ratio, 0) AS amount_p90_p10_ratio,
  coalesce(active_days, 0) AS active_days
FROM user_info u LEFT JOIN interval_users i ON u.user_id = i.user_id LEFT JOIN burst_users b ON u.user_id = b.user_id
LEFT JOIN spread_users s ON u.user_id = s.user_id
LEFT JOIN (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS active_days FROM all_tx GROUP BY user_id) d ON u.user_id = d.user_id""",
    "f_cross": """
SELECT user_id, count(*) AS total_tx_count,
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6) AS BIGINT) AS first_to_last_tx_days,
  avg(CASE WHEN isodow(ts) IN (6, 7) THEN 1.0 ELSE 0.0 END) AS weekend_tx_ratio,
  (count(*) FILTER (ts >= latest - INTERVAL 7 DAY) / 7) / (count(*) FILTER (ts >= latest - INTERVAL 30 DAY) / 30 + 1e-9) AS velocity_ratio_7d_vs_30d
FROM all_tx, (SELECT max(ts) AS latest FROM all_tx) GROUP BY user_id""",
    "risk_users": """
SELECT user_id, status,
  least(greatest((1 - has_kyc_level2) * 0.30::DOUBLE + coalesce(twd_withdraw_ratio, 0) * 0.25::DOUBLE + coalesce(ip_night_ratio, 0) * 0.15::DOUBLE
    + coalesce(crypto_currency_diversity, 0) * 0.10::DOUBLE + career_income_risk * 0.20::DOUBLE, 0), 1) AS risk_score
FROM user_info JOIN f_user USING (user_id) LEFT JOIN f_twd USING (user_id)
LEFT JOIN f_ip USING (user_id) LEFT JOIN f_crypto USING (user_id)""",
    "mart_lite0": """
SELECT u.user_id, has_kyc_level2, coalesce(kyc_speed_sec, 0) AS kyc_speed_sec, account_age_days, age, is_high_risk_career,
  is_high_risk_income, career_income_risk, is_app_user, COLUMNS(t.* EXCLUDE (user_id)), COLUMNS(c.* EXCLUDE (user_id)),
  COLUMNS(b.* EXCLUDE (user_id)), COLUMNS(i.* EXCLUDE (user_id)), fund_stay_sec
FROM f_user u LEFT JOIN f_twd_lite t ON u.user_id = t.user_id LEFT JOIN f_crypto_lite c ON u.user_id = c.user_id
LEFT JOIN f_trading b ON u.user_id = b.user_id LEFT JOIN f_ip i ON u.user_id = i.user_id
LEFT JOIN f_stay s ON u.user_id = s.user_id""",
    "mart_lite1": "SELECT user_id, coalesce(COLUMNS(* EXCLUDE (user_id)), 0) FROM mart_lite0",
    "mart_lite2": """
SELECT *,
  CASE WHEN kyc_speed_sec < 3600 AND fund_stay_sec < 86400 AND twd_withdraw_ratio > 0.8 THEN 1 ELSE 0 END AS quick_kyc_quick_withdraw,
  CASE WHEN account_age_days < 30 AND (ip_unique_count > 5 OR crypto_currency_diversity > 3 OR twd_withdraw_ratio > 0.7) THEN 1 ELSE 0 END AS new_account_high_risk,
  ip_night_ratio * ln(1 + twd_dep_count + crypto_wit_count) AS night_high_frequency,
  ln(1 + swap_sum + total_trading_volume) / ln(2 + fund_stay_sec) AS large_fast_turnover,
  twd_smurf_flag * twd_withdraw_ratio AS smurf_withdraw_pattern,
  crypto_currency_diversity * crypto_protocol_diversity AS currency_protocol_complexity,
  CASE WHEN is_high_risk_career = 1 AND has_kyc_level2 = 0 THEN 1 ELSE 0 END AS risky_career_low_kyc,
  twd_wit_sum / (fund_stay_sec + 1) AS withdraw_velocity,
  ip_unique_count * ln(1 + twd_dep_count + twd_wit_count) AS ip_diversity_frequency,
  CASE WHEN age < 25 THEN ln(1 + twd_dep_sum + crypto_wit_sum) ELSE 0 END AS age_volume_mismatch
FROM mart_lite1""",
    "f_mart_lite": """
SELECT *, least(greatest((1 - has_kyc_level2) * 0.20::DOUBLE + twd_withdraw_ratio * 0.15::DOUBLE + ip_night_ratio * 0.10::DOUBLE
  + crypto_currency_diversity * 0.08::DOUBLE + career_income_risk * 0.15::DOUBLE + quick_kyc_quick_withdraw * 0.12::DOUBLE
  + new_account_high_risk * 0.10::DOUBLE + smurf_withdraw_pattern * 0.10::DOUBLE, 0), 1) AS composite_risk_score
FROM mart_lite2""",
}

BLOCKS: dict[str, str] = {**BASE, **FEATURES}


def add_blocks(more: dict[str, str]) -> None:
    BLOCKS.update(more)


def _mentions(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [name for name in BLOCKS if name in words]


def compose(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for name in _mentions(text):
            # a recursive block names itself
            if name != own and name not in needed:
                visit(BLOCKS[name], name)
                needed.append(name)

    visit(sql, None)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({BLOCKS[n].strip()})" for n in needed)
    return f"WITH RECURSIVE {ctes}\n{sql}"
