"""Display names of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature -> display name.
FEATURE_LABELS = {
    "kyc_speed_sec": "KYC 完成速度（秒）",
    "account_age_days": "帳號年齡（天）",
    "age": "年齡",
    "is_female": "是否女性",
    "is_high_risk_career": "高風險職業",
    "is_high_risk_income": "高風險收入來源",
    "career_income_risk": "職業×收入組合風險",
    "career_freq": "職業頻率",
    "is_app_user": "APP 用戶",
    "reg_hour": "註冊時間（時）",
    "reg_is_night": "深夜註冊",
    "reg_is_weekend": "週末註冊",
    "has_kyc_level2": "已完成 KYC2",
    "kyc_gap_days": "KYC 間隔（天）",
    "reg_to_kyc1_days": "註冊到 KYC1（天）",
    "twd_dep_count": "法幣入金次數",
    "twd_dep_sum": "法幣入金總額",
    "twd_dep_mean": "法幣入金均值",
    "twd_dep_std": "法幣入金標準差",
    "twd_dep_max": "法幣入金最大值",
    "twd_wit_count": "法幣提領次數",
    "twd_wit_sum": "法幣提領總額",
    "twd_wit_mean": "法幣提領均值",
    "twd_wit_std": "法幣提領標準差",
    "twd_wit_max": "法幣提領最大值",
    "twd_net_flow": "法幣淨流入",
    "twd_withdraw_ratio": "提領/入金比",
    "twd_smurf_flag": "結構化交易旗標",
    "twd_wit_ip_ratio": "提領 IP 覆蓋率",
    "crypto_dep_count": "加密入金次數",
    "crypto_dep_sum": "加密入金總額",
    "crypto_dep_mean": "加密入金均值",
    "crypto_dep_max": "加密入金最大值",
    "crypto_wit_count": "加密提領次數",
    "crypto_wit_sum": "加密提領總額",
    "crypto_wit_mean": "加密提領均值",
    "crypto_wit_max": "加密提領最大值",
    "crypto_currency_diversity": "使用幣種數",
    "crypto_protocol_diversity": "使用鏈協定數",
    "crypto_wallet_hash_nunique": "錢包地址數",
    "crypto_internal_count": "內轉次數",
    "crypto_internal_peer_count": "內轉對象數",
    "crypto_external_wit_count": "鏈上提領次數",
    "crypto_wit_ip_ratio": "加密提領 IP 覆蓋率",
    "trading_count": "掛單成交次數",
    "trading_sum": "掛單成交總額",
    "trading_mean": "掛單成交均值",
    "trading_max": "掛單成交最大值",
    "trading_buy_ratio": "買單比率",
    "trading_market_order_ratio": "市價單比率",
    "swap_count": "一鍵買賣次數",
    "swap_sum": "一鍵買賣總額",
    "total_trading_volume": "總交易量",
    "ip_unique_count": "唯一 IP 數",
    "ip_total_count": "總 IP 使用次數",
    "ip_night_ratio": "深夜操作 IP 比率",
    "ip_max_shared": "IP 最大共用人數",
    "fund_stay_sec": "資金停留時間（秒）",
    "pagerank_score": "PageRank 分數",
    "graph_in_degree": "圖入度",
    "graph_out_degree": "圖出度",
    "connected_component_size": "連通分量大小",
    "betweenness_centrality": "介數中心性",
    "total_tx_count": "總交易筆數",
    "first_to_last_tx_days": "首末交易間隔（天）",
    "weekend_tx_ratio": "週末交易比率",
    "velocity_ratio_7d_vs_30d": "7天/30天交易加速比",
    "dep_to_first_wit_hours": "入金到首次提領（時）",
    "twd_to_crypto_out_ratio": "法幣入/幣出比",
    "tx_amount_cv": "交易金額變異係數",
    "rapid_kyc_then_trade": "KYC 後 48h 交易",
    "crypto_out_in_ratio": "加密出/入比",
    "same_day_in_out_count": "同天入出金天數",
    "tx_interval_mean": "交易間隔均值（秒）",
    "tx_interval_std": "交易間隔標準差",
    "tx_interval_min": "交易最短間隔（秒）",
    "tx_interval_median": "交易間隔中位數",
    "tx_burst_count": "交易爆發次數",
    "amount_p90_p10_ratio": "金額 P90/P10 比",
    "active_days": "活躍天數",
    "active_day_ratio": "活躍天數比",
    "if_score": "孤立森林分數",
    "hbos_score": "HBOS 分數",
    "lof_score": "LOF 分數",
    "composite_risk_score": "複合風險分數",
}
# Graph embedding columns share one pattern.
EMBEDDING_PREFIX, EMBEDDING_LABEL, EMBEDDING_SIZE = "gnn_emb_", "GNN 嵌入 ", 16
FEATURE_LABELS |= {f"{EMBEDDING_PREFIX}{i}": f"{EMBEDDING_LABEL}{i}" for i in range(EMBEDDING_SIZE)}


def feature_label(feature: Column) -> Column:
    """Display name, or the feature itself when it has none."""
    table = F.create_map(*[F.lit(x) for pair in FEATURE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, feature), feature)


def with_label(df: DataFrame, feature: str = "feature") -> DataFrame:
    return df.withColumn("label", feature_label(F.col(feature)))
