"""Risk levels and composite scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clip

# Cut points, level names, recommended actions.
LEVELS = ["正常", "低風險", "中風險", "高風險", "極高風險"]
LEVEL_CUTS = [0.2, 0.4, 0.6, 0.8]
ACTIONS = {
    "極高風險": "建議立即凍結帳戶並啟動人工調查",
    "高風險": "建議暫停交易並要求補件 KYC",
    "中風險": "建議設定交易限額並加強監控",
    "低風險": "正常監控，定期複查",
    "正常": "無需特殊處理",
}
RETHRESHOLD_CUTS = [0.08, 0.15, 0.25, 0.40]
RETHRESHOLD_LABEL = 0.15
RISK_TABS = [("high", 0.8743, None), ("medium", 0.65, 0.8743), ("low", 0.45, 0.65)]


def risk_level(score: Column) -> Column:
    """Level with right-closed bins: 0.2 still belongs to the lowest level."""
    out = F.when(score <= LEVEL_CUTS[0], LEVELS[0])
    for cut, name in zip(LEVEL_CUTS[1:], LEVELS[1:-1]):
        out = out.when(score <= cut, name)
    return out.when(score.isNotNull(), LEVELS[-1])


def level_at_least(score: Column, cuts: list[float] = LEVEL_CUTS) -> Column:
    """Level with left-closed bins: 0.2 is already the second level."""
    out = None
    for cut, name in reversed(list(zip(cuts, LEVELS[1:]))):
        out = F.when(score >= cut, name) if out is None else out.when(score >= cut, name)
    return out.otherwise(LEVELS[0])


def action_for(level: Column) -> Column:
    out = None
    for name, action in ACTIONS.items():
        out = F.when(level == name, action) if out is None else out.when(level == name, action)
    return out


def risk_tab(score: Column) -> Column:
    out = None
    for name, low, high in RISK_TABS:
        cond = score >= low if high is None else (score >= low) & (score < high)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


# Composite weights.
COMPOSITE_V1 = {
    "twd_withdraw_ratio": 0.25,
    "ip_night_ratio": 0.15,
    "crypto_currency_diversity": 0.10,
    "career_income_risk": 0.20,
}
COMPOSITE_V1_NO_KYC = 0.30
COMPOSITE_V2 = {
    "twd_withdraw_ratio": 0.15,
    "ip_night_ratio": 0.10,
    "crypto_currency_diversity": 0.08,
    "career_income_risk": 0.15,
    "quick_kyc_quick_withdraw": 0.12,
    "new_account_high_risk": 0.10,
    "smurf_withdraw_pattern": 0.10,
}
COMPOSITE_V2_NO_KYC = 0.20


def _weighted(weights: dict[str, float], no_kyc: float) -> Column:
    total = (F.lit(1) - F.col("has_kyc_level2")) * no_kyc
    for name, weight in weights.items():
        total = total + F.col(name) * weight
    return clip(total, 0.0, 1.0)


def composite_risk() -> Column:
    return _weighted(COMPOSITE_V1, COMPOSITE_V1_NO_KYC)


def composite_risk_v2() -> Column:
    return _weighted(COMPOSITE_V2, COMPOSITE_V2_NO_KYC)
