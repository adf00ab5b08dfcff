"""Features of the user record itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, days_between_floor, flag, is_night, is_weekend, seconds_between

# Career and income codes treated as high risk.
HIGH_RISK_CAREERS = [14, 22, 23, 29]
HIGH_RISK_INCOME = [4, 8, 9]


def _common(as_of: str) -> dict:
    kyc1, kyc2, joined = F.col("level1_finished_at"), F.col("level2_finished_at"), F.col("confirmed_at")
    risky_career = flag(F.col("career").isin(HIGH_RISK_CAREERS))
    risky_income = flag(F.col("income_source").isin(HIGH_RISK_INCOME))
    return {
        "has_kyc_level2": kyc2.isNotNull().cast("int"),
        "kyc_speed_sec": clip(seconds_between(kyc2, kyc1), 0.0),
        "account_age_days": clip(days_between_floor(F.lit(as_of).cast("timestamp"), joined), 0),
        "age": clip(F.col("age").cast("double"), 0.0, 120.0),
        "is_high_risk_career": risky_career,
        "is_high_risk_income": risky_income,
        "career_income_risk": risky_career.bitwiseAND(risky_income),
        "is_app_user": flag(F.col("user_source") == 1),
    }


def user_features(users: DataFrame, as_of: str) -> DataFrame:
    """Fifteen features; the wall clock is the ``as_of`` argument."""
    kyc1, kyc2, joined = F.col("level1_finished_at"), F.col("level2_finished_at"), F.col("confirmed_at")
    # The frequency table has one row per career code; counting first and joining it
    # back keeps a popular career from gathering its users in one window task.
    freq = users.where(F.col("career").isNotNull()).groupBy("career").agg(F.count("*").alias("career_freq"))
    cols = _common(as_of) | {
        "is_female": flag(F.col("sex") == 2),
        "reg_hour": F.hour(joined),
        "reg_is_night": is_night(joined).cast("int"),
        "reg_is_weekend": flag(is_weekend(joined)),
        "kyc_gap_days": clip(days_between_floor(kyc2, kyc1), 0),
        "reg_to_kyc1_days": clip(days_between_floor(kyc1, joined), 0),
    }
    order = [
        "has_kyc_level2", "kyc_speed_sec", "account_age_days", "age", "is_female",
        "is_high_risk_career", "is_high_risk_income", "career_income_risk", "career_freq",
        "is_app_user", "reg_hour", "reg_is_night", "reg_is_weekend", "kyc_gap_days", "reg_to_kyc1_days",
    ]
    cols["career_freq"] = F.coalesce(F.col("career_freq"), F.lit(0))
    return users.join(freq, "career", "left").select("user_id", *[cols[c].alias(c) for c in order])


def user_features_lite(users: DataFrame, as_of: str) -> DataFrame:
    """The eight-feature variant; a missing age column counts as 0."""
    if "age" not in users.columns:
        users = users.withColumn("age", F.lit(0))
    return users.select("user_id", *[c.alias(n) for n, c in _common(as_of).items()])
