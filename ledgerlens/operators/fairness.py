"""Group fairness of predictions over four protected attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attribute names and group names.
ATTRIBUTES = {
    "is_female": ("性別 (Gender)", ["男性 (Male)", "女性 (Female)"]),
    "age": ("年齡 (Age)", ["< 30 歲", "30–50 歲", "> 50 歲"]),
    "is_high_risk_career": ("職業風險 (Career Risk)", ["一般職業", "高風險職業"]),
    "is_high_risk_income": ("收入來源 (Income Source)", ["一般收入", "高風險收入"]),
}
# Limits of the judgments.
GAP_PASS, GAP_WARNING = 0.05, 0.10
RATIO_PASS, RATIO_WARNING = (0.80, 1.25), (0.60, 1.50)
# Recommendation texts.
ADVICE_FAIL = "[嚴重] %s：公平性未通過，建議移除該特徵或加入公平性約束重新訓練。"
ADVICE_WARNING = "[注意] %s：公平性指標接近閾值，建議持續監控，並評估是否需要事後校正 (post-hoc calibration)。"
ADVICE_NONE = "所有受保護屬性均通過公平性檢測。"


def _group_index(attribute: str) -> Column:
    if attribute == "age":
        return F.when(F.col("age") < 30, 0).when(F.col("age") < 50, 1).otherwise(2)
    return F.col(attribute).cast("int")


def fairness_groups(df: DataFrame) -> DataFrame:
    """Counts and rates per (attribute, group); input has the attributes, ``status`` and ``predicted`` 0/1."""
    def entry(attribute: str) -> Column:
        names = F.array(*[F.lit(n) for n in ATTRIBUTES[attribute][1]])
        return F.struct(F.lit(attribute).alias("attribute"), F.get(names, _group_index(attribute)).alias("grp"))

    long = df.select("status", "predicted", F.inline(F.array(*[entry(a) for a in ATTRIBUTES])))
    y, p = F.col("status") == 1, F.col("predicted") == 1
    c = F.col
    return (
        long.where("grp is not null")
        .groupBy("attribute", "grp")
        .agg(
            F.count("*").alias("n"),
            F.count_if(p).alias("predicted_positive"),
            F.count_if(y & p).alias("tp"),
            F.count_if(~y & p).alias("fp"),
            F.count_if(y & ~p).alias("fn"),
            F.count_if(~y & ~p).alias("tn"),
        )
        .select(
            "*",
            F.try_divide(c("predicted_positive"), c("n")).alias("positive_rate"),
            F.try_divide(c("tp"), c("tp") + c("fn")).alias("tpr"),
            F.try_divide(c("fp"), c("fp") + c("tn")).alias("fpr"),
            F.try_divide(c("tp"), c("tp") + c("fp")).alias("precision"),
        )
    )


def fairness_gaps(groups: DataFrame) -> DataFrame:
    """Spread over the groups of an attribute; null with fewer than two groups."""
    def gap(c: str) -> Column:
        # a group with an undefined rate makes the gap undefined
        whole = F.count(c) == F.count("*")
        return F.when((F.count("*") >= 2) & whole, F.max(c) - F.min(c))

    ratio = F.when(F.count("*") >= 2, F.try_divide(F.min("positive_rate"), F.max("positive_rate")))
    return groups.groupBy("attribute").agg(
        F.count("*").alias("group_count"),
        gap("positive_rate").alias("dpd"),
        gap("tpr").alias("tpr_gap"),
        gap("fpr").alias("fpr_gap"),
        gap("precision").alias("precision_gap"),
        ratio.alias("disparate_impact"),
    )


def _judge_gap(v: Column) -> Column:
    return F.when(F.abs(v) < GAP_PASS, "PASS").when(F.abs(v) < GAP_WARNING, "WARNING").otherwise("FAIL")


def _judge_ratio(v: Column) -> Column:
    return (
        F.when(v.isNull(), "N/A")
        .when(v.between(*RATIO_PASS), "PASS")
        .when(v.between(*RATIO_WARNING), "WARNING")
        .otherwise("FAIL")
    )


def fairness_judgments(gaps: DataFrame) -> DataFrame:
    parts = ["demographic_parity", "equalized_odds_tpr", "equalized_odds_fpr", "disparate_impact_judgment"]
    judged = gaps.select(
        "*",
        _judge_gap(F.col("dpd")).alias(parts[0]),
        _judge_gap(F.col("tpr_gap")).alias(parts[1]),
        _judge_gap(F.col("fpr_gap")).alias(parts[2]),
        _judge_ratio(F.col("disparate_impact")).alias(parts[3]),
    )
    all_of = F.array(*[F.col(p) for p in parts])
    overall = (
        F.when(F.array_contains(all_of, "FAIL"), "FAIL")
        .when(F.array_contains(all_of, "WARNING"), "WARNING")
        .otherwise("PASS")
    )
    return judged.withColumn("overall", overall)


def fairness_report(judgments: DataFrame) -> DataFrame:
    """Judgments with the attribute's display name and the recommendation, worst first at the sink."""
    label = None
    for name, (text, _) in ATTRIBUTES.items():
        label = F.when(F.col("attribute") == name, text) if label is None else label.when(F.col("attribute") == name, text)
    advice = (
        F.when(F.col("overall") == "FAIL", F.format_string(ADVICE_FAIL, F.col("label")))
        .when(F.col("overall") == "WARNING", F.format_string(ADVICE_WARNING, F.col("label")))
        .otherwise(ADVICE_NONE)
    )
    return judgments.withColumn("label", label).withColumn("recommendation", advice)
