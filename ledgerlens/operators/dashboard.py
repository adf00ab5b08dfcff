"""Queries behind the risk dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import DASHBOARD_THRESHOLD, outcome

# Score buckets of the distribution chart and the node list cut.
BUCKETS = [(0.2, "[0, 0.2)"), (0.4, "[0.2, 0.4)"), (0.6, "[0.4, 0.6)"), (0.8415, "[0.6, 0.8415)")]
LAST_BUCKET = "[0.8415, 1.0]"
NODE_CUT = 0.4


def search_nodes(df: DataFrame, keyword: str = "", cut: float | None = NODE_CUT) -> DataFrame:
    """Users whose id contains the trimmed keyword, by default only those at or above the cut."""
    word = keyword.strip()
    out = df if cut is None else df.where(F.col("risk_score") >= cut)
    return out.where(F.col("user_id").cast("string").contains(word)) if word else out


def risk_bucket(score):
    out = None
    for high, name in BUCKETS:
        out = F.when(score < high, name) if out is None else out.when(score < high, name)
    return out.otherwise(LAST_BUCKET)


def dashboard_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value) rows: node totals, fraud share, score buckets, edges per relation."""
    users = nodes.where("node_type = 'user'")
    bucket = risk_bucket(F.col("risk_score"))
    names = [n for _, n in BUCKETS] + [LAST_BUCKET]
    totals = users.agg(
        F.count("*").alias("total_nodes"),
        F.count_if(F.col("label") >= 1).alias("fraud_nodes"),
        *[F.count_if(bucket == n).alias(f"b{i}") for i, n in enumerate(names)],
    )
    metrics = [
        ("total_nodes", F.col("total_nodes")),
        ("fraud_nodes", F.col("fraud_nodes")),
        ("normal_nodes", F.col("total_nodes") - F.col("fraud_nodes")),
        ("fraud_ratio", F.coalesce(F.try_divide(F.col("fraud_nodes"), F.col("total_nodes")), F.lit(0.0))),
        *[(n, F.col(f"b{i}")) for i, n in enumerate(names)],
    ]
    node_rows = totals.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics]))
    )
    kinds = {"R1": "wallet_funds_user", "R2": "user_transfers_user", "R3": "user_sends_wallet"}
    per_kind = edges.agg(*[F.count_if(F.col("edge_type") == k).alias(r) for r, k in kinds.items()])
    edge_rows = per_kind.select(
        F.inline(
            F.array(*[F.struct(F.lit(r).alias("metric"), F.col(r).cast("double").alias("value")) for r in kinds])
        )
    )
    return node_rows.unionByName(edge_rows)


def labelled_risk_list(df: DataFrame) -> DataFrame:
    """Every user with a label; sort by score at the sink."""
    return df.where(F.col("status").isin(0, 1)).select("user_id", "risk_score")


def fp_fn(df: DataFrame, threshold: float = DASHBOARD_THRESHOLD) -> DataFrame:
    predicted = F.col("risk_score") >= threshold
    return (
        df.withColumn("outcome", outcome(F.col("status"), predicted))
        .where(F.col("outcome").isin("FP", "FN"))
        .select("outcome", "user_id", "risk_score", "status", predicted.cast("int").alias("predicted_status"))
    )


def case_groups(df: DataFrame, threshold: float) -> DataFrame:
    """Case sheets as rows: black (label 1), FP, FN, and predicted black among unlabeled users.

    A labelled positive below the threshold is in both ``black`` and ``FN``; write with
    partitionBy('case_group').
    """
    predicted = F.col("risk_score") >= threshold
    label = F.col("status")
    groups = F.array_compact(
        F.array(
            F.when(label == 1, "black"),
            F.when((label == 0) & predicted, "FP"),
            F.when((label == 1) & ~predicted, "FN"),
            F.when(label.isNull() & predicted, "predicted_black"),
        )
    )
    return df.select("user_id", "risk_score", F.explode(groups).alias("case_group"))
