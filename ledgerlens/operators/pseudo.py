"""Pseudo-labelling as a loop: add confident labels, refit, compare on held-out users, keep or roll back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .boosting import BoostedTrees, Model, Params, fit_models, score
from .models import stratified_folds
from .scoring import best_threshold, pr_curve

# Confidence of added positives and negatives, rounds at most, folds of which the first judges.
POSITIVE_AT, NEGATIVE_AT, MOST_ROUNDS, FOLDS = 0.85, 0.05, 2, 5
LEARNER = Params(depth=4, step=0.1)
ROUND_SCHEMA = "round int, positives_added long, negatives_added long, remaining long, f1_before double, f1_after double, outcome string"


def held_out_f1(model: BoostedTrees, held: DataFrame) -> float:
    """Best F1 over all thresholds on labelled users the model has not seen; 0 without a positive."""
    row = best_threshold(pr_curve(score(held, {"risk_score": model}, ["user_id", "status"]))).first()
    return float(row["f_beta"] or 0.0) if row else 0.0


def pseudo_label_rounds(
    train: DataFrame,
    unlabelled: DataFrame,
    cols: list[str],
    learner: Params = LEARNER,
    positive_at: float = POSITIVE_AT,
    negative_at: float = NEGATIVE_AT,
    most_rounds: int = MOST_ROUNDS,
) -> tuple[BoostedTrees, DataFrame]:
    """(model that was kept, round table) from (user_id, status, cols) and unlabelled (user_id, cols).

    One stratified fold of the labelled users never trains; it judges. In each round the unlabelled users whose score is at
    least ``positive_at`` or at most ``negative_at`` get that label and join the training users, and the model is refitted. If the
    held-out F1 falls, the earlier model and labels come back and the loop ends ("rolled back"); otherwise the new ones stay ("kept"). A
    round that finds nobody confident ends the loop ("nothing added"). Labels of earlier rounds are not revised.
    """
    spark = train.sparkSession
    folded = cut_lineage(stratified_folds(train.select("user_id", "status", *cols), FOLDS))
    held = folded.where("fold = 0")
    known = folded.where("fold <> 0").select("user_id", "status", *cols)
    left = unlabelled.select("user_id", *cols)
    fit = lambda df: fit_models(df, cols, [Model("m", learner)])["m"]
    model = fit(known)
    before = held_out_f1(model, held)
    table = []
    for number in range(1, most_rounds + 1):
        scored = score(left, {"p": model}, ["user_id", *cols])
        label = F.when(F.col("p") >= positive_at, 1).when(F.col("p") <= negative_at, 0)
        marked = cut_lineage(scored.select("user_id", label.alias("status"), *cols))
        n = {r["status"]: r["count"] for r in marked.groupBy("status").count().collect()}
        pos, neg, rest = n.get(1, 0), n.get(0, 0), n.get(None, 0)
        if not pos and not neg:
            table.append((number, 0, 0, rest, before, before, "nothing added"))
            break
        more = cut_lineage(known.unionByName(marked.where("status IS NOT NULL")))
        refitted = fit(more)
        after = held_out_f1(refitted, held)
        kept = after >= before
        table.append((number, pos, neg, rest, before, after, "kept" if kept else "rolled back"))
        if not kept:
            break
        known, left, model, before = more, marked.where("status IS NULL").drop("status"), refitted, after
    return model, spark.createDataFrame(table, ROUND_SCHEMA)
