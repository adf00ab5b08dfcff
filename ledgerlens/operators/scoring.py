"""Score algebra: metrics, curves, thresholds, fusion, pseudo-labels, case picks.

Inputs carry ``user_id``, ``status`` (0/1) and ``risk_score`` unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import LEVELS, level_at_least, risk_level
from ..functions.prefix import running_totals
from ..functions.scalars import EPS, safe_ratio

# Operating points.
DASHBOARD_THRESHOLD = 0.8415
COST_FN, COST_FP = 10, 1
SWEEP = [(5 + i) / 100 for i in range(90)]
FUSION_SWEEP = [(10 + 5 * i) / 100 for i in range(16)]
COARSE_SWEEP = [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]
STRATEGIES = ["weighted", "cascade", "voting", "tiered"]


def outcome(label: Column, predicted: Column) -> Column:
    return (
        F.when((label == 1) & predicted, "TP")
        .when((label == 0) & predicted, "FP")
        .when((label == 1) & ~predicted, "FN")
        .when((label == 0) & ~predicted, "TN")
    )


def _f1(p: Column, r: Column) -> Column:
    return safe_ratio(2 * p * r, p + r)


def confusion_matrix(df: DataFrame, threshold: float = DASHBOARD_THRESHOLD) -> DataFrame:
    """Counts and the derived rates of both classes in one row."""
    kind = outcome(F.col("status"), F.col("risk_score") >= threshold)
    n = {k: F.col(k.lower()) for k in ("TP", "FP", "FN", "TN")}
    counts = df.where(F.col("status").isin(0, 1)).agg(*[F.count_if(kind == k).alias(k.lower()) for k in n])
    total = n["TP"] + n["FP"] + n["FN"] + n["TN"]
    precision, recall = safe_ratio(n["TP"], n["TP"] + n["FP"]), safe_ratio(n["TP"], n["TP"] + n["FN"])
    precision0, recall0 = safe_ratio(n["TN"], n["TN"] + n["FN"]), safe_ratio(n["TN"], n["TN"] + n["FP"])
    f1, f1_normal = _f1(precision, recall), _f1(precision0, recall0)
    weighted = f1_normal * (n["TN"] + n["FP"]) + f1 * (n["TP"] + n["FN"])
    return counts.select(
        "*",
        total.alias("total"),
        safe_ratio(n["TP"] + n["TN"], total).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        f1_normal.alias("f1_normal"),
        safe_ratio(weighted, total).alias("f1_weighted"),
        recall0.alias("specificity"),
    )


def _ranked(df: DataFrame) -> DataFrame:
    marked = df.where(F.col("status").isin(0, 1) & F.col("risk_score").isNotNull()).select(
        "risk_score", (F.col("status") == 1).cast("long").alias("pos"), (F.col("status") == 0).cast("long").alias("neg")
    )
    return running_totals(marked, "risk_score", ["pos", "neg"])


def pr_curve(df: DataFrame, beta: float = 1.0) -> DataFrame:
    """Precision, recall and F-beta at every distinct score."""
    ranked = _ranked(df)
    positives = ranked.agg(F.sum("pos")).scalar()
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    recall = safe_ratio(F.col("cum_pos"), F.col("all_pos"))
    b2 = beta * beta
    return (
        ranked.withColumn("all_pos", positives)
        .select(
            F.col("risk_score").alias("threshold"),
            F.col("cum_pos").alias("tp"),
            F.col("cum_neg").alias("fp"),
            precision.alias("precision"),
            recall.alias("recall"),
        )
        .withColumn(
            "f_beta",
            (1 + b2) * F.col("precision") * F.col("recall") / (b2 * F.col("precision") + F.col("recall") + EPS),
        )
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """Highest F-beta; the lowest threshold wins a tie."""
    return curve.orderBy(F.col("f_beta").desc(), F.col("threshold").asc()).limit(1)


def binary_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """ROC area by rank sums, step-wise average precision, and rates at the threshold."""
    above = F.col("risk_score") >= threshold
    sums = _ranked(df).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        # negatives ranked above a positive, ties counted half, are the complement of the area
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("lost"),
        F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))).alias("ap"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
    )
    c = F.col
    precision, recall = safe_ratio(c("tp"), c("tp") + c("fp")), safe_ratio(c("tp"), c("p"))
    return sums.select(
        F.when((c("p") > 0) & (c("n") > 0), 1 - c("lost") / (c("p") * c("n"))).alias("auc_roc"),
        safe_ratio(c("ap"), c("p")).alias("auc_pr"),
        _f1(precision, recall).alias("f1"),
        precision.alias("precision"),
        recall.alias("recall"),
        safe_ratio(c("fp"), c("n")).alias("fpr"),
    )


def threshold_sweep(df: DataFrame, thresholds: list[float] = SWEEP, keys: list[str] | None = None) -> DataFrame:
    """Confusion counts, rates and cost at each threshold.

    Every row is reduced to how many thresholds it passes; the running sums then see
    one row per threshold (and key), never one per user.
    """
    keys = keys or []
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    hist = (
        df.where(F.col("status").isin(0, 1))
        .select(*keys, "status", F.size(F.filter(grid, lambda t: t <= F.col("risk_score"))).alias("passed"))
        .groupBy(*keys, "passed")
        .agg(F.count_if(F.col("status") == 1).alias("pos"), F.count_if(F.col("status") == 0).alias("neg"))
    )
    # each bucket holds for the first `passed` thresholds: fan out the short histogram and add up
    hit = lambda c: F.sum(F.when(F.col("step") < F.col("passed"), F.col(c)).otherwise(F.lit(0)))
    counts = (
        hist.select("*", F.posexplode(grid).alias("step", "threshold"))
        .groupBy(*keys, "step", "threshold")
        .agg(hit("pos").alias("tp"), hit("neg").alias("fp"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    )
    c = F.col
    precision, recall = safe_ratio(c("tp"), c("tp") + c("fp")), safe_ratio(c("tp"), c("p"))
    cost = COST_FN * (c("p") - c("tp")) + COST_FP * c("fp")
    return counts.select(
        *keys,
        "threshold",
        "tp",
        "fp",
        (c("n") - c("fp")).alias("tn"),
        (c("p") - c("tp")).alias("fn"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        safe_ratio(c("fp"), c("n")).alias("fpr"),
        safe_ratio(c("p") - c("tp"), c("p")).alias("fnr"),
        cost.cast("long").alias("total_cost"),
        safe_ratio(cost, c("p") + c("n")).alias("cost_per_user"),
    )


def threshold_picks(sweep: DataFrame) -> DataFrame:
    """One row per rule; the lowest threshold wins a tie. Input has one row per threshold."""
    best_recall = F.col("recall") >= 0.70
    rules = [
        ("best_f1", F.lit(True), F.col("f1").desc()),
        ("min_cost", F.lit(True), F.col("total_cost").asc()),
        ("precision_at_recall_70", best_recall, F.col("precision").desc()),
        ("balanced", F.lit(True), F.abs(F.col("precision") - F.col("recall")).asc()),
        ("recall_50_precision_20", (F.col("recall") >= 0.5) & (F.col("precision") >= 0.2), F.col("f1").desc()),
    ]
    parts = []
    for name, keep, order in rules:
        rank = F.row_number().over(Window.orderBy(order, F.col("threshold")))
        parts.append(
            sweep.where(keep)
            .withColumn("_rank", rank)
            .where("_rank = 1")
            .select(F.lit(name).alias("rule"), "threshold", "precision", "recall", "f1", "total_cost")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def risk_distribution(df: DataFrame) -> DataFrame:
    """Users per level, with a row for levels nobody has."""
    spark = df.sparkSession
    names = spark.range(len(LEVELS)).select(F.array(*[F.lit(n) for n in LEVELS])[F.col("id").cast("int")].alias("risk_level"))
    counts = df.groupBy(risk_level(F.col("risk_score")).alias("risk_level")).agg(F.count("*").alias("users"))
    return names.join(counts, "risk_level", "left").fillna(0, subset=["users"])


def rethreshold(df: DataFrame, cuts: list[float], label_at: float) -> DataFrame:
    return df.select(
        "user_id",
        "risk_score",
        level_at_least(F.col("risk_score"), cuts).alias("risk_level"),
        (F.col("risk_score") >= label_at).cast("int").alias("predicted_blacklist"),
    )


def top_risk_users(df: DataFrame, k: int = 10) -> DataFrame:
    return (
        df.select("user_id", "risk_score", level_at_least(F.col("risk_score")).alias("risk_level"))
        .orderBy(F.col("risk_score").desc(), F.col("user_id"))
        .limit(k)
    )


def meta_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Model scores with their row-wise maximum, minimum, population deviation and mean."""
    scores = [F.col(c) for c in cols]
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    mean = total / len(scores)
    var = (scores[0] - mean) * (scores[0] - mean)
    for s in scores[1:]:
        var = var + (s - mean) * (s - mean)
    return df.withColumns(
        {
            "meta_max": F.greatest(*scores),
            "meta_min": F.least(*scores),
            "meta_std": F.sqrt(var / len(scores)),
            "meta_mean": mean,
        }
    )


def blend_scores(df: DataFrame, weights: dict[str, float], graph: str | None = None) -> DataFrame:
    """Weighted mean of model scores (weights are the models' AUC-PR), then 0.9 / 0.1 with a graph score."""
    total = sum(weights.values())
    blended = F.lit(0.0)
    for c, w in weights.items():
        blended = blended + F.col(c) * (w / total)
    if graph is not None:
        blended = 0.9 * blended + 0.1 * F.col(graph)
    return df.withColumn("blended_score", blended)


def focal_weight(df: DataFrame, alpha: float = 0.75, gamma: float = 2.0) -> DataFrame:
    """Sample weight alpha_t * (1 - p_t)**gamma from a first-pass probability.

    The tree learner has no custom loss, so the focal gradient scale becomes the weight
    column of a second pass.
    """
    positive = F.col("status") == 1
    p_t = F.when(positive, F.col("risk_score")).otherwise(1 - F.col("risk_score"))
    a_t = F.when(positive, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return df.withColumn("focal_weight", a_t * F.pow(1 - p_t, F.lit(gamma)))


def pseudo_labels(unlabeled: DataFrame, positive_at: float = 0.85, negative_at: float = 0.05) -> DataFrame:
    """Confident unlabeled users and the label they get.

    Scores do not change between rounds of one fitted model, so a second round adds nothing.
    """
    score = F.col("risk_score")
    label = F.when(score >= positive_at, 1).when(score <= negative_at, 0)
    return unlabeled.select("user_id", "risk_score", label.alias("pseudo_label")).where("pseudo_label is not null")


def pseudo_label_stats(unlabeled: DataFrame, positive_at: float = 0.85, negative_at: float = 0.05) -> DataFrame:
    score = F.col("risk_score")
    pos, neg = score >= positive_at, score <= negative_at
    return unlabeled.agg(
        F.count_if(pos).alias("pos_added"),
        F.count_if(neg).alias("neg_added"),
        F.count_if(~pos & ~neg).alias("remaining"),
        F.avg(score).alias("score_mean"),
        F.stddev_pop(score).alias("score_std"),
    )


def _fused(model: Column, similar: Column, weights: tuple[float, float]) -> dict[str, tuple[Column, Column]]:
    agreement = 1 - F.abs(model - similar)
    w_model, w_similar = weights
    both = (model > 0.5) & (similar > 0.5)
    return {
        "weighted": (w_model * model + w_similar * similar, agreement),
        "cascade": (
            F.when(model > 0.3, (model + similar) / 2).otherwise(model * 0.5),
            F.when(model > 0.3, agreement).otherwise(model),
        ),
        "voting": (F.least(model, similar) * 2, F.when(both, F.lit(1.0)).otherwise(F.lit(0.3))),
        "tiered": (
            F.when(model > 0.7, model * 0.9 + similar * 0.1)
            .when(model >= 0.3, model * 0.6 + similar * 0.4)
            .otherwise(model * 0.3 + similar * 0.7),
            F.when(model > 0.7, F.lit(0.9)).when(model >= 0.3, agreement).otherwise(similar),
        ),
    }


def fuse_scores(df: DataFrame, model: str, similar: str, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Long form: one row per user and fusion strategy with the fused score and its confidence."""
    fused = _fused(F.col(model), F.col(similar), weights)
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("strategy"), fused[s][0].alias("hybrid_score"), fused[s][1].alias("confidence"))
            for s in STRATEGIES
        ]
    )
    return df.select("*", F.inline(rows))


def fusion_compare(fused: DataFrame) -> DataFrame:
    """Best threshold of each strategy by F1; the lowest threshold wins a tie."""
    sweep = threshold_sweep(
        fused.select("strategy", "status", F.col("hybrid_score").alias("risk_score")), FUSION_SWEEP, ["strategy"]
    )
    w = Window.partitionBy("strategy").orderBy(F.col("f1").desc(), F.col("threshold"))
    return (
        sweep.withColumn("_rank", F.row_number().over(w))
        .where("_rank = 1")
        .select("strategy", "threshold", "precision", "recall", "f1", "tp", "fp", "fn", "tn")
    )


# Reason texts of the fused decision.
REASON_BOTH_HIGH = "兩個模型都認為是黑名單（高置信度）"
REASON_MODEL_HIGH = "Ensemble 模型判定為高風險"
REASON_SIMILAR = "與黑名單群組高度相似"
REASON_COMBINED = "綜合評估後判定為黑名單（置信度中等）"
REASON_BOTH_LOW = "兩個模型都認為是正常用戶"
REASON_DISAGREE = "兩個模型意見不一致，建議人工審核"


def fusion_explain(fused: DataFrame, model: str, similar: str, threshold: float = 0.5) -> DataFrame:
    m, s, h = F.col(model), F.col(similar), F.col("hybrid_score")
    hit = h >= threshold
    reason = (
        F.when(hit & (m > 0.7) & (s > 0.5), REASON_BOTH_HIGH)
        .when(hit & (m > 0.7), REASON_MODEL_HIGH)
        .when(hit & (s > 0.7), REASON_SIMILAR)
        .when(hit, REASON_COMBINED)
        .when((m < 0.3) & (s < 0.3), REASON_BOTH_LOW)
        .when(F.abs(m - s) > 0.4, REASON_DISAGREE)
        .otherwise("")
    )
    return fused.select(
        "user_id",
        "strategy",
        "hybrid_score",
        "confidence",
        hit.cast("int").alias("prediction"),
        level_at_least(h).alias("risk_level"),
        reason.alias("reason"),
        (~hit & (F.abs(m - s) > 0.4) & ~((m < 0.3) & (s < 0.3))).cast("int").alias("manual_review"),
    )


def case_examples(df: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """The k highest scores of each of TP, FN and FP.

    Each outcome is a global top-k (kept per partition, then merged), so no outcome is
    sorted as a whole in one task.
    """
    tagged = df.withColumn("outcome", outcome(F.col("status"), F.col("risk_score") >= threshold))
    parts = [
        tagged.where(F.col("outcome") == o).orderBy(F.col("risk_score").desc(), "user_id").limit(k)
        for o in ("TP", "FN", "FP")
    ]
    top = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = Window.partitionBy("outcome").orderBy(F.col("risk_score").desc(), "user_id")
    return top.select("outcome", F.row_number().over(w).alias("case_no"), "user_id", "risk_score")
