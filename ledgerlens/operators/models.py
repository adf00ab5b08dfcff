"""Model pipeline on the Spark ML learners: folds, selection, stacking, calibration, search."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import boosting
from .boosting import BoostedTrees, Params
from .neighbors import standardize
from .scoring import binary_metrics, meta_features

# Seed, fold count, correlation limit, attributes not used for training.
SEED, FOLDS, MAX_CORRELATION = 42, 5, 0.95
PROTECTED = ["is_female", "age"]
EMBEDDING_SIZE = 16
# boosting rounds, and those of one configuration of the ablation
ROUNDS, ABLATION_ROUNDS = 100, 50
HASH_BUCKETS = 4096


def hashed_rank(df: DataFrame, by: list[str], seed: int = SEED) -> DataFrame:
    """``_rank``: position (from 0) of a row within its group in the order of a hash.

    Positions come from bucket totals plus the place inside a bucket, so even a group that
    holds nearly all rows is ranked by thousands of independent small windows.
    """
    keyed = df.withColumn("_hash", F.xxhash64("user_id", F.lit(seed))).withColumn(
        "_bucket", F.pmod(F.col("_hash"), F.lit(HASH_BUCKETS)).cast("int")
    )
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*by, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_hash", "user_id")
    return (
        keyed.withColumn("_place", F.row_number().over(inside) - 1)
        .join(offsets, [*by, "_bucket"])
        .withColumn("_rank", F.col("_offset") + F.col("_place"))
        .drop("_hash", "_bucket", "_place", "_offset")
    )


def stratified_folds(df: DataFrame, folds: int = FOLDS, seed: int = SEED, label: str = "status") -> DataFrame:
    """``fold`` so that every label is spread evenly; unstratified when a label is rarer than the folds."""
    rarest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    by = [label] if rarest is not None and rarest >= folds else []
    ranked = hashed_rank(df.withColumn("_all", F.lit(0)), by or ["_all"], seed)
    return ranked.withColumn("fold", F.pmod(F.col("_rank"), F.lit(folds)).cast("int")).drop("_rank", "_all")


def assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error").transform(df.fillna(0, subset=cols))


def class_weight(df: DataFrame, balanced: bool = False, label: str = "status") -> DataFrame:
    """``weight``: negatives per positive for positives, or both classes balanced."""
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    pos, neg = max(n.get(1, 0), 1), max(n.get(0, 0), 1)
    up, down = ((pos + neg) / (2 * pos), (pos + neg) / (2 * neg)) if balanced else (neg / pos, 1.0)
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(up))).otherwise(F.lit(float(down))))


def learners(rounds: int = ROUNDS, forest: bool = False) -> dict[str, object]:
    """Three boosted-tree learners that differ in depth, step and sampling, and optionally a forest."""
    common = {"labelCol": "status", "featuresCol": "features", "weightCol": "weight", "maxIter": rounds, "seed": SEED}
    out = {
        "boost_a": GBTClassifier(maxDepth=5, stepSize=0.1, subsamplingRate=0.8, **common),
        "boost_b": GBTClassifier(maxDepth=4, stepSize=0.1, subsamplingRate=0.7, featureSubsetStrategy="0.7", **common),
        "boost_c": GBTClassifier(maxDepth=3, stepSize=0.2, subsamplingRate=1.0, **common),
    }
    if forest:
        out["forest"] = RandomForestClassifier(
            labelCol="status", featuresCol="features", weightCol="weight", numTrees=max(rounds, 20), maxDepth=6, seed=SEED
        )
    return out


def positive_probability(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.get(vector_to_array("probability"), 1)).drop("probability", "rawPrediction", "prediction")


def base_model_scores(train: DataFrame, score: DataFrame, cols: list[str], rounds: int = ROUNDS, forest: bool = True) -> DataFrame:
    """(user_id, model, score) of every learner fitted on ``train``."""
    fitted_on = cut_lineage(class_weight(assemble(train, cols)))
    target = assemble(score, cols)
    parts = []
    for name, learner in learners(rounds, forest).items():
        scored = positive_probability(learner.fit(fitted_on).transform(target), "score")
        parts.append(scored.select("user_id", F.lit(name).alias("model"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def focal_second_pass(train: DataFrame, cols: list[str], rounds: int = ROUNDS):
    """Two passes: the first model's probabilities become focal sample weights of the second."""
    from .scoring import focal_weight

    first_on = cut_lineage(class_weight(assemble(train, cols)))
    learner = learners(rounds)["boost_a"]
    p = positive_probability(learner.fit(first_on).transform(first_on), "risk_score")
    second_on = cut_lineage(focal_weight(p).withColumn("weight", F.col("focal_weight") + 1e-6).drop("risk_score", "focal_weight"))
    return learner.fit(second_on)


# the stack's learners: as the three above, grown together by the boosting of this library
STACK_LEARNERS = {
    "boost_a": Params(depth=5, step=0.1, row_share=0.8, seed=SEED),
    "boost_b": Params(depth=4, step=0.1, row_share=0.7, column_share=0.7, seed=SEED),
    "boost_c": Params(depth=3, step=0.2, seed=SEED),
}


@dataclass
class Stack:
    """Fitted fold models per learner and the meta model over their seven columns."""

    models: dict[str, list[BoostedTrees]]
    meta: object
    columns: list[str]

    META = ["boost_a", "boost_b", "boost_c", "meta_max", "meta_min", "meta_std", "meta_mean"]

    def _meta_score(self, scores: DataFrame) -> DataFrame:
        names = list(self.models)
        ready = meta_features(scores, names)
        vector = VectorAssembler(inputCols=[*names, *self.META[3:]], outputCol="meta_vector").transform(ready)
        return positive_probability(self.meta.transform(vector), "risk_score").drop("meta_vector")

    def score(self, df: DataFrame) -> DataFrame:
        """Average the fold models of each learner, then apply the meta model."""
        every = {f"{name}_{i}": m for name, fitted in self.models.items() for i, m in enumerate(fitted)}
        scores = boosting.score(df, every, ["user_id"])
        mean = {name: sum((F.col(f"{name}_{i}") for i in range(len(fitted))), F.lit(0.0)) / len(fitted) for name, fitted in self.models.items()}
        return self._meta_score(scores.select("user_id", *[c.alias(name) for name, c in mean.items()]))

    def importances(self) -> list[tuple[str, str, float]]:
        rows = []
        for name, fitted in self.models.items():
            shares = [[v / (sum(m.importance()) or 1.0) for v in m.importance()] for m in fitted]
            rows += [(name, c, sum(s[i] for s in shares) / len(shares)) for i, c in enumerate(self.columns)]
        return rows


def fit_stack(train: DataFrame, cols: list[str], folds: int = FOLDS, rounds: int = ROUNDS) -> tuple[Stack, DataFrame]:
    """Stack fitted on (user_id, status, cols) and the out-of-fold scores of the same rows.

    All fold models of all learners grow in the same jobs, one per level of a round.
    """
    data = cut_lineage(stratified_folds(train, folds).select("user_id", "status", "fold", *cols))
    n = {r["status"]: r["count"] for r in data.groupBy("status").count().collect()}
    weight = max(n.get(0, 0), 1) / max(n.get(1, 0), 1)
    jobs = [
        boosting.Model(f"{name}_{fold}", replace(p, rounds=rounds, positive_weight=weight), without=fold) for name, p in STACK_LEARNERS.items() for fold in range(folds)
    ]
    every = boosting.fit_models(data, cols, jobs)
    fitted = {name: [every[f"{name}_{fold}"] for fold in range(folds)] for name in STACK_LEARNERS}
    scored = boosting.score(data, every, ["user_id", "status", "fold"])
    held = {name: F.get(F.array(*[F.col(f"{name}_{fold}") for fold in range(folds)]), F.col("fold")) for name in fitted}
    oof = cut_lineage(scored.select("user_id", "status", *[c.alias(name) for name, c in held.items()]))
    names = list(fitted)
    ready = class_weight(meta_features(oof, names), balanced=True)
    vector = VectorAssembler(inputCols=[*names, *Stack.META[3:]], outputCol="meta_vector").transform(ready)
    meta = LogisticRegression(featuresCol="meta_vector", labelCol="status", weightCol="weight", regParam=0.0, maxIter=100, standardization=True).fit(vector)
    stack = Stack(fitted, meta, cols)
    return stack, stack._meta_score(oof).select("user_id", "status", *names, "risk_score")


# width of the score bins that the isotonic fit runs on
CALIBRATION_STEP = 1e-4


def calibrate(df: DataFrame, folds: int = 3, step: float = CALIBRATION_STEP) -> DataFrame:
    """Isotonic calibration; the score of a row comes from the other folds.

    The fit runs on the mean label per score bin of width ``step``, weighted by its rows, so that 1 / step rows at
    most meet in one place, whatever the number of users. A row's calibrated score is interpolated at its own score.
    """
    data = cut_lineage(stratified_folds(df.select("user_id", "status", "risk_score"), folds))
    at = F.rint(F.col("risk_score") / F.lit(step)) * F.lit(step)
    bins = cut_lineage(data.groupBy("fold", at.alias("risk_score")).agg(F.avg(F.col("status").cast("double")).alias("label"), F.count("*").cast("double").alias("weight")))
    out = None
    for fold in range(folds):
        model = IsotonicRegression(featuresCol="risk_score", labelCol="label", weightCol="weight").fit(bins.where(F.col("fold") != fold))
        part = model.transform(data.where(F.col("fold") == fold)).select(
            "user_id", "status", "risk_score", F.col("prediction").alias("calibrated_score")
        )
        out = part if out is None else out.unionByName(part)
    return out


def tune(train: DataFrame, cols: list[str], trials: int = 20, folds: int = 3, parallelism: int = 2, rounds: tuple = (50, 100)) -> DataFrame:
    """Random grid over depth, step, sampling and rounds; one row per trial with the mean fold F1."""
    import random

    data = cut_lineage(class_weight(assemble(stratified_folds(train, folds), cols)).select("user_id", "status", "fold", "weight", "features"))
    data = data.withColumn("label", F.col("status").cast("double"))
    learner = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", seed=SEED)
    grid = (
        ParamGridBuilder()
        .addGrid(learner.maxDepth, [2, 3, 4, 5])
        .addGrid(learner.stepSize, [0.05, 0.1, 0.2])
        .addGrid(learner.subsamplingRate, [0.7, 1.0])
        .addGrid(learner.maxIter, list(rounds))
        .build()
    )
    chosen = random.Random(SEED).sample(grid, min(trials, len(grid)))
    f1 = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)
    fitted = CrossValidator(
        estimator=learner, estimatorParamMaps=chosen, evaluator=f1, numFolds=folds, foldCol="fold", parallelism=parallelism
    ).fit(data)
    rows = [
        (i, int(p[learner.maxDepth]), float(p[learner.stepSize]), float(p[learner.subsamplingRate]), int(p[learner.maxIter]), float(m))
        for i, (p, m) in enumerate(zip(chosen, fitted.avgMetrics))
    ]
    return train.sparkSession.createDataFrame(rows, "trial int, depth int, step double, sampling double, rounds int, f1 double")


def mean_importance(rows: DataFrame) -> DataFrame:
    """Mean over models of importances scaled to sum 1; input (model, feature, importance), one row per pair."""
    w = Window.partitionBy("model")
    scaled = rows.withColumn("share", F.coalesce(F.try_divide(F.col("importance"), F.sum("importance").over(w)), F.lit(0.0)))
    return scaled.groupBy("feature").agg(F.avg("share").alias("importance"))


# ---- feature selection ----


def column_deviation(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, std, zero_variance) from one pass."""
    one = df.agg(*[F.stddev_samp(c).alias(c) for c in cols])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("std")) for c in cols])))
    return rows.withColumn("zero_variance", F.coalesce(F.col("std") == 0, F.lit(True)).cast("int"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature_a, feature_b, corr) for a < b in column order; null where a column is constant."""
    matrix = Correlation.corr(assemble(df, cols), "features").first()[0].toArray()
    value = lambda r: None if math.isnan(r) else float(r)
    rows = [(cols[i], cols[j], value(matrix[i, j])) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def importance_models(df: DataFrame, cols: list[str], rounds: int = ROUNDS) -> list[BoostedTrees]:
    """One model per stratified fold left out, grown in the same jobs."""
    data = stratified_folds(df.select("user_id", "status", *cols), FOLDS)
    n = {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}
    weight = max(n.get(0, 0), 1) / max(n.get(1, 0), 1)
    params = replace(STACK_LEARNERS["boost_a"], rounds=rounds, positive_weight=weight)
    return list(boosting.fit_models(data, cols, [boosting.Model(f"fold_{k}", params, without=k) for k in range(FOLDS)]).values())


def fold_importance(df: DataFrame, cols: list[str], rounds: int = ROUNDS) -> DataFrame:
    """(feature, importance): the mean over the fold models of the share of each column in the total gain."""
    fitted = importance_models(df, cols, rounds)
    rows = [(f"fold_{k}", c, float(v)) for k, m in enumerate(fitted) for c, v in zip(cols, m.importance())]
    return mean_importance(df.sparkSession.createDataFrame(rows, "model string, feature string, importance double"))


def select_features(df: DataFrame, cols: list[str], limit: float = MAX_CORRELATION, importance_rounds: int = 0) -> tuple[list[str], DataFrame]:
    """Kept columns and a report (feature, stage, kept_instead, corr).

    Zero variance, then correlated pairs from the strongest down (the one less correlated
    with the label goes), then protected attributes, then the columns no tree of any of ``FOLDS`` fold models splits on.
    """
    spark = df.sparkSession
    constant = [r["feature"] for r in column_deviation(df, cols).where("zero_variance = 1").collect()]
    live = [c for c in cols if c not in constant]
    pairs = [(r["feature_a"], r["feature_b"], abs(r["corr"] or 0.0)) for r in correlation_matrix(df, [*live, "status"]).collect()]
    target = {a: r for a, b, r in pairs if b == "status"}
    strong = [(a, b, r) for a, b, r in pairs if b != "status" and r > limit]
    gone: dict[str, tuple] = {}
    for a, b, r in sorted(strong, key=lambda p: (-p[2], p[0], p[1])):
        if a in gone or b in gone:
            continue
        loser, winner = (b, a) if target[a] >= target[b] else (a, b)
        gone[loser] = (winner, r)
    kept = [c for c in live if c not in gone and c not in PROTECTED]
    report = [(c, "zero_variance", None, None) for c in constant]
    report += [(c, "correlated", w, r) for c, (w, r) in gone.items()]
    report += [(c, "protected", None, None) for c in live if c in PROTECTED and c not in gone]
    if importance_rounds:
        fold_models = importance_models(df, kept, importance_rounds)
        useless = [c for i, c in enumerate(kept) if all(m.importance()[i] == 0 for m in fold_models)]
        report += [(c, "zero_importance", None, None) for c in useless]
        kept = [c for c in kept if c not in useless]
    report += [(c, "kept", None, None) for c in kept]
    return kept, spark.createDataFrame(report, "feature string, stage string, kept_instead string, corr double")


# ---- transforms ----


def scale_features(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, robust: bool = False) -> DataFrame:
    """(user_id, scaled array) by mean and population deviation, or by median and quartiles."""
    if not robust:
        return standardize(df, cols, fit_on).withColumnRenamed("vec", "scaled")
    scaler = RobustScaler(inputCol="features", outputCol="scaled", withCentering=True, withScaling=True)
    fitted = scaler.fit(assemble(fit_on if fit_on is not None else df, cols))
    return fitted.transform(assemble(df, cols)).select("user_id", vector_to_array("scaled").alias("scaled"))


def ablation(train: DataFrame, test: DataFrame, configs: dict[str, list[str]], rounds: int = ABLATION_ROUNDS) -> DataFrame:
    """Metrics of one learner per feature set with the change against the first set."""
    parts = None
    for i, (name, cols) in enumerate(configs.items()):
        fitted = learners(rounds)["boost_c"].fit(cut_lineage(class_weight(assemble(train, cols))))
        scored = positive_probability(fitted.transform(assemble(test, cols)), "risk_score")
        row = binary_metrics(scored.select("status", "risk_score")).select(F.lit(i).alias("no"), F.lit(name).alias("config"), "*")
        parts = row if parts is None else parts.unionByName(row)
    rows = cut_lineage(parts)
    base = rows.where("no = 0").select(F.col("auc_pr").alias("base_auc_pr"), F.col("f1").alias("base_f1")).first()
    return rows.withColumns({"delta_auc_pr": F.col("auc_pr") - base["base_auc_pr"], "delta_f1": F.col("f1") - base["base_f1"]})


def submission(scores: DataFrame, threshold: float) -> DataFrame:
    """user_id, score and the 0/1 status to hand in."""
    return scores.select("user_id", "risk_score", (F.col("risk_score") >= threshold).cast("int").alias("status"))


def graph_embedding(df: DataFrame, cols: list[str], size: int = EMBEDDING_SIZE, key: str = "node_id", fit_on: DataFrame | None = None) -> DataFrame:
    """Principal components of neighbour features as columns gnn_emb_0.. ; fit on the training nodes only."""
    k = min(size, len(cols))
    base = fit_on if fit_on is not None else df
    scaler = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(assemble(base, cols))
    pca = PCA(k=k, inputCol="z", outputCol="p").fit(scaler.transform(assemble(base, cols)))
    out = pca.transform(scaler.transform(assemble(df, cols))).withColumn("a", vector_to_array("p"))
    return out.select(key, *[F.col("a")[i].alias(f"gnn_emb_{i}") for i in range(k)])
