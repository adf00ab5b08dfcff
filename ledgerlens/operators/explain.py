"""Attributions of a linear score in long form, their summaries, what-ifs and stability.

The attribution of a linear score is exact: coefficient times distance from the mean.
Long frames have one row per (user_id, feature) with ``fidx``, the position of the
feature, which breaks ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import feature_label, with_label
from ..functions.levels import action_for, level_at_least
from ..session import cut_lineage

# Base value of the waterfall, features a user can change, kinds of features.
BASE_VALUE = -2.885
MUTABLE_FEATURES = [
    "twd_withdraw_ratio",
    "ip_night_ratio",
    "crypto_currency_diversity",
    "kyc_speed_sec",
    "fund_stay_sec",
    "twd_smurf_flag",
    "crypto_wit_count",
]
FEATURE_KINDS = {
    "is_high_risk_career": "binary",
    "is_high_risk_income": "binary",
    "career_income_risk": "binary",
    "is_app_user": "binary",
    "twd_smurf_flag": "binary",
    "is_female": "binary",
    "rapid_kyc_then_trade": "binary",
    "sex": "ordinal",
    "career": "ordinal",
    "income_source": "ordinal",
    "user_source": "ordinal",
}
# Wording of the directions.
DIRECTION_UP, DIRECTION_DOWN = "增加風險", "降低風險"
# Wording of the report.
REPORT_TITLE, REPORT_SCORE, REPORT_LEVEL = "  用戶風險報告  |  User ID: ", "  風險分數   : ", "  風險等級   : "
REPORT_ACTION, REPORT_FACTORS = "  建議行動   : ", "  ── 主要風險因子（SHAP）──"
REPORT_CHANGES = "  ── 可改善建議（反事實）──"
# Stability test.
SSR_EPSILONS, SSR_TOP_K = [0.05, 0.10, 0.15, 0.20], [1, 3, 5]
SSR_TRIALS, SSR_STABLE = 10, 0.8


def column_means(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """One aggregate; the answer has one number per column."""
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: float(row[c] or 0.0) for c in cols}


def attributions(df: DataFrame, coefs: dict[str, float], means: dict[str, float]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            F.lit(i).alias("fidx"),
            F.col(name).cast("double").alias("value"),
            (F.lit(float(w)) * (F.col(name).cast("double") - F.lit(means[name]))).alias("shap"),
        )
        for i, (name, w) in enumerate(coefs.items())
    ]
    return df.select("user_id", F.inline(F.array(*entries)))


def shap_top10(long: DataFrame, k: int = 10) -> DataFrame:
    """Each user's k largest attributions by size; a user has one row per feature, which bounds the window."""
    w = Window.partitionBy("user_id").orderBy(F.abs("shap").desc(), "fidx")
    direction = F.when(F.col("shap") > 0, DIRECTION_UP).otherwise(DIRECTION_DOWN)
    return (
        long.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("direction", direction)
    )


def pivot_wide(long: DataFrame, features: list[str]) -> DataFrame:
    """Back to one row per user; features outside the long frame stay null."""
    return long.groupBy("user_id").agg(*[F.max(F.when(F.col("feature") == f, F.col("shap"))).alias(f) for f in features])


def shap_summary(top: DataFrame) -> DataFrame:
    """Frequency, mean size and mean of each feature over the users it is listed for."""
    out = top.groupBy("feature").agg(
        F.count("*").alias("frequency"),
        F.avg(F.abs("shap")).alias("avg_abs_shap"),
        F.avg("shap").alias("avg_shap"),
    )
    return with_label(out)


def shap_group_mean(top: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """Mean attribution of a group of users, the k largest by size."""
    mean = top.join(members.select("user_id"), "user_id", "left_semi").groupBy("feature").agg(
        F.round(F.avg("shap"), 4).alias("contribution")
    )
    return with_label(mean.orderBy(F.abs("contribution").desc(), "feature").limit(k))


def shap_rank(means: DataFrame) -> DataFrame:
    """Rank, share and running share over (feature, mean_abs_shap); one row per feature."""
    order = Window.orderBy(F.col("mean_abs_shap").desc(), "feature")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = means.withColumn("rank", F.row_number().over(order)).withColumn(
        "share", 100 * F.try_divide(F.col("mean_abs_shap"), F.sum("mean_abs_shap").over(everything))
    )
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return with_label(ranked.withColumn("cumulative_share", F.sum("share").over(running)))


def mean_abs(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def shap_top20(long: DataFrame, k: int = 20, per_user: int = 10) -> DataFrame:
    """Top features by mean size, with how often each is in a user's top ten."""
    listed = shap_top10(long, per_user).groupBy("feature").agg(F.count("*").alias("frequency"))
    ranked = shap_rank(mean_abs(long)).where(F.col("rank") <= k)
    return ranked.join(listed, "feature", "left").fillna(0, subset=["frequency"])


def shap_top20_positive(top: DataFrame, k: int = 20) -> DataFrame:
    """Variant over listed values only; the frequency counts positive values."""
    means = top.groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs_shap"), F.count_if(F.col("shap") > 0).alias("frequency")
    )
    return shap_rank(means).where(F.col("rank") <= k)


def importance_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shares of two importance lists side by side; a feature missing on one side counts 0."""
    a = left.select("feature", F.col("share").alias("share_left"))
    b = right.select("feature", F.col("share").alias("share_right"))
    both = a.join(b, "feature", "full_outer").fillna(0.0)
    return both.withColumn("difference", F.col("share_left") - F.col("share_right")).withColumn(
        "larger", F.greatest("share_left", "share_right")
    )


def case_explanation(top: DataFrame) -> DataFrame:
    """A user's listed attributions with the raw values and display names."""
    return top.select(
        "user_id", "rank", feature_label(F.col("feature")).alias("label"), F.col("shap").alias("contribution"),
        F.col("value").alias("feature_value"),
    )


def waterfall(top: DataFrame, base: float = BASE_VALUE) -> DataFrame:
    """Running total of the listed attributions on top of the base value."""
    w = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    after = F.lit(base) + F.sum("shap").over(w)
    return top.select("user_id", "rank", "feature", "shap", (after - F.col("shap")).alias("from_value"), after.alias("to_value"))


def counterfactuals(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], features: list[str] | None = None, k: int = 5
) -> DataFrame:
    """Set one changeable feature to 0, score again, keep the k largest drops.

    ``score`` adds a ``score`` column to a feature frame: an expression or a fitted
    model's transform. All variants of all users go through it in one batch.
    """
    chosen = [f for f in (features or MUTABLE_FEATURES) if f in df.columns]
    variants = df.withColumn("_variant", F.explode(F.array(*[F.lit(f) for f in ["", *chosen]])))
    current = F.lit(None).cast("double")
    for f in chosen:
        current = F.when(F.col("_variant") == f, F.col(f).cast("double")).otherwise(current)
    changed = variants.withColumn("_current", current).withColumns(
        {f: F.when(F.col("_variant") == f, F.lit(0)).otherwise(F.col(f)) for f in chosen}
    )
    scored = score(changed).select("user_id", "_variant", "_current", "score")
    base = Window.partitionBy("user_id")
    drop = F.max(F.when(F.col("_variant") == "", F.col("score"))).over(base) - F.col("score")
    w = Window.partitionBy("user_id").orderBy(F.col("score_drop").desc(), "feature")
    return (
        scored.withColumn("score_drop", drop)
        .where((F.col("_variant") != "") & (F.round("score_drop", 9) > 0))
        .select("user_id", F.col("_variant").alias("feature"), F.round("_current", 4).alias("current"),
                F.lit(0.0).alias("target"), F.round(F.round("score_drop", 9), 4).alias("score_drop"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def fixed_decimals(value: Column, digits: int = 4) -> Column:
    """Number with a fixed count of decimals, built from integers; beyond 64 bits by Java's formatter."""
    scale = 10**digits
    n = F.rint(F.abs(value) * scale).try_cast("long")
    sign = F.when((value < 0) & F.coalesce(n > 0, F.lit(True)), "-").otherwise("")
    text = F.concat(
        sign, F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0")
    )
    large = F.concat(sign, F.format_string(f"%.{digits}f", F.abs(value).cast("double")))
    return F.when(value.isNotNull(), F.coalesce(text, large))


def risk_report(scores: DataFrame, top: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(user_id, report): score, level, action, five factors and, when given, what-if lines."""
    arrow = F.when(F.col("shap") > 0, "▲").otherwise("▼")
    line = F.concat(
        F.lit("  "), F.col("rank").cast("string"), F.lit(". "), feature_label(F.col("feature")), F.lit(" = "),
        fixed_decimals(F.col("value"), 3), F.lit("  "), arrow, F.lit(" "), fixed_decimals(F.abs("shap")),
    )
    factors = top.where("rank <= 5").groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("factors")
    )
    level = level_at_least(F.col("risk_score"))
    lines = [
        F.concat(F.lit(REPORT_TITLE), F.col("user_id").cast("string")),
        F.concat(F.lit(REPORT_SCORE), fixed_decimals(F.col("risk_score"))),
        F.concat(F.lit(REPORT_LEVEL), level),
        F.concat(F.lit(REPORT_ACTION), action_for(level)),
        F.lit(REPORT_FACTORS),
    ]
    out = scores.join(factors, "user_id", "left")
    body = F.concat(F.array(*lines), F.coalesce(F.transform("factors", lambda f: f["line"]), F.array().cast("array<string>")))
    if changes is not None:
        text = F.concat(
            F.lit("  • 若將「"), feature_label(F.col("feature")), F.lit("」從 "), fixed_decimals(F.col("current")),
            F.lit(" 調整至 0.0，風險分數可降低 "), fixed_decimals(F.col("score_drop")),
        )
        listed = changes.groupBy("user_id").agg(
            F.array_sort(F.collect_list(F.struct("rank", text.alias("line")))).alias("changes")
        )
        out = out.join(listed, "user_id", "left")
        extra = F.concat(F.array(F.lit(REPORT_CHANGES)), F.transform("changes", lambda f: f["line"]))
        body = F.concat(body, F.when(F.col("changes").isNotNull(), extra).otherwise(F.array().cast("array<string>")))
    return out.select("user_id", F.array_join(body, "\n").alias("report"))


def predict_reports(scores: DataFrame, top: DataFrame, changes: DataFrame, k: int = 10) -> DataFrame:
    """The k riskiest users with five factors and their what-ifs as JSON."""
    best = cut_lineage(scores.orderBy(F.col("risk_score").desc(), "user_id").limit(k))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("risk_score").desc(), "user_id")))
    # only their attributions and what-ifs are gathered; the semi join goes below the windows
    listed = F.broadcast(best.select("user_id"))
    factors = (
        top.where("rank <= 5")
        .join(listed, "user_id", "left_semi")
        .select("user_id", F.struct("rank", "feature", "value", "shap", "direction").alias("f"))
        .groupBy("user_id")
        .agg(F.to_json(F.array_sort(F.collect_list("f"))).alias("shap_factors"))
    )
    what_if = (
        changes.join(listed, "user_id", "left_semi")
        .select("user_id", F.struct("rank", "feature", "current", "target", "score_drop").alias("c"))
        .groupBy("user_id")
        .agg(F.to_json(F.array_sort(F.collect_list("c"))).alias("counterfactual"))
    )
    return (
        ranked.join(factors, "user_id", "left")
        .join(what_if, "user_id", "left")
        .select("rank", "user_id", "risk_score", level_at_least(F.col("risk_score")).alias("risk_level"), "shap_factors", "counterfactual")
    )


def predict_list(scores: DataFrame, top: DataFrame, threshold: float) -> DataFrame:
    """Unlabelled users with their listed attributions as JSON, largest first; sort by score at the sink."""
    lists = top.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", feature_label(F.col("feature")).alias("feature_name"), F.col("shap").alias("contribution")))).alias("f")
    )
    return scores.join(lists, "user_id", "left").select(
        "user_id",
        "risk_score",
        (F.col("risk_score") >= threshold).cast("int").alias("is_blacklist"),
        F.to_json(F.transform("f", lambda x: x.dropFields("rank"))).alias("shap_features"),
    )


def _uniform(*parts) -> Column:
    """A number in (0, 1) fixed by its arguments, so a lost task draws the same one again."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def perturb(
    df: DataFrame,
    features: list[str],
    stds: dict[str, float],
    bounds: dict[str, tuple[float, float]],
    epsilons: list[float] = SSR_EPSILONS,
    trials: int = SSR_TRIALS,
    kinds: dict[str, str] | None = None,
    valid: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Rows x epsilons x trials with each feature disturbed according to its kind.

    continuous: normal noise of epsilon standard deviations; binary: flipped with
    probability epsilon; ordinal: moved one step with probability epsilon, turning back at
    the bounds; label_encoded: another valid value with probability epsilon.
    """
    kinds = FEATURE_KINDS if kinds is None else kinds
    grid = df.withColumn("epsilon", F.explode(F.array(*[F.lit(float(e)) for e in epsilons]))).withColumn(
        "trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))
    )
    cols = {}
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        draw = lambda salt, i=i: _uniform(F.lit(i), F.lit(salt), "user_id", "epsilon", "trial")
        hit = draw(0) < F.col("epsilon")
        kind = kinds.get(f, "continuous")
        if kind == "binary":
            cols[f] = F.when(hit, 1.0 - x).otherwise(x)
        elif kind == "ordinal":
            low, high = bounds[f]
            moved = x + F.when(draw(1) < 0.5, -1.0).otherwise(1.0)
            turned = F.when(moved < low, x + 1).when(moved > high, x - 1).otherwise(moved)
            cols[f] = F.when(hit, F.least(F.greatest(turned, F.lit(low)), F.lit(high))).otherwise(x)
        elif kind == "label_encoded":
            others = F.filter(F.array(*[F.lit(float(v)) for v in (valid or {})[f]]), lambda v, x=x: v != x)
            pick = F.get(others, F.floor(draw(1) * F.size(others)).cast("int"))
            cols[f] = F.when(hit, F.coalesce(pick, x)).otherwise(x)
        else:
            normal = F.sqrt(-2 * F.ln(draw(2))) * F.cos(draw(3) * 2 * 3.141592653589793)
            cols[f] = x + normal * F.col("epsilon") * float(stds[f])
    return grid.withColumns(cols)


def _ordered_top(coefs: dict[str, float], means: dict[str, float]) -> Column:
    """Feature positions by size of attribution, largest first."""
    entries = [
        F.struct((-F.abs(F.lit(float(w)) * (F.col(f) - F.lit(means[f])))).alias("s"), F.lit(i).alias("i"))
        for i, (f, w) in enumerate(coefs.items())
    ]
    return F.transform(F.array_sort(F.array(*entries)), lambda e: e["i"])


def ssr(
    df: DataFrame,
    coefs: dict[str, float],
    samples: int | None = None,
    trials: int = SSR_TRIALS,
    epsilons: list[float] = SSR_EPSILONS,
    top_k: list[int] = SSR_TOP_K,
    stable: float = SSR_STABLE,
) -> DataFrame:
    """Share of users whose ordered top k stays the same in enough trials.

    One row per (epsilon, k, class); class -1 is everybody. All users take part unless ``samples`` asks
    for that many, chosen by a hash.
    """
    feats = list(coefs)
    stats = df.agg(
        *[F.avg(f).alias(f"m_{f}") for f in feats],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in feats],
        *[F.min(f).alias(f"l_{f}") for f in feats],
        *[F.max(f).alias(f"h_{f}") for f in feats],
    ).first()
    means = {f: float(stats[f"m_{f}"]) for f in feats}
    stds = {f: float(stats[f"s_{f}"]) or 1.0 for f in feats}
    bounds = {f: (float(stats[f"l_{f}"]), float(stats[f"h_{f}"])) for f in feats}
    sample = df.select("user_id", "status", *[F.col(f).cast("double").alias(f) for f in feats])
    if samples is not None:
        sample = sample.orderBy(F.xxhash64("user_id"), "user_id").limit(samples)
    before = sample.withColumn("before", _ordered_top(coefs, means))
    moved = perturb(before, feats, stds, bounds, epsilons, trials).withColumn("after", _ordered_top(coefs, means))
    same = [(F.slice("before", 1, k) == F.slice("after", 1, k)).cast("int").alias(f"k{k}") for k in top_k]
    per_user = moved.select("user_id", "status", "epsilon", *same).groupBy("user_id", "status", "epsilon").agg(
        *[(F.sum(f"k{k}") >= int(stable * trials)).cast("double").alias(f"k{k}") for k in top_k]
    )
    by_class = per_user.withColumn("class", F.explode(F.array(F.lit(-1), F.col("status"))))
    long = by_class.select(
        "epsilon",
        "class",
        F.inline(F.array(*[F.struct(F.lit(k).alias("top_k"), F.col(f"k{k}").alias("stays")) for k in top_k])),
    )
    return long.groupBy("epsilon", "top_k", "class").agg(F.round(F.avg("stays"), 4).alias("ssr"))
