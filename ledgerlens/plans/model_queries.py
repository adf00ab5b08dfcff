"""Neighbour, anomaly, blacklist and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prefix import global_percentiles
from ..operators import anomaly, blacklist, boosting, explain, graph, mart, models, neighbors, profile, pseudo, search, tree_shap
from ..operators.scoring import best_threshold, pr_curve
from ..session import cut_lineage
from ..sources.fixtures import AS_OF, tables
from .common import scored, split_side
from .graph_queries import _edges, _nodes
from .oracle import add_blocks
from .registry import query

# All features of the lite mart, in its order.
VEC = (
    "has_kyc_level2 kyc_speed_sec account_age_days age is_high_risk_career is_high_risk_income career_income_risk is_app_user"
    " twd_dep_count twd_dep_sum twd_dep_mean twd_dep_std twd_dep_max twd_wit_count twd_wit_sum twd_wit_mean twd_wit_std twd_wit_max"
    " twd_smurf_flag twd_wit_ip_ratio twd_withdraw_ratio crypto_dep_count crypto_dep_sum crypto_dep_mean crypto_dep_max"
    " crypto_wit_count crypto_wit_sum crypto_wit_mean crypto_wit_max crypto_external_wit_count crypto_currency_diversity"
    " crypto_protocol_diversity crypto_internal_peer_count crypto_wit_ip_ratio trading_count trading_sum trading_mean trading_max"
    " trading_buy_ratio trading_market_order_ratio swap_count swap_sum total_trading_volume ip_unique_count ip_total_count"
    " ip_night_ratio ip_max_shared fund_stay_sec quick_kyc_quick_withdraw new_account_high_risk night_high_frequency"
    " large_fast_turnover smurf_withdraw_pattern currency_protocol_complexity risky_career_low_kyc withdraw_velocity"
    " ip_diversity_frequency age_volume_mismatch composite_risk_score"
).split()



def _z_scores(fit_on: str) -> str:
    """vec of every user, scaled by the users that meet the condition; a constant column is only centred."""
    one = "(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END"
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in VEC)
    return (
        "SELECT user_id, [" + ", ".join(one.format(c=c) for c in VEC) + "] AS vec FROM f_mart_lite,"
        f" (SELECT {stats} FROM f_mart_lite JOIN (SELECT user_id, status FROM user_info) USING (user_id) WHERE {fit_on})"
    )


add_blocks(
    {
        "z_vec": _z_scores("TRUE"),
        # the scale of the blacklist is that of the positives
        "zb_vec": _z_scores("status = 1"),
        "zb_pos": "SELECT z.* FROM zb_vec z JOIN user_info u ON z.user_id = u.user_id WHERE status = 1",
        "knn_black": """
SELECT q.user_id AS qid, r.user_id AS rid, list_distance(q.vec, r.vec) AS distance,
  row_number() OVER (PARTITION BY q.user_id ORDER BY round(list_distance(q.vec, r.vec), 12), r.user_id) AS rank
FROM zb_vec q, zb_pos r QUALIFY rank <= 10""",
        "knn_mean": "SELECT qid, avg(distance) AS mean_distance FROM knn_black GROUP BY qid",
        "lof_near": """
SELECT q.user_id AS qid, r.user_id AS rid, list_distance(q.vec, r.vec) AS distance,
  row_number() OVER (PARTITION BY q.user_id ORDER BY round(list_distance(q.vec, r.vec), 12), r.user_id) AS rank
FROM z_vec q, z_vec r WHERE q.user_id <> r.user_id QUALIFY rank <= 20""",
        "lof_kd": "SELECT qid, max(distance) AS kd FROM lof_near GROUP BY qid",
        "lof_lrd": "SELECT n.qid, 1 / (avg(greatest(distance, kd)) + 1e-10) AS lrd FROM lof_near n JOIN lof_kd k ON n.rid = k.qid GROUP BY n.qid",
        "hb_long": f"SELECT user_id, unnest(range(0, {len(VEC)})) AS f, unnest(vec) AS x FROM z_vec",
        "hb_edge": "SELECT f, min(x) AS lo, CASE WHEN max(x) = min(x) THEN 1 / 20 ELSE (max(x) - min(x)) / 20 END AS w, count(*) AS n FROM hb_long GROUP BY f",
        "hb_bins": "SELECT user_id, l.f, least(greatest(floor(round((x - lo) / w, 9)), 0), 19) AS b, w, n FROM hb_long l JOIN hb_edge e ON l.f = e.f",
        "hb_count": "SELECT f, b, count(*) AS c FROM hb_bins GROUP BY f, b",
    }
)


def _mart(spark, sf):
    return cut_lineage(mart.feature_mart_lite(tables(spark, sf), AS_OF).select("user_id", *VEC))


def _vectors(spark, sf, positives_only=True):
    """(user_id, vec) of every user and of the positives, on the scale of the positives or of all users."""
    df = _mart(spark, sf)
    black = tables(spark, sf).users.where("status = 1").select("user_id")
    vecs = cut_lineage(neighbors.standardize(df, VEC, df.join(black, "user_id", "left_semi") if positives_only else None))
    return vecs, vecs.join(black, "user_id", "left_semi")


def _as(name, df):
    return df.select(F.col("user_id").alias(name), "vec")


def _near_black(spark, sf, k=10):
    vecs, black = _vectors(spark, sf)
    return neighbors.knn_join(_as("qid", vecs), _as("rid", black), k), vecs, black


@query(
    "knn_similarity",
    """SELECT qid, mean_distance, 1 - least(greatest(mean_distance / ((SELECT quantile_cont(mean_distance, 0.95) FROM knn_mean) + 1e-9), 0), 1) AS knn_similarity FROM knn_mean""",
    ratio="mean_distance knn_similarity",
)
def _(spark, sf):
    near = cut_lineage(_near_black(spark, sf)[0])
    mean = near.groupBy("qid").agg(F.avg("distance").alias("d"))
    p95 = global_percentiles(mean, "d", {"p95": 0.95}).first()["d"]
    return neighbors.knn_similarity(near, float(p95))


@query(
    "similar_cases",
    f"""SELECT qid, string_agg(CAST(rid AS STRING), ',' ORDER BY rank) AS similar_ids, max(distance) AS farthest,
  list_sum(list_transform(range(1, {len(VEC) + 1}), lambda i: abs(any_value(q.vec)[i] - avg_vec[i]))) AS feature_difference_sum
FROM (SELECT k.*, [{", ".join(f"avg(r.vec[{i + 1}]) OVER w" for i in range(len(VEC)))}] AS avg_vec
      FROM knn_black k JOIN zb_vec r ON k.rid = r.user_id WHERE rank <= 5 WINDOW w AS (PARTITION BY qid))
JOIN zb_vec q ON q.user_id = qid GROUP BY qid, avg_vec""",
    ratio="farthest feature_difference_sum",
)
def _(spark, sf):
    near, vecs, black = _near_black(spark, sf, 5)
    cases = neighbors.similar_cases(near, _as("qid", vecs), _as("rid", black))
    return cases.select(
        "qid",
        F.concat_ws(",", F.transform("similar_ids", lambda i: i.cast("string"))).alias("similar_ids"),
        F.array_max("distances").alias("farthest"),
        F.aggregate("feature_difference", F.lit(0.0), lambda a, x: a + x).alias("feature_difference_sum"),
    )


@query(
    "lof_score",
    """SELECT n.qid AS user_id, avg(d.lrd) / any_value(own.lrd) AS lof_score FROM lof_near n JOIN lof_lrd d ON n.rid = d.qid
JOIN lof_lrd own ON own.qid = n.qid GROUP BY n.qid""",
    ratio="lof_score",
)
def _(spark, sf):
    return anomaly.lof_score(_mart(spark, sf), VEC)


@query(
    "hbos_score",
    "SELECT user_id, sum(-log2(c / (n * w) + 0.1)) AS hbos_score FROM hb_bins b JOIN hb_count k ON b.f = k.f AND b.b = k.b GROUP BY user_id",
    ratio="hbos_score",
)
def _(spark, sf):
    return anomaly.hbos_score(_mart(spark, sf), VEC)


@query("iforest_score", ratio="if_score")
def _(spark, sf):
    return anomaly.iforest_score(_mart(spark, sf), VEC)


@query("anomaly_scores", ratio="if_score hbos_score lof_score")
def _(spark, sf):
    df = _mart(spark, sf)
    return anomaly.anomaly_scores(df, VEC, fit_on=split_side(df, "train")).select("user_id", "if_score", "hbos_score", "lof_score")


@query("smote")
def _(spark, sf):
    vecs, black = _vectors(spark, sf, False)
    near = neighbors.knn_join(_as("qid", black), _as("rid", black), 5, exclude_self=True)
    positives = black.count()
    negatives = vecs.count() - positives
    wanted = max(int(negatives * 0.12 / 0.88), positives + 1)
    made = neighbors.smote(_as("rid", black), cut_lineage(near), wanted - positives)
    return made.select("rid", "copy", *[F.col("vec")[i].alias(c) for i, c in enumerate(VEC)])


@query("smote_borderline")
def _(spark, sf):
    vecs, black = _vectors(spark, sf, False)
    labels = tables(spark, sf).users.select("user_id", "status")
    around = neighbors.knn_join(_as("qid", black), _as("rid", vecs), 5, exclude_self=True)
    edge = cut_lineage(neighbors.borderline(around, labels).join(_as("rid", vecs), "rid"))
    near = neighbors.knn_join(edge.select(F.col("rid").alias("qid"), "vec"), _as("rid", black), 5, exclude_self=True)
    positives = black.count()
    wanted = max(int(0.30 * (vecs.count() - positives)) - positives, 1)
    # neighbours may be any positive; new rows start from the border ones
    listed = cut_lineage(near)
    made = neighbors.smote(edge, listed, wanted, neighbor_vecs=_as("rid", black))
    return made.select("rid", "copy", *[F.col("vec")[i].alias(c) for i, c in enumerate(VEC)])


@query("blacklist_clusters", ratio="share mean_z")
def _(spark, sf):
    _, black = _vectors(spark, sf)
    _, assigned = blacklist.fit_clusters(black)
    return blacklist.cluster_profile(assigned, VEC)


@query("cluster_quality", ratio="silhouette davies_bouldin")
def _(spark, sf):
    _, black = _vectors(spark, sf)
    model, assigned = blacklist.fit_clusters(black)
    quality = blacklist.cluster_quality(model, assigned)
    return assigned.agg(F.count("*").alias("users")).withColumns({k: F.lit(v) for k, v in quality.items()})


@query("blacklist_similarity", ratio="svm_score iso_score mean_distance knn_similarity center_similarity combined_score")
def _(spark, sf):
    return blacklist.blacklist_similarity(*_vectors(spark, sf))


# ---- model pipeline ----


def _labelled(spark, sf):
    t = tables(spark, sf)
    cols = [F.col(c).cast("double").alias(c) for c in VEC]
    df = mart.feature_mart_lite(t, AS_OF).select("user_id", *cols).join(t.users.select("user_id", "status"), "user_id")
    return cut_lineage(df)


TRAIN_COLS = [c for c in VEC if c not in models.PROTECTED]


@query(
    "stratified_fold_sizes",
    """SELECT status, fold, (n // 5) + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS users
FROM (SELECT status, count(*) AS n FROM user_info GROUP BY status), (SELECT CAST(i AS INT) AS fold FROM range(5) t(i))""",
)
def _(spark, sf):
    users = tables(spark, sf).users.select("user_id", "status")
    return models.stratified_folds(users).groupBy("status", "fold").agg(F.count("*").alias("users"))


@query("stratified_folds")
def _(spark, sf):
    return models.stratified_folds(tables(spark, sf).users.select("user_id", "status"))


@query(
    "scale_features",
    "SELECT user_id, " + ", ".join(f"vec[{i + 1}] AS {c}" for i, c in enumerate(VEC)) + " FROM z_vec",
    ratio=" ".join(VEC),
)
def _(spark, sf):
    return models.scale_features(_mart(spark, sf), VEC).select("user_id", *[F.col("scaled")[i].alias(c) for i, c in enumerate(VEC)])


@query("scale_features_robust", ratio=" ".join(VEC))
def _(spark, sf):
    return models.scale_features(_mart(spark, sf), VEC, robust=True).select(
        "user_id", *[F.col("scaled")[i].alias(c) for i, c in enumerate(VEC)]
    )


@query(
    "zero_variance",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, stddev_samp({c}) AS std, CASE WHEN stddev_samp({c}) = 0 THEN 1 ELSE 0 END AS zero_variance FROM f_mart_lite"
        for c in VEC
    ),
    money="std",
)
def _(spark, sf):
    return models.column_deviation(_labelled(spark, sf), VEC)


_names = [*VEC, "status"]


def _correlation_sql() -> str:
    """Every pair in one pass; a constant column has no correlation."""
    pairs = ", ".join(
        f"{{'feature_a': '{a}', 'feature_b': '{b}', 'corr': CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END}}"
        for i, a in enumerate(_names)
        for b in _names[i + 1 :]
    )
    return f"SELECT unnest([{pairs}], recursive := true) FROM f_mart_lite JOIN (SELECT user_id, status FROM user_info) USING (user_id)"


@query("feature_correlation", _correlation_sql(), ratio="corr")
def _(spark, sf):
    return models.correlation_matrix(_labelled(spark, sf), _names)


@query("select_features", ratio="corr")
def _(spark, sf):
    df = _labelled(spark, sf)
    wide = df.withColumns({"twd_dep_mean_copy": F.col("twd_dep_mean") * 2 + F.col("age") * 1e-3, "always_one": F.lit(1.0)})
    return models.select_features(wide, [*VEC, "twd_dep_mean_copy", "always_one"], importance_rounds=models.ROUNDS)[1]


@query("fold_importance", ratio="importance")
def _(spark, sf):
    return models.fold_importance(split_side(_labelled(spark, sf), "train"), TRAIN_COLS)


@query("base_models", ratio="score")
def _(spark, sf):
    df = _labelled(spark, sf)
    return models.base_model_scores(split_side(df, "train"), split_side(df, "predict"), TRAIN_COLS)


@query("focal_second_pass", ratio="risk_score")
def _(spark, sf):
    df = _labelled(spark, sf)
    model = models.focal_second_pass(split_side(df, "train"), TRAIN_COLS)
    scored_rows = models.positive_probability(model.transform(models.assemble(df, TRAIN_COLS)), "risk_score")
    return scored_rows.select("user_id", "status", "risk_score")


@query("stacked_scores", ratio="boost_a boost_b boost_c risk_score")
def _(spark, sf):
    return models.fit_stack(split_side(_labelled(spark, sf), "train"), TRAIN_COLS)[1]


@query("submission", ratio="risk_score")
def _(spark, sf):
    df = _labelled(spark, sf)
    stack, oof = models.fit_stack(split_side(df, "train"), TRAIN_COLS)
    # the threshold comes from out-of-fold scores, never from the users being scored
    threshold = best_threshold(pr_curve(oof)).first()["threshold"]
    return models.submission(stack.score(split_side(df, "predict")), float(threshold))


@query("feature_importance", ratio="importance")
def _(spark, sf):
    train = cut_lineage(models.class_weight(models.assemble(split_side(_labelled(spark, sf), "train"), TRAIN_COLS)))
    rows = []
    for name, learner in models.learners(forest=True).items():
        rows += [(name, c, float(v)) for c, v in zip(TRAIN_COLS, learner.fit(train).featureImportances.toArray())]
    return models.mean_importance(spark.createDataFrame(rows, "model string, feature string, importance double"))


@query("calibrate", ratio="risk_score calibrated_score")
def _(spark, sf):
    return models.calibrate(scored(spark, sf))


@query("tune", ratio="step row_share column_share ridge min_hessian weight_factor alpha gamma f1")
def _(spark, sf):
    return search.tune_learners(split_side(_labelled(spark, sf), "train"), TRAIN_COLS)


@query("ablation", ratio="auc_roc auc_pr f1 precision recall fpr delta_auc_pr delta_f1")
def _(spark, sf):
    df = models.stratified_folds(_labelled(spark, sf))
    configs = {"user": TRAIN_COLS[:5], "user_fiat": TRAIN_COLS[:9], "all": TRAIN_COLS}
    return models.ablation(df.where("fold <> 0"), df.where("fold = 0"), configs)


# ---- boosting with the focal gradient, tree attributions, pseudo-labels ----

FOCAL = boosting.Params(depth=4, step=0.1, objective="focal", alpha=0.75, gamma=2.0)


def _focal_model(spark, sf):
    df = _labelled(spark, sf)
    return df, boosting.fit_models(split_side(df, "train"), TRAIN_COLS, [boosting.Model("risk_score", FOCAL)])


@query("focal_boosting", ratio="risk_score")
def _(spark, sf):
    df, fitted = _focal_model(spark, sf)
    return boosting.score(df, fitted, ["user_id", "status"])


@query("model_attributions", ratio="value shap")
def _(spark, sf):
    """Contributions of every feature to every user's margin under the focal model."""
    df, fitted = _focal_model(spark, sf)
    return tree_shap.tree_attributions(df, fitted["risk_score"])


@query("model_shap_summary", ratio="avg_abs_shap avg_shap")
def _(spark, sf):
    df, fitted = _focal_model(spark, sf)
    return explain.shap_summary(explain.shap_top10(tree_shap.tree_attributions(df, fitted["risk_score"])))


# fixed values: two small trees, so that SQL can state the attributions. A split is (column, at most, share of the weight on the left, left, right).
FIXED_COLS = ["twd_withdraw_ratio", "ip_night_ratio", "crypto_wit_count", "account_age_days"]
FIXED_TREES = [
    (0, 0.5, 0.7, (1, 0.3, 0.6, -0.8, 0.1), (2, 1.0, 0.25, 0.4, 1.1)),
    (0, 0.2, 0.4, -0.3, (0, 0.8, 0.5, 0.2, (3, 400.0, 0.35, 0.9, -0.2))),
]


def _fixed_tree(nested, cover=1000.0, tree=None):
    tree = boosting.Tree() if tree is None else tree
    node = tree.add(nested if isinstance(nested, float) else 0.0, cover)
    if not isinstance(nested, float):
        tree.feature[node], tree.value[node], share, left, right = nested
        tree.left[node] = len(tree.feature)
        _fixed_tree(left, cover * share, tree)
        tree.right[node] = len(tree.feature)
        _fixed_tree(right, cover * (1 - share), tree)
    return tree


def _fixed_model():
    return boosting.BoostedTrees(FIXED_COLS, -1.5, [_fixed_tree(t) for t in FIXED_TREES])


def _set_value(nested, known: frozenset) -> str:
    """SQL of a tree's mean leaf when only the columns in ``known`` decide."""
    if isinstance(nested, float):
        return f"({nested!r}::DOUBLE)"
    at, cut, share, left, right = nested
    a, b = _set_value(left, known), _set_value(right, known)
    if at in known:
        return f"CASE WHEN {FIXED_COLS[at]}::DOUBLE <= {cut!r} THEN {a} ELSE {b} END"
    return f"({share!r}::DOUBLE * {a} + (1 - {share!r}::DOUBLE) * {b})"


def _attribution_sql() -> str:
    """The Shapley formula over all subsets of the four columns."""
    subsets = [frozenset(i for i in range(4) if mask >> i & 1) for mask in range(16)]
    name = lambda s: "v" + "".join(str(int(i in s)) for i in range(4))
    values = ", ".join(" + ".join(_set_value(t, s) for t in FIXED_TREES) + f" AS {name(s)}" for s in subsets)
    weight = {0: 1 / 4, 1: 1 / 12, 2: 1 / 12, 3: 1 / 4}
    rows = []
    for i, c in enumerate(FIXED_COLS):
        terms = " + ".join(f"{weight[len(s)]!r}::DOUBLE * ({name(s | {i})} - {name(s)})" for s in subsets if i not in s)
        rows.append(f"SELECT user_id, '{c}' AS feature, {i}::INT AS fidx, {c}::DOUBLE AS value, {terms} AS shap FROM v")
    return f"WITH v AS (SELECT user_id, {', '.join(FIXED_COLS)}, {values} FROM (SELECT user_id, {', '.join(f'COALESCE({c}, 0) AS {c}' for c in FIXED_COLS)} FROM f_mart_lite)) " + " UNION ALL ".join(rows)


@query("tree_attributions", _attribution_sql(), ratio="value shap")
def _(spark, sf):
    return tree_shap.tree_attributions(_mart(spark, sf), _fixed_model())


@query("pseudo_label_rounds", ratio="f1_before f1_after")
def _(spark, sf):
    df = _labelled(spark, sf)
    return pseudo.pseudo_label_rounds(split_side(df, "train"), split_side(df, "predict").drop("status"), TRAIN_COLS)[1]


USER_FEATURES = VEC[:8]


@query("graph_embedding", ratio=" ".join(f"gnn_emb_{i}" for i in range(models.EMBEDDING_SIZE)))
def _(spark, sf):
    """One- and two-layer means of all user features; fitted on the training users, zero for users to predict."""
    users = profile.user_features_lite(tables(spark, sf).users, AS_OF).select("user_id", *[F.col(c).cast("double").alias(c) for c in USER_FEATURES])
    node = F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("node_id")
    wallets = _nodes(spark, sf).where("node_type = 'wallet'").select("node_id", *[F.lit(0.0).alias(c) for c in USER_FEATURES])
    nodes = users.select(node, *USER_FEATURES).unionByName(wallets)
    cols = [f"l{i}_{c}" for i in (1, 2) for c in USER_FEATURES]
    wide = cut_lineage(graph.neighbor_mean_features(_edges(spark, sf), nodes, list(USER_FEATURES)))
    train, predict = (split_side(users, side).select(node) for side in ("train", "predict"))
    out = models.graph_embedding(wide, cols, fit_on=wide.join(train, "node_id", "left_semi"))
    held = out.join(predict.withColumn("held_out", F.lit(True)), "node_id", "left")
    return held.select("node_id", *[F.when(F.col("held_out"), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in out.columns if c != "node_id"])
