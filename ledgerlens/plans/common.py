"""Frames several query modules share, and their SQL blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import composite_risk
from ..operators import mart
from ..session import cut_lineage
from ..sources.fixtures import AS_OF, tables
from .oracle import add_blocks

SCORE_GRID = 1e9


def grid(col):
    return F.rint(col * SCORE_GRID) / SCORE_GRID


def scored(spark, sf) -> DataFrame:
    """(user_id, status, risk_score) with the score on a fine grid, so both engines group it alike."""
    return _scores(tables(spark, sf))


def scored_features(spark, sf) -> tuple[DataFrame, DataFrame]:
    """``scored`` and the lite mart, both from transfers that are joined and written once."""
    t = mart.by_user(tables(spark, sf))
    return _scores(t), cut_lineage(mart.feature_mart_lite(t, AS_OF, written=True))


def _scores(t) -> DataFrame:
    return mart.risk_scores(t, AS_OF).withColumn("risk_score", grid(F.col("risk_score")))


def scored_two(spark, sf) -> DataFrame:
    """Two composite scores and a third partial one per user."""
    t = tables(spark, sf)
    m = mart.feature_mart_lite(t, AS_OF).select(
        "user_id",
        grid(composite_risk()).alias("p_model"),
        grid(F.col("composite_risk_score")).alias("p_similar"),
        grid(F.col("ip_night_ratio")).alias("p_night"),
    )
    return m.join(t.users.select("user_id", "status"), "user_id")


def split_side(df: DataFrame, side: str) -> DataFrame:
    on = F.col("user_id") % 5
    return df.where(on != 0 if side == "train" else on == 0)


add_blocks(
    {
        "risk_grid": "SELECT user_id, status, round_even(risk_score * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS risk_score FROM risk_users",
        "risk_two": """
SELECT m.user_id, u.status, r.risk_score AS p_model,
  round_even(m.composite_risk_score * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS p_similar,
  round_even(m.ip_night_ratio * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS p_night
FROM f_mart_lite m JOIN risk_grid r ON m.user_id = r.user_id JOIN user_info u ON m.user_id = u.user_id""",
    }
)
