"""Exact interpolated percentiles per key that survive a key holding most rows.

One plan for every size: duplicates collapse to (key, value, weight), global split points cut
the values into ranges, and a key's wanted places are looked up first among its range totals
(at most ``RANGES`` rows a key) and then inside the few ranges that hold them. A key with most of the rows
is therefore spread over all ranges, and no task sorts more than a range of it.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

RANGES = 256


def exact_percentiles(df: DataFrame, key: str, value: str, weight: str, ps: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """One row per key with a double per entry of ``ps`` (name -> fraction).

    ``value`` is a bigint, ``weight`` its number of occurrences.
    """
    distinct = cut_lineage(df.groupBy(F.col(key).alias("_k"), F.col(value).cast("double").alias("_d"), F.col(value).alias("_v")).agg(F.sum(weight).cast("long").alias("_w")))
    probes = [i / ranges for i in range(1, ranges)]
    inner = sorted(set(distinct.approxQuantile("_d", probes, 1 / (4 * ranges)))) if probes else []
    splits = [float("-inf"), *(inner or [0.0]), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_d", outputCol="_range").transform(distinct)
    per_key = Window.partitionBy("_k")
    so_far = per_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_k", "_range").agg(F.sum("_w").alias("_in")).select(
        "_k", "_range", "_in", F.coalesce(F.sum("_in").over(so_far), F.lit(0)).alias("_before"), F.sum("_in").over(per_key).alias("_total")
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in ps.items()]))
    position = F.col("q.p") * (F.col("_total") - 1)
    low = F.floor(position).cast("long")
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("at")), F.struct(F.lit(1).alias("side"), F.least(low + 1, F.col("_total") - 1).alias("at"))))
    targets = totals.select("*", wanted.alias("q")).select("_k", "_range", "_in", "_before", F.col("q.name").alias("name"), (position - low).alias("share"), both.alias("t"))
    targets = targets.where((F.col("t.at") >= F.col("_before")) & (F.col("t.at") < F.col("_before") + F.col("_in")))
    targets = cut_lineage(targets.select("_k", "_range", "name", "share", F.col("t.side").alias("side"), (F.col("t.at") - F.col("_before")).alias("at")))
    needed = targets.select("_k", "_range").distinct()
    inside = Window.partitionBy("_k", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(needed, ["_k", "_range"], "left_semi").withColumn("_upto", F.sum("_w").over(inside))
    hits = ranked.join(targets, ["_k", "_range"]).where((F.col("at") < F.col("_upto")) & (F.col("at") >= F.col("_upto") - F.col("_w")))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("_v"))).cast("double")
    picked = hits.groupBy("_k", "name").agg((side(0) + (side(1) - side(0)) * F.max("share")).alias("_p"))
    return picked.groupBy(F.col("_k").alias(key)).agg(*[F.max(F.when(F.col("name") == n, F.col("_p"))).alias(n) for n in ps])
