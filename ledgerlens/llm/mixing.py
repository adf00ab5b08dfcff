"""Mixing risk reports to target weights by hierarchical token budgets.

Text records of this project are the per-user risk reports. The tree's default levels are three
of their fields: ``data_source`` (train or predict), ``risk_level`` and ``career``; any columns may
stand there, such as domain, language and source. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import cut_lineage, join_small, packed, unpacked

LEVELS = ("data_source", "risk_level", "career")
BIN_BITS = 12


def token_count(report: Column) -> Column:
    """Words split at white space; 0 for null."""
    return F.coalesce(F.regexp_count(report, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _share_out(nodes: DataFrame, parent: str) -> DataFrame:
    """Split each parent's ``budget`` among its children by ``weight``, none above its ``capacity``; adds ``given``.

    What a full child cannot take goes to its siblings by their weights. In the order of
    capacity / weight, the children before the first that its share does not fill are full, and
    that child's share per weight holds for it and all after it. One row per tree node.
    """
    ratio = F.col("capacity") / F.col("weight")
    whole = Window.partitionBy(parent)
    before = whole.orderBy(ratio, "node").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    df = nodes.withColumns({"ratio": ratio, "rate": (F.col("budget") - taken) / weight_left})
    is_open = F.col("ratio") > F.col("rate")
    rate = F.min(F.when(is_open, F.struct("ratio", "node", "rate"))).over(whole)["rate"]
    given = F.when(is_open, F.greatest(F.lit(0.0), F.col("weight") * rate)).otherwise(F.col("capacity"))
    return df.withColumn("given", F.least(given, F.col("capacity")))


def leaf_budgets(leaves: DataFrame, weights: DataFrame, depth: int, budget: int, epochs: int) -> DataFrame:
    """(leaf, tokens, given): the token budget of every leaf that gets one.

    ``leaves``: ``leaf`` (array of ``depth`` level values) and ``tokens``; ``weights``: ``path`` (array of level
    values from the root) and ``weight``. A node without a row has weight 1; a negative or null weight is 0,
    and nothing below a node of weight 0 is used. Of several rows for one path the largest weight counts.
    A leaf holds its tokens times ``epochs``, an inner node what its leaves hold. From the root down each
    budget goes to the children, so a shortage is made up by siblings first; what they cannot hold was
    already given to the siblings of the nearest ancestor with room.
    """
    known = weights.groupBy("path").agg(F.greatest(F.max("weight").cast("double"), F.lit(0.0)).alias("weight"))
    df = leaves.select("leaf", "tokens", (F.col("tokens") * epochs).cast("double").alias("held"))
    for k in range(1, depth + 1):
        named = known.select(F.col("path").alias(f"p{k}"), F.col("weight").alias(f"known{k}"), F.lit(True).alias(f"has{k}"))
        df = df.withColumn(f"p{k}", F.slice("leaf", 1, k)).join(named, f"p{k}", "left")
        df = df.withColumn(f"w{k}", F.when(F.col(f"has{k}"), F.coalesce(f"known{k}", F.lit(0.0))).otherwise(F.lit(1.0)))
    df = df.where(" AND ".join(["tokens > 0", *[f"w{k} > 0" for k in range(1, depth + 1)]]))
    df = cut_lineage(df.withColumn("p0", F.slice("leaf", 1, 0)))
    current = None
    for k in range(1, depth + 1):
        nodes = df.groupBy(f"p{k - 1}", F.col(f"p{k}").alias("node")).agg(F.sum("held").alias("capacity"), F.max(f"w{k}").alias("weight"))
        nodes = nodes.withColumn("budget", F.lit(float(budget))) if current is None else nodes.join(current, f"p{k - 1}")
        current = _share_out(nodes, f"p{k - 1}").select(F.col("node").alias(f"p{k}"), F.col("given").alias("budget"))
    return df.select("leaf", "tokens").join(current.withColumnRenamed(f"p{depth}", "leaf"), "leaf").select(
        "leaf", "tokens", F.floor(F.col("budget") + 1e-6).cast("bigint").alias("given")
    )


def _boundary(sums: DataFrame, name: str) -> DataFrame:
    """Per leaf the bin in which its rest of tokens ends, and the tokens before that bin; at most 2**BIN_BITS rows a leaf."""
    order = Window.partitionBy("leaf").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    hit = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest"))
    return placed.where(hit).select("leaf", F.col("bin").alias(name), F.col("before").alias(f"{name}_before"))


def mix_to_weights(
    reports: DataFrame,
    weights: DataFrame,
    budget: int,
    levels: tuple[str, ...] = LEVELS,
    id_col: str = "user_id",
    report: str = "report",
    epochs: int = 4,
    seed: int = 1,
) -> DataFrame:
    """The reports that the mixture takes: all columns plus copies, part_tokens and taken_tokens.

    A leaf's reports are repeated in epochs, each in an order drawn from ``seed`` and the epoch; the leaf takes the
    prefix of that sequence that holds its budget. ``copies`` counts the epochs that take the whole report;
    ``part_tokens`` is how many of its first tokens the last, unfinished epoch takes (the whole report, or less for
    the one in which the budget ends); ``taken_tokens`` is the sum. No leaf takes more than ``epochs`` epochs.

    No order is sorted as a whole: sums over 4,096 hash bins of a leaf, and again inside the bin in which
    the budget ends, leave about one in 16 million of its reports to be sorted.

    Defined results: a null level value is the value '' of that level; a report without tokens (null, empty) is never taken;
    equal places in the order are taken by id, then by the row's hash, so repeated rows are taken one by one;
    an empty table gives no rows; added columns replace columns of the same name.
    """
    level = lambda c: F.coalesce(F.col("row").getField(c).cast("string"), F.lit(""))
    # the id's text, and the number of the epoch, drawn as 60 bits
    draw = lambda epoch: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch, F.col("id").cast("string"))), 1, 15), 16, 10).cast("bigint")
    df = packed(reports, id=id_col, report=report).select("row", "id", token_count(F.col("report")).alias("tokens"))
    df = df.withColumn("leaf", F.array(*[level(c) for c in levels])).where("tokens > 0")
    facts = cut_lineage(df.select("leaf", "id", "tokens"))
    leaves = facts.groupBy("leaf").agg(F.sum("tokens").alias("tokens"))
    shares = leaf_budgets(leaves, weights, len(levels), budget, epochs).where("given > 0")
    shares = cut_lineage(
        shares.select(
            "leaf", F.expr("given div tokens").alias("full"), (F.col("given") % F.col("tokens")).alias("rest"), F.lit(0).cast("bigint").alias("start")
        )
    )
    spread = F.xxhash64("id")
    high, low = 60 - BIN_BITS, 60 - 2 * BIN_BITS
    placed = join_small(facts, shares, "leaf", spread).withColumn("place", draw(F.col("full").cast("string")))
    by_bin = ["leaf", "rest", "start"]
    first = placed.where("rest > 0").groupBy(*by_bin, F.shiftright("place", high).alias("bin")).agg(F.sum("tokens").alias("tokens"))
    first = cut_lineage(_boundary(first, "b1"))
    inside = join_small(placed.where("rest > 0"), first, "leaf", spread).where(F.shiftright("place", high) == F.col("b1"))
    second = inside.groupBy("leaf", "rest", F.col("b1_before").alias("start"), F.shiftright("place", low).alias("bin")).agg(F.sum("tokens").alias("tokens"))
    second = cut_lineage(_boundary(second, "b2"))
    plan = cut_lineage(shares.drop("start").join(second, "leaf", "left"))
    taken = join_small(df, plan, "leaf", spread).withColumn("place", draw(F.col("full").cast("string")))
    taken = taken.withColumn("side", F.coalesce(F.shiftright("place", low) - F.col("b2"), F.lit(1)))
    clear = taken.where("side <> 0").withColumn("part", F.when(F.col("side") < 0, F.col("tokens")).otherwise(F.lit(0)))
    order = Window.partitionBy("leaf").orderBy("place", "id", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("b2_before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))
    close = taken.where("side = 0").withColumn("part", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - before)))
    both = clear.unionByName(close).where("full > 0 OR part > 0")
    return unpacked(
        both,
        copies=F.col("full") + (F.col("part") == F.col("tokens")).cast("bigint"),
        part_tokens=F.when(F.col("part") < F.col("tokens"), F.col("part")).otherwise(F.lit(0)).cast("bigint"),
        taken_tokens=F.col("full") * F.col("tokens") + F.col("part"),
    )
