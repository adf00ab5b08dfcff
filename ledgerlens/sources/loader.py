"""Typed readers, checks, splits and sinks for the exchange tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_utc

# Column types per table; the first tuple names the required columns.
TABLE_SPECS: dict[str, dict] = {
    "user_info": {
        "required": ("user_id", "status"),
        "timestamp": ("confirmed_at", "level1_finished_at", "level2_finished_at", "birthday"),
        "bigint": ("user_id",),
        "int": ("status", "sex", "age", "career", "income_source", "user_source"),
    },
    "twd_transfer": {
        "required": ("user_id", "kind", "ori_samount"),
        "timestamp": ("created_at",),
        "bigint": ("user_id", "ori_samount"),
        "int": ("kind",),
        "string": ("source_ip_hash",),
    },
    "crypto_transfer": {
        "required": ("user_id", "kind", "sub_kind", "ori_samount", "twd_srate"),
        "timestamp": ("created_at",),
        "bigint": ("user_id", "ori_samount", "twd_srate", "relation_user_id"),
        "int": ("kind", "sub_kind", "protocol"),
        "string": ("from_wallet", "to_wallet", "currency", "source_ip_hash"),
    },
    "usdt_twd_trading": {
        "required": ("user_id", "is_buy", "trade_samount", "twd_srate"),
        "timestamp": ("updated_at",),
        "bigint": ("user_id", "trade_samount", "twd_srate"),
        "int": ("is_buy", "is_market", "source"),
        "string": ("source_ip_hash",),
    },
    "usdt_swap": {
        "required": ("user_id", "kind", "twd_samount", "currency_samount"),
        "timestamp": ("created_at",),
        "bigint": ("user_id", "twd_samount", "currency_samount"),
        "int": ("kind",),
    },
    "train_label": {"required": ("user_id", "status"), "bigint": ("user_id",), "int": ("status",)},
    "predict_label": {"required": ("user_id",), "bigint": ("user_id",)},
}
# Other spellings of columns.
ALIASES = {"source_ip": "source_ip_hash", "from_wallet_hash": "from_wallet", "to_wallet_hash": "to_wallet"}
# Fixed value: the tables a full load needs.
BASE_TABLES = ("user_info", "twd_transfer", "crypto_transfer", "usdt_twd_trading", "usdt_swap")


class MissingTable(FileNotFoundError):
    pass


class MissingColumns(ValueError):
    pass


def coerce(col: Column, target: str) -> Column:
    """Convert text to the target type; anything unreadable becomes null."""
    text = F.trim(col.cast("string"))
    if target == "timestamp":
        return text.try_cast("timestamp")
    if target in ("bigint", "int"):
        # integers may arrive written as floats ("12.0")
        return text.try_cast("decimal(38,4)").try_cast(target)
    return F.when(~F.lower(text).isin("nan", ""), text)


def coerce_types(df: DataFrame, table: str) -> DataFrame:
    """Canonical column names and types; columns outside the table's spec pass through."""
    spec = TABLE_SPECS[table]
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = [c for c in spec["required"] if c not in df.columns]
    if missing:
        raise MissingColumns(f"{table}: missing {', '.join(missing)}")
    target = {c: t for t, cols in spec.items() if t != "required" for c in cols}
    # a column that has its type already stays as it is, so that filters still reach the scan
    ready = {c for c, t in df.dtypes if c in target and t == target[c] != "string"}
    return df.select(*[coerce(F.col(c), target[c]).alias(c) if c in target and c not in ready else F.col(c) for c in df.columns])


def _exists(spark: SparkSession, path: str) -> bool:
    """Probe by opening the path; works on any file system Spark reads."""
    try:
        spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).schema
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def read_table(spark: SparkSession, base: str, table: str, optional: bool = False, multi_line: bool = False) -> DataFrame | None:
    """First of <table>.parquet, <table>.csv, <table>_train.csv below ``base``.

    CSV is read as text with quoted fields, doubled quotes and surrounding blanks, then coerced. Line
    feeds inside quotes need ``multi_line``, which reads each file in one task; without it files are split.
    """
    use_utc(spark)
    for name in (f"{table}.parquet", f"{table}.csv", f"{table}_train.csv"):
        path = f"{base}/{name}"
        if not _exists(spark, path):
            continue
        if name.endswith(".parquet"):
            return coerce_types(spark.read.parquet(path), table)
        rows = (
            spark.read.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multi_line)
            .option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True)
            .csv(path)
        )
        return coerce_types(rows, table)
    if optional:
        return None
    raise MissingTable(f"no {table} below {base}")


def load_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, base, t) for t in BASE_TABLES}


def load_predict(spark: SparkSession, base: str) -> dict[str, DataFrame] | None:
    """The predict side, or None when any of its tables is absent."""
    out = {t: read_table(spark, base, t, optional=True) for t in BASE_TABLES}
    return None if any(df is None for df in out.values()) else out


def null_report(df: DataFrame) -> DataFrame:
    """(column, nulls, share) from one aggregate over the whole table."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("nulls")) for i, c in enumerate(df.columns)])
    return one.select("n", F.inline(rows)).select(
        "column_name", "nulls", F.coalesce(F.try_divide(F.col("nulls"), F.col("n")), F.lit(0.0)).alias("null_share")
    )


def label_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("users"))


def require_positives(df: DataFrame) -> None:
    if df.where("status = 1").isEmpty():
        raise ValueError("no user with status 1")


def split_by_label(df: DataFrame, train: DataFrame, predict: DataFrame) -> DataFrame:
    """Rows of labelled users with the split they belong to; write with partitionBy('split')."""
    def side(labels: DataFrame, name: str) -> DataFrame:
        return df.join(labels.select("user_id"), "user_id", "left_semi").withColumn("split", F.lit(name))

    return side(train, "train").unionByName(side(predict, "predict"))


def attach_label(users: DataFrame, train: DataFrame) -> DataFrame:
    base = users.drop("status") if "status" in users.columns else users
    return base.join(train.select("user_id", "status"), "user_id", "left")


def split_audit(rows: DataFrame, train: DataFrame, predict: DataFrame) -> DataFrame:
    """Counts of ids in both splits, of labels without rows, and of rows without labels."""
    ids = {"rows": rows, "train": train, "predict": predict}
    tagged = [d.select("user_id").distinct().withColumn("who", F.lit(n)) for n, d in ids.items()]
    # one pass over the distinct ids answers every overlap and difference
    seen = reduce(DataFrame.unionByName, tagged).groupBy("user_id").agg(F.collect_set("who").alias("in_"))
    has = lambda n: F.array_contains("in_", n)
    return seen.agg(
        F.count_if(has("train") & has("predict")).alias("in_both"),
        F.count_if(has("train") & ~has("rows")).alias("train_without_rows"),
        F.count_if(has("predict") & ~has("rows")).alias("predict_without_rows"),
        F.count_if(has("rows") & ~has("train") & ~has("predict")).alias("rows_without_label"),
    )


def first_per_user(parts: list[DataFrame]) -> DataFrame:
    """Union of frames; a user keeps the row of the earliest part that has it."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in all_rows.columns if c not in ("user_id", "_part")]
    # an aggregate, not a window: combined map-side, one row per user is shuffled
    best = F.min_by(F.struct(*rest), F.struct("_part", *rest)).alias("r")
    return all_rows.groupBy("user_id").agg(best).select("user_id", "r.*")


def all_scores(train: DataFrame, predict: DataFrame) -> DataFrame:
    """Scores of both splits with their origin; the predict side has no label."""
    return train.withColumn("data_source", F.lit("train")).unionByName(
        predict.withColumn("data_source", F.lit("predict")), allowMissingColumns=True
    )


def write_outputs(frames: dict[str, DataFrame], base: str, fmt: str = "parquet", partition_by: dict | None = None) -> None:
    """Write each frame below ``base``; fmt is parquet, csv, json or (one string column) text."""
    for name, df in frames.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("quote", '"').option("escape", '"')
        cols = (partition_by or {}).get(name)
        if cols:
            writer = writer.partitionBy(*cols)
        writer.save(f"{base}/{name}")
