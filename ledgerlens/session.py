"""Session settings the jobs rely on, and the checkpoint folder of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "ledgerlens") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # small local files: let every core get a part of one
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> None:
    """All timestamps are zone-less wall times; UTC keeps day and hour parts stable."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/ledgerlens-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so a lost executor costs no recomputation.

    A columnar table rather than an RDD checkpoint: it is compressed, later steps read
    only the columns they need, and its true size is known to the planner.
    """
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by_user(df: DataFrame, key: str = "user_id") -> DataFrame:
    """As ``cut_lineage``, with the rows of a user side by side, so that later aggregates per user combine before they are shuffled.

    Adaptive execution splits a user that is too large for one file over several. Instants are stored as whole microseconds.
    """
    stamps = [f.name for f in df.schema if f.dataType.typeName() == "timestamp"]
    packed = df.withColumns({c: F.unix_micros(c) for c in stamps}) if stamps else df
    written = cut_lineage(packed.hint("rebalance", F.col(key)))
    return written.withColumns({c: F.timestamp_micros(c) for c in stamps}) if stamps else written


# rows of a user that may meet in one array
WHOLE_USER = 20_000


def split_busy(df: DataFrame, limit: int = WHOLE_USER, key: str = "user_id") -> tuple[DataFrame, DataFrame | None]:
    """Rows of the users with at most ``limit`` rows, and those of all other users (None if there are none)."""
    busy = cut_lineage(df.groupBy(F.col(key).alias("_busy")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit).select("_busy"))
    if busy.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_busy"))
    return df.join(busy, same, "left_anti"), df.join(busy, same, "left_semi")


def drop_written(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut_lineage`` returned; nothing may read it any more."""
    spark = df.sparkSession
    root = spark.sparkContext.getCheckpointDir()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root and folder.rpartition("/")[2].startswith("ledgerlens-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
