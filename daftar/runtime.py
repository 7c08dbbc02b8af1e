"""Session helpers shared by all operators: where lineage is cut, how tables are read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be shipped to every executor on purpose; larger sides are always shuffled.
BROADCAST_LIMIT = 32 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (a file or a directory of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; only where it is unset (tests) make a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"daftar-checkpoints-{os.getuid()}")
    context.setCheckpointDir(folder)


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from there: the lineage is cut, losing
    an executor loses nothing, columns are stored compressed and their sizes are known to the planner.

    ``instead_of``: an earlier result of this function that nothing needs any more; its files are removed.
    The folder of one run is removed when its session ends; a cluster's cleaning of the folder is its own."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._cut_folder = folder
    if instead_of is not None and hasattr(instead_of, "_cut_folder"):
        path = spark._jvm.org.apache.hadoop.fs.Path(instead_of._cut_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def small(df: DataFrame) -> DataFrame:
    """A result of ``cut`` marked for shipping to every executor if its files have at most half of ``BROADCAST_LIMIT``
    bytes (they are compressed), as it is otherwise. Sizes are read, not estimated."""
    folder = getattr(df, "_cut_folder", None)
    if folder is None:
        raise ValueError("only a table that was cut has a known size")
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(df) if held <= BROADCAST_LIMIT // 2 else df


def to_roots(parents: DataFrame, word: str, parent: str) -> DataFrame:
    """``parents`` (word, parent) without cycles, each parent replaced by the last one that its chain leads to."""
    parents = cut(parents)
    while True:
        up = parents.select(F.col(word).alias(parent), F.col(parent).alias("_next"))
        joined = parents.join(up, parent, "left").select(word, F.coalesce("_next", parent).alias(parent), F.col("_next").isNotNull().alias("_moved"))
        moved = cut(joined, instead_of=parents)
        parents = moved.drop("_moved")
        parents._cut_folder = moved._cut_folder
        if moved.filter("_moved").isEmpty():
            return parents


def width(spark: SparkSession) -> int:
    """Partitions for work that is heavy for its bytes (texts in Python), which adaptive execution would
    otherwise gather into a few tasks."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def distinct_wide(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column, spread for heavy work; one shuffle."""
    return df.select(column).filter(F.col(column).isNotNull()).repartition(width(df.sparkSession), column).distinct()


def spread(df: DataFrame) -> DataFrame:
    """The scan as it is where it fills the cores; a small file in one block is dealt out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
