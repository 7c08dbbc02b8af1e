"""Entities of records that arrive: each micro-batch is blocked against the fingerprints seen so far.

State is two Parquet tables in a folder: fingerprints and scored pairs. A batch is written under its number,
so a repeated batch overwrites itself and nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.operators import resolve


def _read(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("basePath", folder).parquet(folder).filter(F.col("batch") < before).drop("batch")


def absorb(batch: DataFrame, number: int, folder: str) -> None:
    """Add a batch of canonical records: its pairs among themselves and with all earlier ones. For ``foreachBatch``."""
    spark = batch.sparkSession
    prints = resolve.fingerprints(batch)
    new = f"{folder}/prints/batch={number}"
    prints.write.mode("overwrite").parquet(new)
    prints = spark.read.parquet(new)
    earlier = _read(spark, f"{folder}/prints", number)
    every = prints if earlier is None else earlier.select(*prints.columns).unionAll(prints)
    keys = resolve.blocking_keys(resolve.T.name_tokens(F.col("norm_name")))
    mine = prints.select(F.col("record_id").alias("a"), F.explode(keys).alias("key"))
    all_keys = every.select(F.col("record_id").alias("b"), F.explode(keys).alias("key"))
    pairs = mine.join(all_keys, "key").filter("a <> b").select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).distinct()
    resolve.compare(every, pairs).write.mode("overwrite").parquet(f"{folder}/pairs/batch={number}")


def follow(stream: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Start absorbing a stream of canonical records."""
    writer = stream.writeStream.foreachBatch(lambda df, n: absorb(df, n, folder)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def entities_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of everything absorbed."""
    prints, pairs = _read(spark, f"{folder}/prints", 2**62), _read(spark, f"{folder}/pairs", 2**62)
    return resolve.entities(prints, resolve.clusters(prints, pairs))
