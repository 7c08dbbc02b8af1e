"""Tables from uploaded files and requests, and results as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, row_id: str = "source_row_id") -> DataFrame:
    """A CSV file with header: doubled quotes, line breaks in quotes, cells trimmed, missing cells empty, lines
    without any content dropped, rows numbered from 1 as text unless the file brings its own numbers.

    A file is one ordered task, so numbers follow its lines."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, enforceSchema=False)
    cells = raw.select(*[F.coalesce(F.regexp_replace(F.col(f"`{c}`"), r"(?U)^\s+|\s+$", ""), F.lit("")).alias(c.strip()) for c in raw.columns])
    kept = cells.filter(reduce(lambda a, b: a | b, [F.col(f"`{c}`") != "" for c in cells.columns]))
    if row_id in kept.columns:
        return kept
    # One partition per file: its ids are consecutive in file order.
    return kept.withColumn("_m", F.monotonically_increasing_id()).withColumn(row_id, (F.col("_m") + 1).cast("string")).drop("_m")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows as JSON lines, every value as text."""
    rows = spark.read.option("primitivesAsString", True).json(path)
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])


def from_request(spark: SparkSession, body: dict) -> tuple[dict[str, DataFrame], dict]:
    """(tables, mappings) of a request ``{"datasets": {name: [row]}, "mappings": {...}}``; ValueError for other shapes.

    Rows of a request are in the driver's memory already; larger data come as files."""
    datasets, mappings = body.get("datasets") if isinstance(body, dict) else None, body.get("mappings", {}) if isinstance(body, dict) else {}
    if not isinstance(datasets, dict) or not isinstance(mappings, dict):
        raise ValueError("datasets and mappings must be objects")
    tables = {}
    for name, rows in datasets.items():
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise ValueError(f"dataset {name} must be a list of objects")
        columns = list(dict.fromkeys(c for r in rows for c in r)) or ["source_row_id"]
        values = [tuple(None if r.get(c, "") is None else str(r.get(c, "")) for c in columns) for r in rows]
        schema = ", ".join(f"`{c}` string" for c in columns)
        df = spark.createDataFrame(values, schema)
        if "source_row_id" not in columns:
            numbers = [(*v, str(r.get("id") or i)) for i, (v, r) in enumerate(zip(values, rows), 1)]
            df = spark.createDataFrame(numbers, schema + ", source_row_id string")
        tables[name] = df
    return tables, mappings


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def write_report(df: DataFrame, path: str, at: str) -> None:
    """Rows as JSON lines with the given time of the report."""
    df.withColumn("generated_at", F.lit(at)).write.mode("overwrite").json(path)
