"""The whole flow from tables to entities, graph and aggregates, and its benchmark."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.operators import graph, ingest, resolve
from daftar.runtime import cut
from daftar.sources import synthetic


@dataclass
class Result:
    """Tables of each stage; all of them lazy except what pair scoring had to write."""

    profiles: dict[str, DataFrame]
    records: DataFrame
    scored: DataFrame
    entities: DataFrame
    record_entities: DataFrame
    nodes: DataFrame
    edges: DataFrame
    associations: DataFrame
    aggregates: DataFrame
    stats: DataFrame
    quality: DataFrame | None = None
    timings_ms: dict[str, float] = field(default_factory=dict)


def run(tables: dict[str, DataFrame], overrides: dict | None = None, row_id: str = "source_row_id", timed: bool = False) -> Result:
    """Profile, canonicalize, resolve, build the graph and aggregate. With ``timed``, each stage is forced and timed."""
    clock, timings = time.perf_counter(), {}

    def stage(name: str, *frames: DataFrame) -> None:
        nonlocal clock
        if timed:
            for f in frames:
                f.write.format("noop").mode("overwrite").save()
            timings[name], clock = round((time.perf_counter() - clock) * 1000, 2), time.perf_counter()

    overrides = overrides or {}
    bare = {n: ingest.strip_labels(t) for n, t in tables.items()}
    profiles = {n: ingest.profile(t, n, None, overrides.get(n)) for n, t in bare.items()}
    records = ingest.canonical_records(bare, row_id, overrides)
    stage("ingestion", *profiles.values(), records)
    prints = cut(resolve.fingerprints(records))
    pairs = cut(resolve.candidate_pairs(prints))
    scored = cut(resolve.compare(prints, pairs))
    found = cut(resolve.entities(prints, resolve.clusters(prints, scored)))
    of = found.select("entity_id", F.explode("record_ids").alias("record_id"))
    stage("entity_resolution", of)
    owned = graph.owned(records, of)
    links, edges, nodes = graph.associations(owned), graph.edges(owned), graph.nodes(owned, found)
    stage("graph", links, edges, nodes)
    aggregates = graph.entity_aggregate(owned)
    stage("aggregation", aggregates)
    quality = None
    if tables and all("_truth_person_id" in t.columns for t in tables.values()):
        truth = None
        for n, t in tables.items():
            part = t.select(F.concat(F.lit(n + ":"), F.col(row_id).cast("string")).alias("record_id"), F.col("_truth_person_id").alias("truth"))
            truth = part if truth is None else truth.unionAll(part)
        quality = resolve.evaluate_pairwise(truth.join(of, "record_id").withColumnRenamed("entity_id", "entity"))
    return Result(profiles, records, scored, found, of, nodes, edges, links, aggregates, resolve.runtime_stats(prints, pairs), quality, timings)


def compact(result: Result, most: int = 100) -> dict[str, DataFrame]:
    """What a small answer shows: the first matches and the best possible ones, entities, counts."""
    return {"matches": resolve.first_matches(result.scored, most), "possible": resolve.top_possible(result.scored, most), "entities": result.entities, "stats": result.stats}


def benchmark(spark: SparkSession, citizens: int = 500, seed: int = 42) -> dict:
    """Stage times and records per second over made tables without their labels."""
    tables = {n: ingest.strip_labels(t) for n, t in synthetic.tables(spark, max(1, citizens), seed).items()}
    began = time.perf_counter()
    result = run(tables, timed=True)
    total = time.perf_counter() - began
    stats = result.stats.first().asDict()
    return {"citizens": citizens, **stats, "timings_ms": result.timings_ms, "records_per_s": round(stats["records"] / total, 2)}
