"""Consolidating pairwise matches into groups.

The component of the vertex of highest degree (the giant one, if there is a giant one) is peeled by
breadth-first frontier joins and removed by anti-join; the small rest gets its labels by minimum
propagation (with shortcuts, so chains cost logarithmic rounds). If the first component is long rather
than wide, the search stops after ``hops`` frontiers, what it visited is contracted into one vertex, and
the rest of the component is found by propagation: the result is the same.

Defined results: pairs with a null end, loops, repeated pairs and either order change nothing; a null
confidence doesn't matter; records without links are their own group; no records, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.operators.components import stars, undirected
from daftar.runtime import cut


def peel(edges: DataFrame, hops: int = 12) -> tuple[DataFrame, str] | None:
    """(visited vertices ``n``, smallest of them) around the vertex of highest degree; None without edges."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("to")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("to")))
    top = both.groupBy("n").count().orderBy(F.desc("count"), "n").select("n").head()
    if top is None:
        return None
    visited = frontier = both.sparkSession.createDataFrame([(top[0],)], edges.select(F.col("u").alias("n")).schema)
    for _ in range(hops):
        reached = frontier.join(both, "n").select(F.col("to").alias("n")).distinct()
        frontier = cut(reached.join(visited, "n", "left_anti"))
        if frontier.isEmpty():
            break
        visited = cut(visited.unionAll(frontier))
    return visited, visited.agg(F.min("n")).first()[0]


def group_records(records: DataFrame, pairs: DataFrame, node: str = "record_id", left: str = "left_record_id", right: str = "right_record_id", hops: int = 12) -> DataFrame:
    """``group_id`` and ``node`` of each row of ``records``; ``group_id`` is the smallest id linked to it."""
    edges = cut(undirected(pairs, left, right))
    peeled = peel(edges, hops)
    if peeled is None:
        return records.select(F.col(node).alias("group_id"), node)
    visited, least = peeled
    # Both ends of an edge are looked up in the visited set; edges inside it are gone, edges that leave it start at its smallest vertex.
    marks = visited.select("n", F.lit(True).alias("seen"))
    inside = edges.join(marks.select(F.col("n").alias("u"), F.col("seen").alias("su")), "u", "left").join(marks.select(F.col("n").alias("v"), F.col("seen").alias("sv")), "v", "left")
    rest = inside.filter("su is null or sv is null").select(F.when(F.col("su"), F.lit(least)).otherwise(F.col("u")).alias("u"), F.when(F.col("sv"), F.lit(least)).otherwise(F.col("v")).alias("v"))
    labels = stars(undirected(rest, "u", "v"))
    of_least = labels.filter(F.col("u") == least).select("v").head()
    giant = visited.select(F.col("n").alias("u"), F.lit(of_least[0] if of_least else least).alias("v"))
    known = giant.unionAll(labels.filter(F.col("u") != least))
    return records.join(known, records[node] == known["u"], "left").select(F.coalesce("v", records[node]).alias("group_id"), records[node])
