"""Connected components of a graph given as pairs, by alternating large-star and small-star rounds.

Every round lets each vertex learn the smallest neighbour and rewires its edges to it, so long chains
shrink by a constant factor per round instead of one hop. A round is two shuffles over edges; edges of
hubs are combined by partial aggregation before they move, and adaptive execution splits the join side
of a hub. State is written to the checkpoint folder after each round.

Where a column is known by which most edges of a component can be kept together (``gathered``), each partition
connects its own first, and the rounds run over what partitions have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.runtime import cut, small, width


def undirected(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct edges (u, v) with u > v; null ends and loops are dropped."""
    a, b = F.col(left), F.col(right)
    return pairs.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every vertex has one edge, to a vertex that has none: then nothing can change any more."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v): v is the smallest vertex of u's component, for every u that isn't itself the smallest.

    ``edges`` as ``undirected`` gives them. Raises if it isn't stable after ``rounds``."""
    edges = cut(edges)
    for _ in range(rounds):
        if _stars_only(edges):
            return edges
        edges = cut(_small_star(_large_star(edges)), instead_of=edges)
    raise RuntimeError(f"components aren't stable after {rounds} rounds")


#: Edges of a partition that are connected at once; more go in pieces.
PIECE = 1 << 21


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges (a, b) and the smallest vertex that each is connected with: roots are hooked to smaller
    ones and paths shortened until nothing changes."""
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(vertices))
    one, two = at[: len(a)], at[len(a) :]
    while len(one):
        x, y = root[one], root[two]
        open_ = x != y
        one, two, x, y = one[open_], two[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return vertices, vertices[root]


def gathered(pairs: DataFrame, left: str, right: str, by: str) -> DataFrame:
    """(u, v) as ``stars(undirected(pairs))`` gives them, for 64-bit ids; ``by``: a column by which pairs of a component
    mostly agree. It decides how much is left to the rounds, not what is connected."""

    def connect(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in parts:
            held.append([c.to_numpy() for c in part.columns])
            n += part.num_rows
            if n >= PIECE:
                yield piece(held)
                held, n = [], 0
        if n:
            yield piece(held)

    def piece(held: list) -> pa.RecordBatch:
        u, v = connected(*[np.concatenate(c) for c in zip(*held)])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    a, b = F.col(left), F.col(right)
    edges = pairs.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("a"), b.alias("b"), by)
    own = cut(edges.repartition(width(pairs.sparkSession), by).select("a", "b").mapInArrow(connect, "u long, v long"))
    met = cut(own.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("last")))
    # A vertex of several partitions ties the smallest of each.
    shared = cut(met.filter("v < last").select("u", F.col("v").alias("least")))
    ties = own.join(small(shared), "u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    labels = stars(undirected(ties, "a", "b"))
    out = met.select("u", "v").join(small(labels).select(F.col("u").alias("v"), F.col("v").alias("label")), "v", "left")
    return cut(out.select("u", F.coalesce("label", "v").alias("v")).filter("u <> v"))


def components(nodes: DataFrame, pairs: DataFrame, node: str, left: str, right: str) -> DataFrame:
    """``node`` and ``component`` (the smallest id linked to it, itself if there is none) of each row of
    ``nodes``; rows that repeat stay repeated. Ends of pairs that are no node still connect."""
    labels = stars(undirected(pairs, left, right))
    return nodes.join(labels, nodes[node] == labels["u"], "left").select(nodes[node], F.coalesce("v", nodes[node]).alias("component"))
