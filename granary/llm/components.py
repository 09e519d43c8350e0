"""Connected components over an edge table: stars within each task first, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: Edges that a task joins to stars at once, which bounds its memory.
EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest node of each component of the edges given, for every other node of it."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        # Each node takes the smallest number that a neighbour has, then that of the node it points to.
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        np.minimum.at(new, low[x], new[y])
        np.minimum.at(new, low[y], new[x])
        new = new[new]
        if (new == low).all():
            break
        low = new
    away = low != np.arange(len(nodes))
    return nodes[away], nodes[low[away]]


def _stars_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= EDGES:
            held = [stars(*(np.concatenate(c) for c in zip(*held)))]
            if len(held[0][0]) > EDGES // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], ["a", "b"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in stars(*(np.concatenate(c) for c in zip(*held)))], ["a", "b"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b) that is linked to another, root being the smallest node reachable.

    Each round is two aggregations and two joins on the edge table; the number of rounds grows with the logarithm of the longest
    path, which the stars made within the tasks keep short.  Every round is written to the shared folder, so a lost executor costs one round at most; the
    tables of the round before are deleted then.
    """
    given = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b")
    now = materialize(given.mapInArrow(_stars_of_task, "a bigint, b bigint").distinct(), "edges")
    for _ in range(max_rounds):
        # Settled: every node points to one node, which points to none.
        torn = now.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("b2"))
        if torn.filter("b <> b2").isEmpty() and now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        # Large star: neighbours above a node link to the smallest of its neighbourhood.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: a node and its neighbours below link to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, materialize(low.select("a", F.col("m").alias("b")).union(small).distinct(), "small")
        discard(last, large)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
