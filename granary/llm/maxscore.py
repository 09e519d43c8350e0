"""Exact top-k search by MaxScore over integer vectors.

The dimensions of a query are its terms, and a row's contribution in a term is its product there, counted from the least of the
shard, so contributions are never negative and have an upper bound.  A term's postings are the rows above that least, by column.  While the k-th best score so far
rises, more and more of the terms with the smallest bounds can't lift a row over it even together: they are non-essential.  The postings of the
essential terms are traversed block by block; a row is probed in the other terms, largest bound
first, only while its score can still compete.  Shards return their k best, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a posting block; non-essential terms probed in one step.
BLOCK, STEP = 1024, 16
#: Rows of a shard: a share of all, within these bounds, of which the upper one bounds a task's memory.
SHARES, LEAST_ROWS, MOST_ROWS = 16, 1 << 10, 1 << 17


def essential_terms(rest: np.ndarray, least: float, theta: float | None) -> int:
    """How many of the terms, largest bound first, are essential: the others together can't lift a row from the least score to ``theta``.

    ``rest[i]`` is the sum of the bounds of term i and all later ones.
    """
    if theta is None:
        return len(rest) - 1
    return min(int(np.searchsorted(-rest, least - theta, side="right")), len(rest) - 1)


def top_k(ids: np.ndarray, columns: np.ndarray, query_id: int, query: np.ndarray, k: int, bounds: tuple[np.ndarray, np.ndarray] | None = None, work: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int]]:
    """(vec_id, score) of the k best rows, best first, ties to smaller ids; the query's own row takes no part.

    ``columns`` has a row for each term: its postings.  ``work`` gets, for each block, its rows, the number of essential terms and of the
    products made.
    """
    if not len(ids):
        return []
    lo, hi = (columns.min(axis=1), columns.max(axis=1)) if bounds is None else bounds
    a, b = query * lo, query * hi
    low, span = np.minimum(a, b), np.abs(a - b)
    order = np.argsort(-span, kind="stable")
    q = query[order]
    rest = np.append(np.cumsum(span[order][::-1])[::-1], 0)
    floor = np.append(np.cumsum(low[order][::-1])[::-1], 0)  # what the terms from i on give at least
    best_ids, best = np.empty(0, np.int64), np.empty(0, columns.dtype)
    theta = None
    for at in range(0, len(ids), BLOCK):
        own = ids[at : at + BLOCK]
        # No row reaches theta by non-essential terms alone: each candidate is in the postings of an essential one.
        split = essential_terms(rest, float(floor[0]), theta)
        if split == 0:
            break
        score = q[:split] @ columns[order[:split], at : at + BLOCK]
        made = split * len(own)
        live = np.flatnonzero(own != query_id)
        score, done = score[live], split
        while True:
            if theta is not None:
                keep = score + (floor[done] + rest[done]) >= theta
                live, score = live[keep], score[keep]
            if done >= len(q) or not len(live):
                break
            to = min(done + STEP, len(q))
            if 2 * len(live) >= len(own):  # then a whole block is cheaper than picking rows
                score = score + (q[done:to] @ columns[order[done:to], at : at + BLOCK])[live]
                made += (to - done) * len(own)
            else:
                score = score + q[done:to] @ columns[order[done:to, None], at + live[None, :]]
                made += (to - done) * len(live)
            done = to
        if work is not None:
            work.append((len(own), split, made))
        if not len(live):
            continue
        best_ids, best = np.concatenate([best_ids, own[live]]), np.concatenate([best, score])
        o = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[o], best[o]
        if len(best) == k:
            theta = float(best[-1]) if columns.dtype.kind == "f" else int(best[-1])
    return [(int(i), int(s)) for i, s in zip(best_ids, best)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best rows of ``vectors``, its own id left out.

    Components become floor(scale * x); the score is the integer inner product.  Vectors that are null or hold null or non-finite
    components take no part, nor do rows of null id; an empty vector scores 0, and a shorter one counts as zero in what it lacks.  Scores that need more
    than 64 bits raise an error.  Of queries that repeat
    an id the smallest vector counts; repeated rows are candidates each.  An empty table gives an empty result; extra columns don't matter.

    Rows are dealt to shards by a hash of id and vector.  The queries are a table too: it is dealt to all shards, whose task holds the shard's rows and takes the
    queries one batch after the other; nothing goes through the driver.
    """
    whole = F.transform(F.col(f"`{vec_col}`"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.col(f"`{vec_col}`").isNotNull() & F.forall(f"`{vec_col}`", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))

    def clean(df: DataFrame) -> DataFrame:
        return df.filter(sound & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"))

    q = materialize(clean(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    rows = clean(vectors)
    n = rows.count()
    shards = max(1, -(-n // min(max(n // SHARES, LEAST_ROWS), MOST_ROWS)))
    own = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("s"), F.lit(False).alias("asks"), "id", "v")
    asked = q.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"), F.lit(True).alias("asks"), "id", "v")
    dealt = own.unionByName(asked).repartition(shards, "s").sortWithinPartitions("s", "asks")
    found = dealt.mapInArrow(lambda x: _shards(x, k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _shards(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each shard first its rows, then the queries, in this order."""
    now, ids, vs = None, [], []
    ready: tuple | None = None

    def pack() -> tuple:
        each = [v.value_lengths().to_numpy(zero_copy_only=False) for v in vs]
        size = np.concatenate(each).astype(np.int64)
        columns = np.zeros((int(size.max(initial=0)), len(size)), np.int64)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        columns[at, np.repeat(np.arange(len(size)), size)] = np.concatenate([v.flatten().to_numpy(zero_copy_only=False) for v in vs])
        # Floats are exact up to 2**53 and multiply faster.
        return np.concatenate(ids), columns, columns.astype(np.float64), float(np.abs(columns).max(initial=0)), columns.min(axis=1), columns.max(axis=1)

    for b in batches:
        s, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        cuts = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(s)]
        for u, v in zip(cuts, cuts[1:]):
            if u == v:
                continue
            if s[u] != now:
                now, ids, vs, ready = s[u], [], [], None
            part = b.slice(u, v - u)
            if not asks[u]:
                ids.append(part.column(2).to_numpy())
                vs.append(part.column(3))
                continue
            if not ids:
                continue
            if ready is None:
                ready = pack()
                vs = []
            out = [x for i in range(u, v) for x in _answer(ready, int(b.column(2)[i].as_py()), b.column(3)[i].values.to_numpy(zero_copy_only=False), k)]
            cols = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(cols[:, i]) for i in range(3)], ["query_id", "vec_id", "score"])


def _answer(shard: tuple, query_id: int, v: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    ids, columns, as_floats, largest, lo, hi = shard
    width = len(columns)
    top = largest * float(np.abs(v.astype(np.float64)).max(initial=0)) * max(width, 1)
    if top >= 2**62:
        raise OverflowError("scores of these vectors need more than 64 bits")
    small = top < 2**52
    q = np.zeros(width, np.float64 if small else np.int64)
    q[: len(v)] = v[:width]
    return [(query_id, i, s) for i, s in top_k(ids, as_floats if small else columns, query_id, q, k, (lo, hi))]
