"""Exact duplicates and integrity by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, digest_col: str, id_col: str, least: int = 2) -> DataFrame:
    """``digest, n, keep_id`` of each digest with at least ``least`` rows; combined in the map tasks first."""
    return df.groupBy(F.col(digest_col)).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("keep_id")).filter(F.col("n") >= least)


def keep_first(df: DataFrame, digest_col: str, id_col: str) -> DataFrame:
    """The row with the smallest id of each digest; null digests are one group, null ids come last.  Rows equal in both stay together.

    Only ids and digests are aggregated; rows are kept by a semi join on both.
    """
    first = df.groupBy(F.col(digest_col).alias("_digest")).agg(F.min(id_col).alias("_id"))
    return df.join(first, df[digest_col].eqNullSafe(F.col("_digest")) & df[id_col].eqNullSafe(F.col("_id")), "left_semi")


def verify_integrity(df: DataFrame, digest_col: str, published: DataFrame, published_col: str, key: str) -> DataFrame:
    """``key, ok``: whether each row's digest equals the published one, in algorithm and bytes; unpublished keys are not ok."""
    other = published.select(F.col(key), F.col(published_col).alias("_published"))
    return df.select(key, F.col(digest_col).alias("_own")).join(other, key, "left").select(key, F.coalesce(F.col("_own") == F.col("_published"), F.lit(False)).alias("ok"))


def ordered_concat(df: DataFrame, keys: list[str], order: str, chunk: str) -> DataFrame:
    """Chunks of each key joined in order, as ``data`` (binary): what an incremental hasher has seen after its last update."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(F.col(chunk)).alias("c"))))
    return df.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["c"]), "")).alias("data"))


#: Rows that one task sorts in :func:`adjacent_pairs`, and buckets of values in which a partition of all rows is cut at most.
SORTED_ROWS, MOST_BUCKETS = 1 << 20, 1 << 16


def adjacent_pairs(df: DataFrame, partition: str, order: str, columns: list[str], orders: DataFrame | None = None) -> DataFrame:
    """Each row beside the next of its partition by ``order`` (a number), as ``next_<column>``.

    Partitions are cut into ranges of ``order``, so that one with most of the rows is many tasks; the last row of a range
    meets the first of the next one that has rows through a table of one row a range.  ``orders`` is a table with the same values of ``order`` where ``df`` is
    dear to compute.
    """
    n, low, high = (df if orders is None else orders).agg(F.count(F.lit(1)), F.min(order), F.max(order)).first()
    buckets = max(1, min(MOST_BUCKETS, -(-n // SORTED_ROWS)))
    width = max(1, (float(high) - float(low)) / buckets) if n and low is not None else 1
    cut = df.withColumn("_bucket", F.coalesce(F.least(F.floor((F.col(order) - F.lit(low)) / F.lit(width)), F.lit(buckets - 1)), F.lit(-1)) if n and low is not None else F.lit(0).cast("long"))
    w = Window.partitionBy(partition, "_bucket").orderBy(order)
    row = F.struct(*[F.col(c) for c in columns])
    inside = cut.select("*", F.lead(row).over(w).alias("_next"))
    if buckets > 1:
        firsts = cut.groupBy(partition, "_bucket").agg(F.min_by(row, order).alias("_first"))
        after = firsts.select(F.col(partition).alias("_p"), F.col("_bucket").alias("_b"), F.lead("_first").over(Window.partitionBy(partition).orderBy("_bucket")).alias("_first"))
        inside = inside.join(after, F.col(partition).eqNullSafe(F.col("_p")) & (F.col("_bucket") == F.col("_b"))).withColumn("_next", F.coalesce("_next", "_first"))
    return inside.filter(F.col("_next").isNotNull()).select(*df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])
