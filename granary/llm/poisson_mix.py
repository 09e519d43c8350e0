"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Every document gets a count drawn from a Poisson distribution whose mean is its source's target repetition
rate.  The draw inverts the distribution at a uniform number hashed from the seed and
the document's id, so it is the same on every run, in every partitioning and after a lost executor.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize

#: Means above this are drawn as sums of draws with smaller means, which has the same distribution.
PART_MEAN = 16.0
#: Terms of a distribution that are summed.  Its sum in double precision stops growing far below (at 66 terms for the mean 16), and
#: from there on it counts as 1, so no draw is cut off.
TERMS = 96


def uniform(seed: int, key: Column, part: Column) -> Column:
    """A number in [0, 1) with 52 bits, from MD5 of ``seed:key:part``."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), part.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_sums(mean: Column) -> Column:
    """P(Poisson(mean) <= n) for n = 0, 1, ..., up to where the sum stops growing in double precision."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(s["sums"], F.element_at(s["sums"], -1) + p).alias("sums"))

    sums = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["sums"])
    return F.filter(sums, lambda c, i: (i == 0) | (F.get(sums, i - 1) < c))


def poisson_count(sums: Column, u: Column) -> Column:
    """The smallest n with P(Poisson <= n) > u."""
    return F.least(F.size(F.filter(sums, lambda c: c <= u)), F.size(sums) - 1).cast("long")


def target_rates(docs: DataFrame, source_col: str, weights: Mapping[str, float] | None, total: float | None) -> DataFrame:
    """``_source, rate, parts, sums``: how often each document of a source should be repeated on average, and the distribution function of each
    of the ``parts`` draws that add up to it.

    A source of weight w (its share of the sum of weights) and n documents gets ``total * w / n``.
    ``weights=None`` weighs all sources alike; sources that ``weights`` doesn't name get none.
    """
    sizes = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weighed = sizes.withColumn("_w", F.lit(1.0))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        weighed = sizes.withColumn("_w", F.coalesce(F.try_element_at(known, F.coalesce("_source", F.lit("null"))), F.lit(0.0)))
    weight, rows = weighed.agg(F.sum("_w"), F.sum("_n")).first()
    goal = float(total) if total is not None else float(rows or 0)
    rate = F.lit(goal) * F.col("_w") / F.lit(weight) / F.col("_n") if weight else F.lit(0.0)
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(PART_MEAN)).cast("int"), F.lit(1))
    return weighed.select("_source", rate.alias("rate")).withColumn("parts", parts).withColumn("sums", poisson_sums(F.col("rate") / F.col("parts")))


def poisson_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Mapping[str, float] | None = None,
    total: float | None = None,
    seed: int = 17,
) -> DataFrame:
    """Copies of documents in a global random order: ``_row, copy, n_copies, shuffle_key``.

    ``weights`` maps source to weight (None: all alike; key ``"null"`` means the null source); ``total`` is the
    expected number of rows out (None: as many as come in).  Rows are drawn on their own, so rows that share an id share the count; rows of
    null id draw by their whole content, so they share neither count nor place.  Null sources form a source of their own.  An empty table,
    or weights of zero, give an empty result.  Extra columns travel inside ``_row``.
    """
    rates = materialize(target_rates(docs, source_col, weights, total), "rates")
    base = boxed(docs)
    row = F.col("_row")
    # One row a source: AQE broadcasts it when small, and splits the hot source's partition when not.
    rated = base.join(rates, row.getField(source_col).cast("string").eqNullSafe(F.col("_source")))
    # Rows without an id are told apart by their content.
    key = F.coalesce(row.getField(id_col).cast("string"), F.concat(F.lit("null"), F.sha2(F.to_json("_row"), 256)))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0).cast("long"), lambda acc, j: acc + poisson_count(F.col("sums"), uniform(seed, key, j)))
    counted = rated.filter("rate > 0").select("_row", drawn.alias("n_copies"))
    # No filter on the count: it would be drawn twice.  A null array has no rows.
    copies = counted.select("_row", "n_copies", F.explode(F.when(F.col("n_copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), key, F.col("copy").cast("string")).cast("binary"))
    return copies.select("_row", "copy", "n_copies", key.alias("shuffle_key")).orderBy("shuffle_key")
