"""Reports over cases of a comparison and over timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def differential(cases: DataFrame, case_col: str, expected: Column, got: Column) -> DataFrame:
    """``cases, passed, failures``: counts, and the first five failing cases as ``case N``."""
    judged = cases.select(F.col(case_col).alias("c"), expected.eqNullSafe(got).alias("ok"))
    failing = judged.filter(~F.col("ok")).orderBy("c").limit(5).select(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p"), F.col("c").alias("f"))
    totals = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("p")).withColumn("f", F.lit(None).cast(judged.schema["c"].dataType))
    return totals.unionByName(failing).agg(F.sum("n").alias("cases"), F.sum("p").alias("passed"), F.array_join(F.sort_array(F.collect_list("f")), ",").alias("failures"))


#: Buckets of a key's range of values among which the middle ones are looked for.
BUCKETS = 4096


def medians(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, upper_median, median``: the upper middle sample, and the mean of the middle two; nulls come first, as in sorting.

    Samples are counted in buckets of their key's range, summed in the map tasks first.  Only the buckets that hold the middle ranks are ranked row
    by row, so a key with most of the samples is not sorted in one task.
    """
    v = F.col(value).cast("double")
    base = samples.select(*[F.col(k) for k in keys], v.alias("_v"))
    finite = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))
    ranges = base.groupBy(*keys).agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"), F.count(F.lit(1)).alias("_n"))

    def same(a: str, b: str) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    # Beside the buckets of the range, in the order of sorting: null, minus infinity, and infinity and NaN.
    inner = F.least(F.floor((F.col("_v") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300)) * BUCKETS), F.lit(BUCKETS - 1))
    bucket = F.when(F.col("_v").isNull(), -2).when(F.isnan("_v"), BUCKETS + 1).when(F.col("_v") == float("-inf"), -1).when(F.col("_v") == float("inf"), BUCKETS).otherwise(inner).cast("long")
    placed = base.alias("x").join(F.broadcast(ranges.alias("r")) if ranges.count() <= 1 << 16 else ranges.alias("r"), same("x", "r")).select("x.*", "_n", bucket.alias("_bucket"))
    counts = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_m"), F.first("_n").alias("_n"))
    before = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_m")
    up, down = F.floor(F.col("_n") / 2) + 1, F.floor((F.col("_n") + 1) / 2)
    middle = counts.select(*keys, "_bucket", "_m", before.alias("_before"), up.alias("_up"), down.alias("_down")).filter("(_up > _before AND _up <= _before + _m) OR (_down > _before AND _down <= _before + _m)")
    chosen = placed.alias("x").join(middle.alias("r"), same("x", "r") & (F.col("x._bucket") == F.col("r._bucket"))).select("x.*", "_before", "_up", "_down")
    # Equal samples are counted, so a value that fills a bucket is one row.
    tied = chosen.groupBy(*keys, "_bucket", "_before", "_up", "_down", "_v").agg(F.count(F.lit(1)).alias("_k"))
    last = F.col("_before") + F.sum("_k").over(Window.partitionBy(*keys, "_bucket").orderBy(F.col("_v").asc_nulls_first()))
    ranked = tied.select(*keys, "_v", "_up", "_down", last.alias("_last"), (last - F.col("_k")).alias("_first"))
    pick = lambda r: F.max(F.when((F.col(r) > F.col("_first")) & (F.col(r) <= F.col("_last")), F.col("_v")))
    return ranked.groupBy(*keys).agg(pick("_up").alias("upper_median"), ((pick("_up") + pick("_down")) / 2).alias("median"))
