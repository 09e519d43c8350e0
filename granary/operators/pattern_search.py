"""Searching a table of patterns in a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Matcher

#: Pattern sets up to so many bytes are sent to the tasks as an automaton.
AUTOMATON_BYTES = 8 << 20


def distinct_patterns(patterns: DataFrame, id_col: str, pattern_col: str) -> DataFrame:
    """Without empty patterns; of repeated ones the smallest id."""
    return patterns.filter(F.length(pattern_col) > 0).groupBy(F.col(pattern_col).alias("pattern")).agg(F.min(id_col).alias("pattern_id"))


def match_rows(docs: DataFrame, id_col: str, text_col: str, patterns: DataFrame, pattern_id: str, pattern_col: str) -> DataFrame:
    """``doc id, pattern_id, start, end`` of every occurrence, whatever the size of the pattern set.

    Small sets run as an automaton; larger ones as an equality join of the texts' substrings of the patterns' lengths with the patterns.
    """
    known = distinct_patterns(patterns, pattern_id, pattern_col)
    size = known.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    if size <= AUTOMATON_BYTES:
        rows = known.orderBy("pattern_id").collect()
        ids = F.array(*[F.lit(r["pattern_id"]).cast("long") for r in rows]) if rows else F.array().cast("array<bigint>")
        found = docs.select(id_col, F.explode_outer(Matcher([r["pattern"] for r in rows]).find_all(text_col)).alias("m")).filter("m IS NOT NULL")
        return found.select(id_col, F.element_at(ids, (F.col("m.pattern_id") + 1).cast("int")).alias("pattern_id"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    return match_rows_by_join(docs, id_col, text_col, known)


def match_rows_by_join(docs: DataFrame, id_col: str, text_col: str, known: DataFrame) -> DataFrame:
    """The join form: substrings by hash equality; ``known`` as from ``distinct_patterns``.

    Both sides are compared as UTF-32, where the n-th character lies at a known byte, so cutting a text is linear in its length.
    """
    sizes = [r[0] for r in known.select(F.length("pattern")).distinct().collect()]
    if not sizes:
        return docs.select(id_col, F.lit(0).cast("long").alias("pattern_id"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).limit(0)
    t, n = F.encode(text_col, "UTF-32"), F.length(text_col)
    known = known.withColumn("pattern", F.encode("pattern", "UTF-32"))
    pieces = None
    for k in sorted(sizes):
        at = F.when(n >= k, F.sequence(F.lit(0), n - k))
        own = docs.select(id_col, t.alias("_t"), F.explode_outer(at).alias("_at")).filter("_at IS NOT NULL").select(id_col, F.substring("_t", 4 * F.col("_at") + 1, F.lit(4 * k)).alias("pattern"), F.col("_at").cast("long").alias("start"), (F.col("_at") + k).cast("long").alias("end"))
        pieces = own if pieces is None else pieces.unionByName(own)
    return pieces.join(known, "pattern").select(id_col, "pattern_id", "start", "end")


def contaminated(docs: DataFrame, id_col: str, text_col: str, patterns: DataFrame, pattern_id: str, pattern_col: str) -> DataFrame:
    """Ids of the texts that hold any pattern; the scan of a text stops at the first match when the set is small."""
    known = distinct_patterns(patterns, pattern_id, pattern_col)
    size = known.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    if size <= AUTOMATON_BYTES:
        return docs.filter(Matcher([r[0] for r in known.select("pattern").collect()]).is_match(text_col)).select(id_col)
    return docs.select(id_col).join(match_rows_by_join(docs, id_col, text_col, known).select(id_col).distinct(), id_col, "left_semi")
