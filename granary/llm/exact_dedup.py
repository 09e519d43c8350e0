"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 counts the 64-bit hashes of the texts, summed in the map tasks first, and puts those that occur more than once into a Bloom
filter.  So the filter's size follows the repeated texts, not the rows.  Pass 2 probes it: a text that is not in the filter
occurs once for certain, and its row passes straight through without any shuffle.  Only the possibly repeated rows
are grouped, by the SHA-256 of the whole text, so false positives of the filter cost time but never change the result.

The filter is blocked: all probes of a hash fall into one segment, a bitmap of Spark's, so a row looks at one segment.  Segments are broadcast, at most
``broadcast_limit_bytes`` at once; where there are more, each such portion has a scan of its own that takes the rows it can decide, and
rows that pass are moved at no size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, text_or_empty

#: Bits in one bitmap of Spark's bitmap functions: a fixed value of theirs.
SEGMENT_BITS = 32768
#: Bits of the hash that choose a position in the segment, one portion for each probe.
PROBE_BITS = 15


def _positions(h: Column, probes: int) -> list[Column]:
    """Places in the segment, each from other bits of the hash."""
    return [F.shiftrightunsigned(h, PROBE_BITS * k).bitwiseAND(F.lit(SEGMENT_BITS - 1)) for k in range(probes)]


def _segment(h: Column, segments: int) -> Column:
    """Which segment a hash belongs to, by bits of its own."""
    return F.pmod(F.xxhash64(h), F.lit(segments))


def _bit_is_set(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))


def repeated_hashes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``h``: the 64-bit hashes of texts that occur more than once.  A text that a third of all rows share sends one record for each task."""
    return docs.groupBy(F.xxhash64(text_or_empty(text_col)).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")


def bloom_filter(hashes: DataFrame, segments: int, probes: int) -> DataFrame:
    """``segment, bitmap`` of a blocked Bloom filter."""
    h = F.col("h")
    hit = hashes.select(_segment(h, segments).alias("segment"), F.explode(F.array(*_positions(h, probes))).alias("at"))
    return hit.groupBy("segment").agg(F.bitmap_construct_agg("at").alias("bitmap"))


def possibly_repeated(docs: DataFrame, text_col: str = "text", bits_per_text: int = 16, probes: int = 4, broadcast_limit_bytes: int = 64 << 20) -> DataFrame:
    """Every row of ``docs`` as ``_row``, with ``_maybe``: false means that its text occurs once for certain.  No row is moved."""
    hashes = materialize(repeated_hashes(docs, text_col), "repeated")
    segments = max(1, -(-hashes.count() * bits_per_text // SEGMENT_BITS))
    bloom = materialize(bloom_filter(hashes, segments, probes), "bloom")
    text = F.coalesce(F.col("_row").getField(text_col).cast("string"), F.lit(""))
    base = boxed(docs).withColumn("_h", F.xxhash64(text))
    at_once = max(1, broadcast_limit_bytes * 8 // SEGMENT_BITS)
    scans = []
    for first in range(0, segments, at_once):
        own = bloom.filter(F.col("segment").between(first, first + at_once - 1)).select(F.col("segment").alias("_s"), F.col("bitmap").alias("_b"))
        part = base if segments <= at_once else base.filter(_segment(F.col("_h"), segments).between(first, first + at_once - 1))
        probed = part.join(F.broadcast(own), _segment(F.col("_h"), segments) == F.col("_s"), "left")
        maybe = reduce(Column.__and__, [_bit_is_set(F.col("_b"), at) for at in _positions(F.col("_h"), probes)])
        scans.append(probed.select("_row", maybe.alias("_maybe")))
    return reduce(DataFrame.unionByName, scans)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_text: int = 16, probes: int = 4, broadcast_limit_bytes: int = 64 << 20) -> DataFrame:
    """Every row of ``docs`` as ``_row``, with ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; of equal texts the row with the largest id stays.  A null text
    counts as empty.  Null ids never stay when another row of the group has an id; in a group without any
    id ``keep_id`` is null and one row stays.  Of rows that repeat both id and text the one whose JSON has the largest digest stays, so
    extra columns decide the same way on every run; of rows equal in all columns one.
    An empty table gives an empty result.  Extra columns travel inside ``_row`` and can't clash.

    The filter has ``bits_per_text`` bits for each text that repeats; ``probes`` of up to 4 bits are set for each.
    """
    probed = possibly_repeated(docs, text_col, bits_per_text, probes, broadcast_limit_bytes)
    text = F.coalesce(F.col("_row").getField(text_col).cast("string"), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    doc_id = F.col("_row").getField(id_col)
    once = probed.filter(~F.col("_maybe")).select(
        "_row", doc_id.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha.alias("text_sha256")
    )
    again = probed.filter("_maybe").select("_row", doc_id.alias("_id"), sha.alias("text_sha256"))
    by_id = again.groupBy("text_sha256", "_id").agg(F.count(F.lit(1)).alias("_n"))
    groups = by_id.groupBy("text_sha256").agg(F.max(F.struct(F.col("_id"), F.col("_n"))).alias("_best"), F.sum("_n").alias("group_size"))
    groups = materialize(groups.select("text_sha256", F.col("_best._id").alias("keep_id"), "group_size", (F.col("_best._n") > 1).alias("_tie")), "groups")
    same = again.join(groups, "text_sha256")
    best = F.col("_id").eqNullSafe(F.col("keep_id"))
    resolved = same.filter(~(best & F.col("_tie"))).select("_row", "keep_id", "group_size", best.alias("kept"), "text_sha256")
    out = once.unionByName(resolved)
    # Rows that repeat both id and text are the only tie left; they are rare, so look first.
    if groups.filter("_tie").isEmpty():
        return out
    ties = same.filter(best & F.col("_tie")).withColumn("_json", F.sha2(F.to_json("_row"), 256))
    largest = ties.groupBy("text_sha256").agg(F.max("_json").alias("_largest"))
    # Equal rows are counted, not numbered, so that no task gets a group's rows; the first of each number stays.
    counted = ties.groupBy("_row", "keep_id", "group_size", "text_sha256", "_json").agg(F.count(F.lit(1)).alias("_n")).join(largest, "text_sha256")
    nth = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_nth"))
    return out.unionByName(nth.select("_row", "keep_id", "group_size", ((F.col("_json") == F.col("_largest")) & (F.col("_nth") == 1)).alias("kept"), "text_sha256"))
