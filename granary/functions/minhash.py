"""MinHash signatures: affine permutations of 32-bit item hashes.

Signatures are computed in NumPy over Arrow batches, where one vector operation covers all items of a batch;
everything else (hashes of single items, updates, merges, comparison) stays in the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .shingle import separators
from .text import column

MAX = (1 << 32) - 1


def check(num_perm: int, seed: int) -> None:
    if not isinstance(num_perm, int) or isinstance(num_perm, bool) or not isinstance(seed, int) or isinstance(seed, bool):
        raise TypeError("num_perm and seed must be integers")
    if num_perm < 1:
        raise ValueError("num_perm must be at least 1")
    if not 0 <= seed <= MAX:
        raise ValueError("seed must be between 0 and 2**32 - 1")


def permutations(num_perm: int = 128, seed: int = 1) -> tuple[list[int], list[int]]:
    """(a, b) of the permutations a * h + b mod 2**32: a odd, drawn first, then b, from a Mersenne Twister."""
    check(num_perm, seed)
    rng = np.random.RandomState(seed)
    a = rng.randint(0, 1 << 31, num_perm, dtype=np.uint32).astype(np.int64) * 2 + 1
    b = rng.randint(0, 1 << 32, num_perm, dtype=np.uint32).astype(np.int64)
    return a.tolist(), b.tolist()


def sha1_hash32(item: Column | str) -> Column:
    """The first four bytes of SHA-1, little-endian, as a bigint."""
    s = F.sha1(column(item).cast("binary"))
    return F.conv(F.concat(F.substring(s, 7, 2), F.substring(s, 5, 2), F.substring(s, 3, 2), F.substring(s, 1, 2)), 16, 10).cast("long")


def _times32(x: Column, k: int) -> Column:
    """x * k mod 2**32 without overflow of 64 bits."""
    m = F.lit(MAX).cast("long")
    low = x.bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(k).cast("long")
    high = F.shiftrightunsigned(x, 16) * F.lit(k).cast("long")
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF).cast("long")), 16)).bitwiseAND(m)


def fmix32(h: Column | str) -> Column:
    """The finalizer of Murmur3 over 32 bits."""
    h = column(h).cast("long")
    h = _times32(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), 0x85EBCA6B)
    h = F.transform(F.array(h), lambda x: _times32(x.bitwiseXOR(F.shiftrightunsigned(x, 13)), 0xC2B2AE35))[0]
    return F.transform(F.array(h), lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 16)))[0]


def item_hashes(items: Column | str) -> Column:
    """Hash every item of an array of strings or binaries."""
    return F.transform(column(items), lambda x: fmix32(sha1_hash32(x)))


def mixed_hashes(items: list[str | bytes]) -> np.ndarray:
    """``fmix32(sha1_hash32(item))`` of every item."""
    sha = hashlib.sha1
    digests = b"".join([sha(x.encode() if isinstance(x, str) else x, usedforsecurity=False).digest()[:4] for x in items])
    h = np.frombuffer(digests, "<u4").astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


_SPACED = str.maketrans({c: " " for c in separators()})
_BARE = str.maketrans({c: None for c in separators()})


def _grams(units: list[str], joiner: str) -> list[str]:
    if len(units) < 3:
        return [joiner.join(units)] if units else []
    return list({joiner.join(g) for g in zip(units, units[1:], units[2:])})


#: The shingles of :mod:`.shingle` in Python; their order doesn't matter to a signature.
SHINGLERS = {"word": lambda t: _grams([w for w in t.lower().translate(_SPACED).split(" ") if w], " "), "char": lambda t: _grams(list(t.lower().translate(_BARE)), "")}


class MinHasher:
    """Signatures of one family of permutations; a signature is an ``array<bigint>`` of ``num_perm`` values below 2**32."""

    def __init__(self, num_perm: int = 128, seed: int = 1):
        self.a, self.b = permutations(num_perm, seed)
        self.num_perm, self.seed = num_perm, seed

    def _minima(self, sets: list[list[str | bytes] | None]) -> list[np.ndarray | None]:
        a, b = np.array(self.a, np.uint32), np.array(self.b, np.uint32)
        sizes = np.array([0 if x is None else len(x) for x in sets], np.int64)
        out = np.full((len(sets), len(a)), MAX, np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            flat = mixed_hashes([x for i in full for x in sets[i]])
            at = np.cumsum(sizes[full]) - sizes[full]
            for p in range(len(a)):
                out[full, p] = np.minimum.reduceat(flat * a[p] + b[p], at)
        return [None if x is None else r for x, r in zip(sets, out)]

    def signature(self, items: Column | str) -> Column:
        """Of an array column; order and repeats of items don't matter.  Null stays null, an empty array gives ``empty()``."""

        @F.pandas_udf("array<bigint>")
        def minima(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(self._minima(list(s)))

        return minima(column(items))

    def signatures(self, df: DataFrame, items: str, out: str = "signature") -> DataFrame:
        """The table with column ``items`` replaced by its signatures: what to use where ``items`` is computed from nested functions of arrays.

        Batches pass through Python as they are, so select the columns you need first.
        """
        rest = [c for c in df.columns if c != items]
        schema = StructType([*[df.schema[c] for c in rest], StructField(out, ArrayType(LongType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sigs = self._minima(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sigs, pa.list_(pa.int64()))], [*rest, out])

        return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{items}`")).mapInArrow(run, schema)

    def text_signatures(self, df: DataFrame, text: str, mode: str = "word", out: str = "signature") -> DataFrame:
        """The table with column ``text`` replaced by the signature of its shingles (:mod:`.shingle`), which are cut and hashed in one pass.

        Shingles never become rows or Spark strings; of each only 32 bits of hash are kept.  Null stays null; a text without shingles gives ``empty()``.
        """
        cut = SHINGLERS[mode]
        rest = [c for c in df.columns if c != text]
        schema = StructType([*[df.schema[c] for c in rest], StructField(out, ArrayType(LongType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    sigs = self._minima([None if x is None else cut(x) for x in b.column(b.num_columns - 1).to_pylist()])
                    full = np.concatenate([s for s in sigs if s is not None]) if any(s is not None for s in sigs) else np.empty(0, np.int64)
                    ends = np.cumsum([0, *(0 if s is None else len(s) for s in sigs)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(full, pa.int64()), mask=pa.array([s is None for s in sigs], pa.bool_()))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*rest, out])

        return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)

    def empty(self) -> Column:
        return F.array_repeat(F.lit(MAX).cast("long"), self.num_perm)

    def of_hash(self, h: Column) -> Column:
        """The signature of one item by its hash, in the JVM."""
        m = F.lit(MAX).cast("long")
        pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in zip(self.a, self.b)])

        def one(p: Column) -> Column:
            low = h.bitwiseAND(F.lit(0xFFFF).cast("long")) * p["a"]
            high = F.shiftleft((F.shiftrightunsigned(h, 16) * p["a"]).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
            return (low.bitwiseAND(m) + high + p["b"]).bitwiseAND(m)

        return F.transform(pairs, one)

    def update(self, signature: Column | str, item: Column | str) -> Column:
        """Add an item to a signature of this family."""
        sig = column(signature)
        checked = F.when(F.size(sig) == self.num_perm, sig).otherwise(F.raise_error(F.lit("signature has another length")).cast("array<bigint>"))
        return merge(checked, F.transform(F.array(fmix32(sha1_hash32(item))), self.of_hash)[0])

    def update_batch(self, signature: Column | str, items: Column | str) -> Column:
        return merge(signature, self.signature(items))


def _same_length(x: Column, y: Column, then: Column, kind: str) -> Column:
    return F.when(F.size(x) == F.size(y), then).when(x.isNull() | y.isNull(), None).otherwise(F.raise_error(F.lit("signatures have different lengths")).cast(kind))


def merge(x: Column | str, y: Column | str) -> Column:
    """Signature of the union of two sets."""
    x, y = column(x), column(y)
    return _same_length(x, y, F.zip_with(x, y, lambda p, q: F.least(p, q)), "array<bigint>")


def merge_by(df: DataFrame, keys: list[str], signature: str, num_perm: int) -> DataFrame:
    """Signature of the union of each group: partial minima in the map tasks, one row per key and task shuffled."""
    mins = [F.min(F.col(signature)[i]).alias(f"_{i}") for i in range(num_perm)]
    return df.groupBy(*keys).agg(*mins).select(*keys, F.array(*[f"_{i}" for i in range(num_perm)]).alias(signature))


def jaccard(x: Column | str, y: Column | str) -> Column:
    """The share of equal positions."""
    x, y = column(x), column(y)
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return _same_length(x, y, same / F.size(x), "double")
