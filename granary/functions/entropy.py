"""Byte entropy of binary columns, whole and in windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

_LN2 = math.log(2)


def _terms(counts: np.ndarray, total: int) -> np.ndarray:
    """-p ln p for each of the 256 counts; the logarithm of the C library, once per distinct count."""
    known: dict[int, float] = {0: 0.0}
    out = []
    for c in counts.tolist():
        term = known.get(c)
        if term is None:
            p = c / total
            term = known[c] = -p * math.log(p)
        out.append(term)
    return np.array(out)


def entropy_of_counts(counts: np.ndarray) -> float:
    """Bits per byte; the 256 terms are added pairwise, as NumPy does."""
    total = int(counts.sum())
    if not total:
        return 0.0
    return float(np.sum(_terms(counts, total)) / _LN2) + 0.0


def counts_of(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def histogram(data: Column | str) -> Column:
    """256 counts."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else counts_of(x) for x in s])

    return run(column(data))


def entropy(data: Column | str) -> Column:
    """Bits per byte; empty input has 0."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else entropy_of_counts(counts_of(x)) for x in s], dtype="float64")

    return run(column(data))


def entropy_of_histogram(counts: Column | str) -> Column:
    """The same from 256 counts, in the JVM, with the terms added in the same pairwise order.

    The counts must be a stored or aggregated column: Spark takes no Python UDF into a function of arrays.
    """
    c = column(counts)
    bad = (F.size(c) != 256) | F.exists(c, lambda x: x.isNull() | (x < 0))
    total = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)

    def body(t: Column) -> Column:
        terms = F.transform(c, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(-(x / t) * F.log(x / t)))

        def summed(v: Column) -> Column:
            def half(at: int) -> Column:
                r = [F.aggregate(F.sequence(F.lit(at + k + 8), F.lit(at + k + 120), F.lit(8)), F.get(v, F.lit(at + k)), lambda s, i: s + F.get(v, i)) for k in range(8)]
                return ((r[0] + r[1]) + (r[2] + r[3])) + ((r[4] + r[5]) + (r[6] + r[7]))

            return (half(0) + half(128)) / F.lit(_LN2)

        return F.when(t == 0, F.lit(0.0)).otherwise(F.transform(F.array(terms), summed)[0])

    checked = F.when(bad, F.raise_error(F.lit("a histogram has 256 counts that are not negative")).cast("bigint")).otherwise(total)
    return F.when(c.isNotNull(), F.transform(F.array(checked), body)[0])


def _check(window: int, step: int | None) -> int:
    step = window if step is None else step
    if window <= 0 or step <= 0:
        raise ValueError("window and step must be positive")
    return step


def window_count(length: Column | str, window: int, step: int | None = None) -> Column:
    step, n = _check(window, step), column(length).cast("long")
    return F.when(n >= window, F.floor((n - window) / F.lit(step)).cast("long") + 1).when(n.isNotNull(), F.lit(0).cast("long"))


def windows(data: Column | str, window: int, step: int | None = None) -> Column:
    """``array<struct<offset, entropy>>`` of each whole window at offsets 0, step, 2 * step, ...; a partial last one is dropped."""
    step = _check(window, step)
    # With a fixed window the term of each count is known beforehand.
    table = [0.0] + [-(c / window) * math.log(c / window) for c in range(1, window + 1)] if window <= 1 << 16 else None

    @F.pandas_udf("array<struct<offset:bigint,entropy:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = None if table is None else np.array(table)

        def one(x: bytes) -> list[dict[str, float]]:
            data = np.frombuffer(x, np.uint8)
            offsets = range(0, len(data) - window + 1, step)
            each = [np.bincount(data[at : at + window], minlength=256) for at in offsets]
            if known is None:
                return [{"offset": at, "entropy": entropy_of_counts(c)} for at, c in zip(offsets, each)]
            # Row by row the terms are added as those of one window are.
            h = np.sum(known[np.array(each)], axis=1) / _LN2 + 0.0 if each else ()
            return [{"offset": at, "entropy": float(v)} for at, v in zip(offsets, h)]

        for s in batches:
            yield pd.Series([None if x is None else one(x) for x in s])

    return run(column(data))
