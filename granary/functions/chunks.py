"""Texts to overlapping chunks on paragraph, sentence and word boundaries.

Own semantics: pieces between boundaries are packed greedily up to ``size`` characters; a piece that is too long is cut at the
next finer boundary, at last between characters.  A chunk starts with as many of the pieces before it as fit in ``overlap``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

LEVELS = (re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?。！？])\s*"), re.compile(r"\s+"))


def pieces(text: str, start: int, end: int, size: int, level: int = 0) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most ``size`` characters that cover the range."""
    if end - start <= size:
        return [(start, end)] if end > start else []
    if level == len(LEVELS):
        return [(a, min(a + size, end)) for a in range(start, end, size)]
    cuts = [m.end() for m in LEVELS[level].finditer(text, start, end) if start < m.end() < end]
    edges = [start, *cuts, end]
    return [p for a, b in zip(edges, edges[1:]) for p in pieces(text, a, b, size, level + 1)]


def split(text: str, size: int = 1000, overlap: int = 200) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    now: list[tuple[int, int]] = []
    for p in pieces(text, 0, len(text), size):
        if now and p[1] - now[0][0] > size:
            out.append((now[0][0], now[-1][1]))
            while now and (now[-1][1] - now[0][0] > overlap or p[1] - now[0][0] > size):
                now.pop(0)
        now.append(p)
    if now:
        out.append((now[0][0], now[-1][1]))
    return out


class Chunker:
    def __init__(self, size: int = 1000, overlap: int = 200):
        if size < 1 or not 0 <= overlap < size:
            raise ValueError("size must be positive and overlap below it")
        self.size, self.overlap = size, overlap

    def split(self, text: Column | str) -> Column:
        """``array<struct<text, start, end>>``, offsets in characters."""
        size, overlap = self.size, self.overlap

        @F.pandas_udf("array<struct<text:string,start:bigint,end:bigint>>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series([None if x is None else [{"text": x[a:b], "start": a, "end": b} for a, b in split(x, size, overlap)] for x in s])

        return run(column(text))
