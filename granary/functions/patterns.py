"""Searching many patterns at once: an automaton in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

MATCH = "array<struct<pattern_id:bigint,start:bigint,end:bigint>>"
#: Sets of so few patterns are tested by ``contains`` in the JVM instead.
FEW = 16


class Matcher:
    """All patterns are strings, searched in string columns with code point offsets, or all are bytes, searched in binary columns with byte offsets.

    A pattern's id is its place in the list; empty ones never match, repeated ones report the first.
    """

    def __init__(self, patterns: list[str] | list[bytes]):
        if isinstance(patterns, (str, bytes, bytearray)):
            raise TypeError("expected a list of patterns")
        self.patterns = list(patterns)
        kinds = {bytes if isinstance(p, (bytes, bytearray)) else type(p) for p in self.patterns}
        if kinds - {str, bytes} or len(kinds) > 1:
            raise TypeError("patterns must be all str or all bytes")
        self.kind = kinds.pop().__name__ if kinds else "empty"
        self.ids: dict[str, int] = {}
        for i, p in enumerate(self.patterns):
            # Bytes are searched as the characters of the same numbers, so that offsets count bytes.
            p = p if isinstance(p, str) else bytes(p).decode("latin-1")
            if p:
                self.ids.setdefault(p, i)
        self.sizes = np.zeros(len(self.patterns), np.int64)
        for p, i in self.ids.items():
            self.sizes[i] = len(p)

    @property
    def pattern_count(self) -> int:
        return len(self.patterns)

    @property
    def distinct_pattern_count(self) -> int:
        return len(self.ids)

    def __len__(self) -> int:
        return len(self.patterns)

    def _automaton(self):
        import ahocorasick

        tree = ahocorasick.Automaton()
        for p, i in self.ids.items():
            tree.add_word(p, i)
        if self.ids:
            tree.make_automaton()
        return tree

    def _text(self, x: str | bytes) -> str:
        if isinstance(x, str):
            if self.kind == "bytes":
                raise TypeError("these patterns are bytes: search a binary column")
            return x
        if self.kind == "str":
            raise TypeError("these patterns are strings: search a string column")
        return bytes(x).decode("latin-1")

    def _found(self, tree, x: str | bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of all occurrences, by end, longest first."""
        hits = list(chain.from_iterable(tree.iter(self._text(x)))) if self.ids else []
        last, ids = (np.array(hits[k::2], np.int64) for k in range(2))
        return ids, last + 1 - self.sizes[ids], last + 1

    def _apply(self, kind: str, each) -> Column:
        """A column of ``each(automaton, text)`` for each text that isn't null."""

        @F.arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tree = self._automaton()
            for b in batches:
                yield pa.array([None if x is None else each(tree, x) for x in b.to_pylist()])

        return run

    def _lists(self, each) -> Column:
        """The same where ``each`` gives ids, starts and ends, which stay arrays all the way."""

        @F.arrow_udf(MATCH)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tree = self._automaton()
            for b in batches:
                found = [None if x is None else each(tree, x) for x in b.to_pylist()]
                ends = np.cumsum([0, *(0 if f is None else len(f[0]) for f in found)]).astype(np.int32)
                some = [f for f in found if f is not None]
                cols = [pa.array(np.concatenate([f[k] for f in some]) if some else np.empty(0, np.int64), pa.int64()) for k in range(3)]
                nulls = pa.array([f is None for f in found], pa.bool_())
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, ["pattern_id", "start", "end"]), mask=nulls)

        return run

    def find_all(self, c: Column | str, *, limit: int | None = None) -> Column:
        """Every occurrence of every pattern, by end, longest first; the first ``limit`` of them."""
        if limit is not None and limit < 0:
            raise ValueError("limit must not be negative")

        def each(tree, x) -> tuple[np.ndarray, ...]:
            if limit is None:
                return self._found(tree, x)
            hits = list(islice(tree.iter(self._text(x)), limit)) if self.ids else []
            last, ids = np.array([h[0] for h in hits], np.int64), np.array([h[1] for h in hits], np.int64)
            return ids, last + 1 - self.sizes[ids], last + 1

        return self._lists(each)(column(c))

    def find_longest(self, c: Column | str) -> Column:
        """Leftmost-longest matches that don't overlap."""

        def each(tree, x) -> tuple[np.ndarray, ...]:
            ids, starts, ends = self._found(tree, x)
            order = np.lexsort((-ends, starts))
            chosen, at = [], 0
            for k, a, b in zip(order.tolist(), starts[order].tolist(), ends[order].tolist()):
                if a >= at:
                    chosen.append(k)
                    at = b
            return ids[chosen], starts[chosen], ends[chosen]

        return self._lists(each)(column(c))

    def count(self, c: Column | str) -> Column:
        return self._apply("bigint", lambda tree, x: sum(1 for _ in tree.iter(self._text(x))) if self.ids else len(self._text(x)) * 0)(column(c))

    def is_match(self, c: Column | str) -> Column:
        """Whether any pattern occurs."""
        c = column(c)
        if not self.ids:
            return F.when(c.isNotNull(), F.lit(False))
        if self.kind == "str" and len(self.ids) <= FEW:
            out = F.lit(False)
            for p in self.ids:
                out = out | F.contains(c, F.lit(p))
            return out
        return self._apply("boolean", lambda tree, x: next(tree.iter(self._text(x)), None) is not None)(c)
