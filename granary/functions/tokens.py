"""Counting byte-pair tokens, with a rank file that the user supplies."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

#: Fixed value: the widely published split pattern of byte-level vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TokenCounter:
    def __init__(self, rank_file: str, pattern: str = SPLIT):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = pattern

    def count(self, text: Column | str) -> Column:
        ranks, pattern = self.ranks, self.pattern

        @F.pandas_udf("bigint")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import tiktoken

            codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for s in batches:
                yield pd.Series([None if x is None else len(codec.encode_ordinary(x)) for x in s], dtype="Int64")

        return run(column(text))
