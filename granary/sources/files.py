"""Files as rows, and digests of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import Hasher, hex_digest


def read_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, length, content`` of files; missing paths are an error.  Spark lists no empty files."""
    return spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "length", "content")


def hash_file(spark: SparkSession, algorithm: str, path: str) -> str:
    found = spark.read.format("binaryFile").load(path)
    # A folder is found out by its names, before any content is read.
    if len(found.select("path").limit(2).collect()) > 1:
        raise IsADirectoryError(path)
    rows = found.select(hex_digest(algorithm, "content")).collect()
    return rows[0][0] if rows else Hasher(algorithm).hexdigest()


def hash_files(spark: SparkSession, algorithm: str, paths: Sequence[str]) -> DataFrame:
    """``position, path, hexdigest`` in the order of ``paths``; the first one that can't be read is an error."""
    order = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "position bigint, wanted string")
    found = read_files(spark, paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), hex_digest(algorithm, "content").alias("hexdigest"))
    return order.join(found, F.regexp_replace("wanted", "^file:/*", "/") == F.col("path"), "left").select("position", F.col("wanted").alias("path"), F.coalesce("hexdigest", F.lit(Hasher(algorithm).hexdigest())).alias("hexdigest")).orderBy("position")


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
