"""Catalog records: JSON files in, JSON files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCALES = ("ja", "zh", "ko", "es", "fr", "de", "pt")
_TRANSLATION = "STRUCT<title: STRING, description: STRING>"
PART_SCHEMA = f"""
name STRING, title STRING, description STRING, version STRING, added DATE, sample BOOLEAN, shelves ARRAY<STRING>,
rust STRUCT<files: ARRAY<STRING>, dependencies: ARRAY<STRUCT<name: STRING, version: STRING, features: ARRAY<STRING>>>>,
python STRUCT<package: STRING, import_path: STRING>,
reference STRUCT<name: STRING, language: STRING, version: STRING, url: STRING>,
verification STRUCT<method: STRING, cases: BIGINT, passed: BIGINT, last_run: TIMESTAMP>,
benchmarks ARRAY<STRUCT<input_size: BIGINT, rust_ms: DOUBLE, reference_ms: DOUBLE>>,
environment STRUCT<cpu: STRING, os: STRING, rust: STRING, reference_runtime: STRING>,
input_unit STRING, usage STRUCT<rust: STRING, python: STRING>,
translations STRUCT<{", ".join(f"{l}: {_TRANSLATION}" for l in LOCALES)}>
"""


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """One row per JSON file, with ``file`` (its name), in file order; malformed files and empty folders are errors."""
    parts = spark.read.schema(PART_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    if parts.isEmpty():
        raise FileNotFoundError(f"no catalog files in {folder}")
    return parts.orderBy("file")


def publish(parts: DataFrame, index: DataFrame, folder: str, schema_ref: str = "../schema/part.schema.json") -> None:
    """Write ``<name>`` folders of pretty JSON for each part, and ``index``.  A catalog is small; Spark still writes it."""
    own = parts.drop("file", "$schema")
    body = own.withColumn("$schema", F.lit(schema_ref)).select("name", F.to_json(F.struct(F.col("`$schema`"), *[F.col(f"`{c}`") for c in own.columns]), {"pretty": "true"}).alias("value"))
    body.repartition("name").write.mode("overwrite").partitionBy("name").text(f"{folder}/parts")
    whole = index.agg(F.sort_array(F.collect_list(F.struct("name", *[c for c in index.columns if c != "name"]))).alias("parts"))
    whole.select(F.to_json(F.struct("parts"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/index")
