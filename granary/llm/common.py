"""What the operators of this subpackage share: reading tables, cutting lineage, safe column names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The whole table, through Spark's reader, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only a session on one machine gets one of its own where that is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="granary-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    The result has no lineage to recompute when an executor is lost, and its size is known when
    the next plan is made.  Spark deletes the shuffle files of the write when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.granary_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.granary_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def boxed(df: DataFrame, as_name: str = "_row") -> DataFrame:
    """All columns in one struct, so that added columns never clash with those of the input."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(as_name))


class Remembered(dict):
    """A memory of bounded size in two generations: when the younger one is full, the older one goes; what is asked for again becomes young."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
