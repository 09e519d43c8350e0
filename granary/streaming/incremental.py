"""Incremental kernels on Structured Streaming: states that merge, ordered hashing, exact dedup."""

from __future__ import annotations

import atexit
import pickle
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.digest import Hasher, parse_algorithm
from ..functions.minhash import MinHasher, fmix32, sha1_hash32


def work_dir(spark: SparkSession) -> str:
    """A new folder that all executors share.  Only a session on one machine may use its own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
    return f"{base.rstrip('/')}/granary-stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's Parquet files as a stream."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # A file source wants a pattern or a folder; the pattern matches just this table.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now.

    ``append`` and ``update`` give the rows of all batches; ``complete`` those of the last one.
    Batches are written to the shared folder under their number, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    where = work_dir(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    # All there is has been read, so the state is not needed again; the rows are, until the result has been.
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/state")
    state.getFileSystem(spark._jsc.hadoopConfiguration()).delete(state, True)
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{where}/out")
    if mode == "complete":
        out = out.filter(F.col("batch") == query.lastProgress["batchId"]) if query.lastProgress else out
    return out.drop("batch")


def signatures(stream: DataFrame, keys: list[str], item: str, hasher: MinHasher) -> DataFrame:
    """A signature per key that grows with the stream: minima are associative, commutative and idempotent."""
    one = stream.select(*keys, fmix32(sha1_hash32(item)).alias("_h"))
    h = F.col("_h")
    low, high = h.bitwiseAND(F.lit(0xFFFF).cast("long")), F.shiftrightunsigned(h, 16)
    m = F.lit((1 << 32) - 1).cast("long")
    mins = [
        F.min((low * F.lit(a).cast("long") + F.shiftleft((high * F.lit(a).cast("long")).bitwiseAND(F.lit(0xFFFF).cast("long")), 16) + F.lit(b).cast("long")).bitwiseAND(m)).alias(f"_{i}")
        for i, (a, b) in enumerate(zip(hasher.a, hasher.b))
    ]
    return one.groupBy(*keys).agg(*mins).select(*keys, F.array(*[f"_{i}" for i in range(hasher.num_perm)]).alias("signature"))


def histograms(stream: DataFrame, keys: list[str], data: str) -> DataFrame:
    """``keys, byte, n``: byte counts add up."""
    pairs = F.regexp_extract_all(F.hex(F.col(data)), F.lit("(..)"), 1)
    each = stream.select(*keys, F.explode_outer(pairs).alias("_b")).filter("_b IS NOT NULL")
    return each.groupBy(*keys, F.conv("_b", 16, 10).cast("long").alias("byte")).agg(F.count(F.lit(1)).alias("n"))


def ordered_digests(stream: DataFrame, key: str, order: str, data: str, algorithm: str = "sha256") -> DataFrame:
    """``key, n_chunks, hexdigest`` after each batch: chunks are held per key, ordered, and hashed as one input.

    Chunks of equal order go by their bytes, as in the batch form; those of null order come first; a null chunk is empty.
    Library hashers can't be stored as state, so the state is the chunks themselves.
    """
    algorithm = parse_algorithm(algorithm)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[tuple[bool, int, bytes]] = pickle.loads(state.get[0]) if state.exists else []
        for b in batches:
            for o, d in zip(b["o"], b["d"]):
                known = not pd.isna(o)
                held.append((known, int(o) if known else 0, b"" if d is None else bytes(d)))
        held.sort()
        state.update((pickle.dumps(held),))
        h = Hasher(algorithm)
        for _, _, d in held:
            h.update(d)
        yield pd.DataFrame({key: [k[0]], "n_chunks": [len(held)], "hexdigest": [h.hexdigest()]})

    own = stream.select(F.col(key), F.col(order).cast("long").alias("o"), F.col(data).alias("d"))
    kind = own.schema[key].dataType.simpleString()
    return own.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n_chunks bigint, hexdigest string", "held binary", "update", GroupStateTimeout.NoTimeout)


def distinct_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; a key is forgotten ``delay`` after it was last due, which bounds the state."""
    # Event time needs a time zone's timestamps; plain ones are taken in the session's zone.
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
