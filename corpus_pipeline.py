"""The training-data pipeline: five stages over ``documents``, each one operator of ``granary.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import load, materialize
from granary.llm.exact_dedup import exact_dedup
from granary.llm.ordinal_quality import score_quality
from granary.llm.poisson_mix import poisson_mix
from granary.llm.queries import MIX_SEED, SENTENCEPIECE_MODEL, ratings
from granary.llm.sentencepiece_codec import encode_documents
from granary.llm.simhash import near_duplicates, row_key

#: Near duplicates: a Jaccard similarity of the sets of five-word shingles of at least this.
SIMILARITY, SHINGLE_WORDS = 0.8, 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null texts count as empty and are judged like any other; repeated rows share their fate; without ratings of two grades, and in an empty table,
    nothing is rejected.  Extra columns stay as they are.
    """
    return score_quality(docs, ratings(spark, sf_dir)).filter("kept").select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays; null texts equal empty ones.

    Of rows that also share the id one stays, by its whole content; rows without an id stay only where no equal text has one, and then one of them.
    """
    return exact_dedup(docs).filter("kept").select("_row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows without an id stay.

    Fingerprints give the candidates; what links is the similarity of the shingles themselves.  Rows go by id and text, so a row that only shares
    its id with another has its own fate; of rows equal in both, which exact dedup leaves none of, one stays.
    """
    groups = near_duplicates(docs, SIMILARITY, SHINGLE_WORDS)
    gone = groups.filter("key <> keep_key").select(F.col("key").alias("_gone")).distinct()
    key = row_key()
    left = docs.join(gone, (key == F.col("_gone")) & F.col("doc_id").isNotNull(), "left_anti")
    repeats = materialize(left.filter("doc_id IS NOT NULL").groupBy(key.alias("_key")).count().filter("count > 1").select("_key"), "repeats")
    if repeats.isEmpty():
        return left.select(*docs.columns)
    again = left.join(repeats, (key == F.col("_key")) & F.col("doc_id").isNotNull(), "left_semi")
    once = left.join(repeats, (key == F.col("_key")) & F.col("doc_id").isNotNull(), "left_anti")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources weigh the same; as many rows out as in, on average, in a global random order.

    The null source is one like any other; rows that share an id share the number of copies, rows without an id draw by their content.
    """
    return poisson_mix(docs, seed=MIX_SEED).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with proof that they decode to its text.  A null text has none; repeated rows are repeated."""
    return encode_documents(docs, SENTENCEPIECE_MODEL)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("tokens", tokens)]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
