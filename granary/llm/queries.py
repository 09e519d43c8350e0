"""The queries of this subpackage for the driver, with their SQL where SQL can express them."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_conversations, loss_text, parse_formatted
from .common import load
from .exact_dedup import exact_dedup
from .html_extract import extract_pages
from .maxscore import search
from .ordinal_quality import grade_of, score_quality
from .poisson_mix import poisson_mix
from .secret_scan import scan_secrets
from .sentencepiece_codec import encode_documents
from .simhash import simhash_components
from .suffix_dedup import remove_repeats

#: The conversation that the formatting query adds to its table.
PROBE_TEXT = "</s>[INST] ok [/INST]"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").select(F.col("doc_id").alias("rated_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, ratings(spark, sf_dir)).select(F.col("_row.doc_id").alias("doc_id"), "expected_grade", "tail_probability", "kept")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -1L conv_id, CAST(id AS BIGINT) turn, IF(id = 0, 'user', 'assistant') role, '{PROBE_TEXT}' text FROM range(2)")
    done = format_conversations(turns.unionByName(probe)).select("conv_id", "formatted", "n_attachment_tokens", parse_formatted(F.col("formatted")).alias("ts"))
    loss = loss_text(F.col("ts"))
    return done.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE_TEXT}'
  UNION ALL SELECT -1, 1, 'assistant', '{PROBE_TEXT}'
), e AS (
  SELECT *, regexp_replace(text, '(<|\[)(\\*)(\||/?s>|</?SYS>>|/?INST\])', '\1\2\\\3', 'g') AS et,
         regexp_replace(role, '(<|\[)(\\*)(\||/?s>|</?SYS>>|/?INST\])', '\1\2\\\3', 'g') AS er FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|start|>' || er || '<|body|>' || et || '<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select(F.col("_row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: Production parameters of mixing: every source weighs the same, as many rows out as in.
MIX_SEED = 17


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return poisson_mix(docs, seed=MIX_SEED).select("_row.*", "copy", "n_copies", "shuffle_key")


OP6_SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, CAST((SELECT sum(n) FROM sizes) AS DOUBLE) * 1.0 / CAST((SELECT count(*) FROM sizes) AS DOUBLE) / n AS rate FROM sizes),
parts AS (SELECT source, greatest(CAST(ceil(rate / 16.0) AS BIGINT), 1) AS parts, rate FROM rates),
terms AS (SELECT source, k, exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1) AS p FROM parts, range(0, 97) t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms WHERE k < 96),
draws AS (
  SELECT d.doc_id, d.source, j, CAST(('0x' || substr(md5('{MIX_SEED}:' || CAST(d.doc_id AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS j)
),
counts AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_copies FROM (
    SELECT w.doc_id, w.j, count(c.k) AS n FROM draws w LEFT JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND c.c <= w.u GROUP BY ALL
  ) GROUP BY doc_id
)
SELECT d.*, copy, n_copies, md5('order{MIX_SEED}:' || CAST(d.doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM documents d JOIN counts USING (doc_id), LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy)
WHERE n_copies > 0
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(load(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "markov")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Where the model file lies; a parameter of the operator.
SENTENCEPIECE_MODEL = os.environ.get("GRANARY_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents").select("doc_id", "text"), SENTENCEPIECE_MODEL)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash_components(docs, width=3, budget=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    cut = remove_repeats(docs, depth=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if re.match(r"op\d+_", k)}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, sql in {"op3_chat_format": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_poisson_mix": OP6_SQL, "op7_maxscore": OP7_SQL}.items()}
