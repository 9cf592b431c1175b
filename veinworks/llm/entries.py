"""The registered queries of this subpackage: one for each operator, thin, over
whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, chat_tree, jaccard_join, language_id, packing, prefix_bpe, token_store, topk, toxicity, weak_rules
from .common import doc_remainder, documents

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_store.write_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), kind="byte", end_id=0)
    return token_store.read_tokens(shards).withColumnRenamed("key", "doc_id")


def op2_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat_tree.digests(chat_tree.build(rows.unionByName(extra)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    network = language_id.train(docs, modulus=5)
    found = language_id.predict(docs.select("doc_id", "text"), network)
    return found.select("doc_id", (doc_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "agreeing")


def op4_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(documents(spark, sf_dir, "doc_id", "text"))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op6_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, scale=1024.0, every=100)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), modulus=5)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (doc_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), end_id=1, capacity=4096)
    return packed.withColumn("length", F.col("length").cast("long"))


def op9_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(documents(spark, sf_dir, "doc_id", "text"), modulus=7, remainder=2)


def op10_part_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(documents(spark, sf_dir, "doc_id", "text"), n=3, p=90, q=100)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_prefix_tree, op3_language_id, op4_weak_rules, op5_prefix_bpe, op6_uniform_threshold, op7_toxicity, op8_best_fit_packing, op9_backoff_automaton, op10_part_enum, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op6_uniform_threshold": OP6_SQL}
