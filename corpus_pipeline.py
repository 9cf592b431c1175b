"""A corpus pipeline of four operators, over the documents table.

Language ID lets go what has no language, toxicity what is toxic, the Jaccard
join keeps one document of each group of near duplicates, and packing lays the
rest out in training sequences. Every stage reads what its predecessor wrote;
all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinworks.llm import jaccard_join, language_id, packing, toxicity
from veinworks.llm.common import materialise

#: Language ID rejects `und` and texts whose pooled probability is under this many
#: times that of a guess among the learned languages.
LEAST_LIFT = 1.2
#: Near duplicates share four fifths of their five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language. Null and letterless texts go, and with
    no label to learn from all; repeated rows are judged each; an empty table stays
    empty."""
    network = language_id.train(docs)
    found = language_id.predict(docs, network, outputs=("__language", "__language_score", "__agreeing"))
    least = min(0.9, LEAST_LIFT / len(network.languages)) if network else 1.0
    kept = (F.col("__language") != language_id.UNKNOWN) & (F.col("__language_score") >= least)
    return found.where(kept).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, finds not toxic.
    Null texts score as empty ones; repeated rows are judged each."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, output="__toxicity")
    return scored.where(F.col("__toxicity") < 0.5).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id, once;
    rows without an id, and rows without a word, stay. Of unequal rows of one id the
    one of least hash stays."""
    found = jaccard_join.join_components(docs, SHINGLE_WORDS, *SIMILARITY)
    chosen = found.where("doc_id = component_id").select("doc_id").distinct()
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    named = docs.where("doc_id is not null").join(chosen, "doc_id", "left_semi")
    row = F.struct(*docs.columns)
    one = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64(F.to_json(row)))).alias("row")).select("row.*")
    single = named.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(one).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens; a null text is
    the end token alone; other columns are left behind."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("toxicity", clean),
    ("jaccard_join", distinct),
    ("packing", packed),
]

#: Networks, classifiers and packing are not SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
