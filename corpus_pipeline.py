"""From raw documents to token files: the stages of the corpus pipeline, each on what the last one kept.

Defined results: a null or blank text fails the quality rules; a null doc_id is a document like any other, the
first of its class and the first of the files; repeated rows, and rows of one doc_id with equal or near texts, are
one class, of which one row stays, while different texts under one doc_id stay apart; extra columns of any name
travel to the last stage, which returns what the files say of each document; an empty table, or a stage that
keeps nothing, gives an empty result with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, mixing, pretokens, quality_rules, simhash, token_files
from lodestrata.llm.queries import MIX
from lodestrata.session import apply_conf, checkpoint_dir


# All clean text there is; the quality rules leave less poor text than its share asks for.
REACH = 1.0


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet every quality rule."""
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def unseen_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the fitted mixture says; at a highest rate of 1 none is repeated."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MIX, reach=REACH)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what they say of each: start, tokens, checksum."""
    manifest = token_files.write_tokens(docs, checkpoint_dir(spark), pretokens.tokenizer_path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, manifest, docs.schema["doc_id"].dataType.simpleString())


STAGES = [
    ("quality rules", good_only),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", unseen_only),
    ("mixing sources to target weights", to_weights),
    ("token-ID / binary output", to_tokens),
]

# Fingerprints, the fitted mixture and the token files are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written in the shared folder and read again."""
    apply_conf(spark)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
