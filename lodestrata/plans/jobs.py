"""End-to-end jobs: ingestion and evaluation as single lazy plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.chunking import chunker, explode_chunks
from lodestrata.functions.elements import combine_elements, parse_elements
from lodestrata.functions.text import is_blank, record_id
from lodestrata.operators import evaluation
from lodestrata.operators.embedding import EmbeddingModel, embed_chunks, hashing_model
from lodestrata.operators.records import merge_metadata, skip_existing
from lodestrata.session import apply_conf
from lodestrata.sources.documents import read_documents
from lodestrata.sources.vector_table import VectorTable

STRATEGIES = ("fixed", "semantic", "window")


@dataclass(frozen=True)
class IngestConfig:
    source: str
    table: str = ""
    strategy: str = "semantic"
    chunk_size: int = 512
    chunk_overlap: int = 50
    model: EmbeddingModel = field(default_factory=hashing_model)
    skip_existing: bool = True
    source_in_id: bool = False
    dry_run: bool = False

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        if not self.dry_run and not self.table:
            raise ValueError("a table is needed unless it is a dry run")


@dataclass
class IngestResult:
    """The vector records and, after the write, the counters taken while it ran."""

    records: DataFrame
    metrics: dict[str, int]


def vector_records(docs: DataFrame, config: IngestConfig) -> DataFrame:
    """Documents to elements, text, chunks, ids and vectors: one map-only plan without a shuffle."""
    made = parse_elements(F.col("content"), F.col("doc_type"))
    parsed = docs.select(
        "source",
        merge_metadata(F.col("source"), F.col("doc_type"), F.col("metadata")).alias("metadata"),
        combine_elements(made).alias("body"),
    ).filter(~is_blank(F.col("body")))
    cut = chunker(config.strategy, config.chunk_size, config.chunk_overlap)(F.col("body"))
    chunks = explode_chunks(parsed, cut, "source", "metadata")
    key = record_id(F.col("text"), F.col("chunk_index"), F.col("source") if config.source_in_id else None)
    embedded = embed_chunks(chunks.withColumn("id", key), config.model)
    return embedded.select("id", F.col("embedding").alias("vector"), "text", "metadata", "source", "chunk_index")


def ingest(spark: SparkSession, config: IngestConfig) -> IngestResult:
    """Run the ingestion; counters come from the write itself, with no job of their own."""
    apply_conf(spark)
    docs = read_documents(spark, config.source)
    if config.dry_run:
        return IngestResult(vector_records(docs, config), {})
    table = VectorTable(spark, config.table).create()
    loaded, stored = Observation(), Observation()
    docs = docs.observe(loaded, F.count(F.lit(1)).alias("documents_loaded"))
    if config.skip_existing:
        done = table.read().select(F.md5("source").alias("doc_key")).distinct()
        docs = skip_existing(docs, done)
    rows = vector_records(docs, config).observe(
        stored, F.count(F.lit(1)).alias("vectors_stored"), F.count_if(F.col("chunk_index") == 0).alias("documents_chunked"))
    table.insert(rows)
    return IngestResult(table.read(), {**loaded.get, **stored.get})


def evaluate(scores: DataFrame, min_score: float = evaluation.GATE_MIN_SCORE, require_all_passed: bool = True,
             ran: DataFrame | None = None) -> DataFrame:
    """Case scores to one gated row per run: two aggregations and a projection; ``ran`` as in ``overall_score``."""
    means = evaluation.metric_means(scores, ["run", "framework"])
    return evaluation.quality_gate(evaluation.overall_score(means, ran=ran), min_score, require_all_passed)
