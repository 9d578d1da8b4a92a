"""Writers for chunks, embeddings, training rows and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, fmt: str = "json", partition_by: list[str] | None = None) -> None:
    """Chunks as rows; sources stay a column, so equal file stems cannot overwrite each other."""
    writer = chunks.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_embeddings(embedded: DataFrame, path: str) -> None:
    embedded.select("text", "chunk_index", "metadata", "embedding", "model", "dimension") \
        .write.mode("overwrite").parquet(path)


def write_training_jsonl(rows: DataFrame, path: str) -> dict:
    """JSON lines, with the row count taken while writing; returns the dataset metadata."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("num_samples")).write.mode("overwrite").json(path)
    return {"num_samples": seen.get["num_samples"], "columns": rows.columns}


def append_results(results: DataFrame, path: str, run_ts: str | None = None) -> None:
    """Append evaluation results with the time of the run."""
    stamp = F.lit(run_ts).cast("timestamp") if run_ts else F.current_timestamp()
    results.withColumn("run_ts", stamp).write.mode("append").parquet(path)
