"""Streams that keep tables: stopping state per run, and chunks of newly landed documents.

Stopping state is keyed state of the stream; ingestion runs each micro-batch as an ordinary Spark
job whose output is named by batch number and overwritten when a batch is repeated after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestrata.functions.chunking import explode_chunks
from lodestrata.functions.text import doc_id, record_id
from lodestrata.operators.records import drop_empty_documents, one_per_key, skip_existing
from lodestrata.streaming.alerts import keyed_state
from lodestrata.streaming.run import append_stream


def _last_batch(spark: SparkSession, folder: str, before: int | None = None) -> int:
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    batches = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
    return max((b for b in batches if before is None or b < before), default=-1)


def _start(df: DataFrame, folder: str, step, available_now: bool):
    writer = df.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


class StoppingState(StatefulProcessor):
    """Per run: evaluations, best value, misses since, last step, and the step that stopped it.

    A micro-batch brings a run no more rows than its trigger admits; they are put in order here.
    """

    def __init__(self, patience: int, threshold: float, sign: float):
        self.patience, self.threshold, self.sign = patience, threshold, sign

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "evaluations long, best double, misses long, last_step long, stop_step long, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [part[["step", "metric"]].dropna() for part in rows]
        batch = pd.concat(parts).sort_values("step")
        if not len(batch):
            return
        n, best, misses, last, stop, stopped = self.run.get() if self.run.exists() else (0, None, 0, None, None, False)
        for step, value in zip(batch["step"].tolist(), (batch["metric"] * self.sign).tolist()):
            n, last = n + 1, step
            if stopped:
                continue
            if best is None or value < best - self.threshold:
                best, misses = value, 0
            else:
                misses += 1
                if misses >= self.patience:
                    stop, stopped = step, True
        self.run.update((n, best, misses, last, stop, stopped))
        made = pd.DataFrame([(*key, n, best * self.sign, misses, last, stop, stopped)], columns=["run_id", *STOPPING])
        yield made.astype({"stop_step": "Int64"})

    def close(self) -> None:
        pass


STOPPING = ("evaluations", "best", "misses", "last_step", "stop_step", "stopped")


def stream_early_stopping(evals: DataFrame, folder: str, available_now: bool = True, patience: int = 3, threshold: float = 0.0,
                          greater_is_better: bool = False, partitions: int | None = None):
    """Keep the stopping state of every run up to date; options as for the batch operator.

    State lives with the stream, keyed by run: a micro-batch reads, writes and appends the states of the
    runs it has evaluations of and no others. The steps of a run must not arrive in an earlier batch than their predecessors.
    """
    keyed_state(evals.sparkSession)
    kind = evals.schema["run_id"].dataType.simpleString()
    rows = evals.select("run_id", F.col("step").cast("long").alias("step"), F.col("metric").cast("double").alias("metric"))
    made = rows.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=StoppingState(patience, threshold, -1.0 if greater_is_better else 1.0),
        outputStructType=f"run_id {kind}, evaluations long, best double, misses long, last_step long, stop_step long, stopped boolean",
        outputMode="Append", timeMode="None")
    return append_stream(made, folder, available_now, partitions)


def stopping_state(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of each run: the one that has seen most evaluations."""
    made = spark.read.parquet(f"{folder}/out")
    return made.groupBy("run_id").agg(F.max_by(F.struct(*STOPPING), "evaluations").alias("_s")).select("run_id", "_s.*")


# Folders of the seen-sources table; a micro-batch reads those of its own sources only.
SEEN_BUCKETS = 256


def stream_ingest(docs: DataFrame, folder: str, chunks: Column, available_now: bool = True):
    """Chunk documents as they land and append records; a source seen before is skipped.

    Sources are kept as bare keys in folders by key hash, those without any chunk included, so
    a micro-batch looks up its sources in a small table and never reads the records again.
    """
    bucket = F.pmod(F.xxhash64("doc_key"), F.lit(SEEN_BUCKETS)).cast("int")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        touched = [r[0] for r in rows.select(doc_id(F.col("source")).alias("doc_key")).select(bucket).distinct().collect()]
        if _last_batch(spark, f"{folder}/seen", number) < 0:
            done = spark.createDataFrame([], "doc_key string")
        else:
            done = spark.read.schema("doc_key string, batch int, bucket int").parquet(f"{folder}/seen").filter(
                (F.col("batch") < number) & F.col("bucket").isin(touched)).select("doc_key")
        fresh = skip_existing(one_per_key(rows, ["source"]), done)
        made = explode_chunks(drop_empty_documents(fresh), chunks, "source", "doc_key").withColumn(
            "id", record_id(F.col("text"), F.col("chunk_index")))
        made.write.mode("overwrite").parquet(f"{folder}/records/batch={number}")
        fresh.select("doc_key", bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/seen/batch={number}")
        rows.unpersist()

    return _start(docs, folder, step, available_now)


def ingested(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/records")


def stream_ingest_within(docs: DataFrame, folder: str, chunks: Column, within: str = "1 day", available_now: bool = True, partitions: int | None = None):
    """Chunk documents as they land; a source that comes again within a time of ``landed_at`` is dropped.

    The sources seen are keyed state that expires with the watermark, so neither state nor work
    of a micro-batch grows with the history. For sources that may come again at any time use ``stream_ingest``.
    """
    fresh = docs.withWatermark("landed_at", within).dropDuplicatesWithinWatermark(["source"])
    keyed = drop_empty_documents(fresh.withColumn("doc_key", doc_id(F.col("source"))))
    made = explode_chunks(keyed, chunks, "source", "doc_key").withColumn("id", record_id(F.col("text"), F.col("chunk_index")))
    return append_stream(made, folder, available_now, partitions)
