"""Starting streams and running them over what is there."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lodestrata.session import checkpoint_dir


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for state and output in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


@contextmanager
def state_partitions(spark: SparkSession, partitions: int | None):
    """Start a query with so many state partitions, or the session's shuffle partitions.

    The number is fixed when a query first starts and holds for its life, so it is the
    caller's to choose for the stream's volume: a store per partition is opened and committed
    in every micro-batch.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(partitions or before))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def append_stream(df: DataFrame, folder: str, available_now: bool = True, partitions: int | None = None):
    """Write a stream to Parquet, exactly once, with its log beside the output."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/log")
    if available_now:
        writer = writer.trigger(availableNow=True)
    with state_partitions(df.sparkSession, partitions):
        return writer.start(f"{folder}/out")


def run_available(df: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Drain the source and give the written rows."""
    append_stream(df, folder, partitions=partitions).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")
