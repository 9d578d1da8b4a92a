"""Readers for chunk, evaluation and training files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata import schemas


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunk arrays: one file, or the ``*_chunks.json`` files of a directory."""
    reader = spark.read.schema(schemas.CHUNK).option("multiLine", "true")
    if not path.endswith(".json"):
        reader = reader.option("pathGlobFilter", "*_chunks.json")
    return reader.json(path)


def load_eval_data(
    spark: SparkSession, path: str, data_format: str, schema: T.StructType = schemas.RAG_SAMPLE,
    num_samples: int = 0, seed: int = 42, key: str | None = None,
) -> DataFrame:
    """Evaluation rows from json, jsonl, csv or parquet, optionally sampled by a seed.

    The sample is by a key column, or by all columns together.
    """
    if data_format == "json":
        df = spark.read.schema(schema).option("multiLine", "true").json(path)
    elif data_format == "jsonl":
        df = spark.read.schema(schema).json(path)
    elif data_format == "csv":
        df = _csv(spark, path, schema)
    elif data_format == "parquet":
        df = spark.read.schema(schema).parquet(path)
    else:
        raise ValueError(f"unsupported data format: {data_format}")
    if num_samples > 0:
        from lodestrata.operators.training import seeded_sample

        if key:
            return seeded_sample(df, num_samples, key, seed)
        return seeded_sample(df.withColumn("_row", F.to_json(F.struct("*"))), num_samples, "_row", seed).drop("_row")
    return df


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns of a csv file by the schema; nested ones are written as JSON."""
    nested = lambda f: isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    flat = T.StructType([T.StructField(f.name, T.StringType() if nested(f) else f.dataType) for f in schema])
    rows = spark.read.schema(flat).option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    return rows.select(*[F.from_json(f.name, f.dataType).alias(f.name) if nested(f) else F.col(f.name) for f in schema])


def load_training_data(
    spark: SparkSession, path: str, schema: T.StructType, text_column: str, order: list[str],
    max_samples: int | None = None,
) -> DataFrame:
    """Training rows with the text column checked and, if asked, the first rows in key order."""
    from lodestrata.operators.training import first_n, require_columns

    df = require_columns(spark.read.schema(schema).json(path), [text_column])
    return df if max_samples is None else first_n(df, max_samples, order)


def load_train_eval_split(
    train: DataFrame, evaluation: DataFrame | None, order: list[str], max_samples: int
) -> tuple[DataFrame, DataFrame | None]:
    """The first rows of each split; the evaluation split gets a tenth of the number."""
    from lodestrata.operators.training import first_n

    held = None if evaluation is None else first_n(evaluation, max_samples // 10, order)
    return first_n(train, max_samples, order), held
