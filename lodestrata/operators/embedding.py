"""Embedding as an Arrow job: a model turns batches of text into unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Tuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.blocks import match
from lodestrata.functions.text import word_tokens

DEFAULT_DIMENSION = 384
# Texts per call of a neural model.
DEFAULT_BATCH = 32
# Texts per call of the hashing model, whose dense rows are all that a worker holds at once.
HASHED_BATCH = 512


@dataclass(frozen=True)
class EmbeddingModel:
    """``prepare`` turns text into what ``load()`` accepts, inside the JVM.

    ``load`` runs once per Python worker and returns a function from a pandas Series of
    prepared values to a float matrix with one row per value. It sees ``batch`` values at a
    time, or a whole Arrow batch if that is None.
    """

    name: str
    dimension: int
    prepare: Callable[[Column], Column]
    load: Callable[[], Callable[[pd.Series], np.ndarray]]
    batch: int | None = DEFAULT_BATCH


def token_slots(dimension: int) -> Callable[[Column], Column]:
    """Text to one slot number per token: the first 32 bits of the token's md5, modulo the dimension."""
    def prepare(text: Column) -> Column:
        head = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")
        return F.transform(word_tokens(text), lambda t: (head(t) % dimension).cast("int"))
    return prepare


def hashing_model(dimension: int = DEFAULT_DIMENSION, batch: int | None = HASHED_BATCH) -> EmbeddingModel:
    """Hashed bag of words, scaled to unit length: deterministic and needs no files."""
    def load():
        def embed(slots: pd.Series) -> np.ndarray:
            out = np.zeros(len(slots) * dimension)
            if len(slots):
                sizes = np.fromiter((len(s) for s in slots), dtype=np.int64, count=len(slots))
                if sizes.sum():
                    flat = np.concatenate([np.asarray(s, dtype=np.int64) for s in slots if len(s)])
                    rows = np.repeat(np.arange(len(slots)), sizes)
                    out = np.bincount(rows * dimension + flat, minlength=out.size).astype(float)
            matrix = out.reshape(len(slots), dimension)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            return np.divide(matrix, norms, out=matrix, where=norms > 0)
        return embed

    return EmbeddingModel(f"hashing-{dimension}", dimension, token_slots(dimension), load, batch)


def _vectors(run: Callable[[pd.Series], np.ndarray], prepared: pd.Series) -> pd.Series:
    filled = prepared.map(lambda v: () if v is None else v)
    return pd.Series(list(run(filled).astype(np.float32)), dtype=object)


def vector_udf(model: EmbeddingModel):
    """The model as an iterator UDF over its prepared column; vectors leave as they are made, ``batch`` at a time."""
    load, size = model.load, model.batch

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()
        for batch in batches:
            step = size or max(len(batch), 1)
            for i in range(0, len(batch), step):
                yield _vectors(run, batch.iloc[i:i + step])

    # keeps the optimizer from calling the model a second time inside a pushed-down filter
    return embed.asNondeterministic()


def vectors_udf(model: EmbeddingModel, names: list[str]):
    """The model over several prepared columns of a row in one worker: a struct with one vector per name."""
    load, size = model.load, model.batch

    @F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.FloatType())) for n in names]))
    def embed(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        run = load()
        for columns in batches:
            step = size or max(len(columns[0]), 1)
            for i in range(0, len(columns[0]), step):
                yield pd.DataFrame({n: _vectors(run, c.iloc[i:i + step]) for n, c in zip(names, columns)})

    return embed.asNondeterministic()


def embed_chunks(
    chunks: DataFrame, model: EmbeddingModel | None = None, text: str = "text", partitions: int | None = None
) -> DataFrame:
    """Add ``embedding``, ``model`` and ``dimension``; each row keeps its own vector.

    ``partitions`` spreads a model that is much dearer than the scan over more tasks.
    """
    model = model or hashing_model()
    rows = chunks.repartition(partitions) if partitions else chunks
    prepared = model.prepare(F.col(text))
    return rows.select(
        "*",
        vector_udf(model)(prepared).alias("embedding"),
        F.lit(model.name).alias("model"),
        F.lit(model.dimension).alias("dimension"),
    )


def embed_distinct(chunks: DataFrame, model: EmbeddingModel | None = None, text: str = "text") -> DataFrame:
    """Embed each distinct text once and join the vector back.

    Copies are merged map-side (a plain DISTINCT, which hashes and does not sort the texts)
    before the model runs. The join back is from many chunks to
    one vector per text, null texts among them; a text owning a third of the chunks is split by the adaptive skew
    join, since the vector side has a single row for it.
    """
    key = F.sha2(F.col(text), 256).alias("_text_key")
    keyed = chunks.select("*", key)
    vectors = embed_chunks(chunks.select(text).distinct().select(text, key), model, text).drop(text)
    return match(keyed, vectors, ["_text_key"], "left").drop("_text_key")
