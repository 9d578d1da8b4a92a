"""Record-level work: validation, filters, ids, anti-joins and dataset profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.blocks import match
from lodestrata.functions.text import doc_id, is_blank, strip


def drop_empty_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.filter(~is_blank(F.col(text)))


def merge_metadata(source: Column, doc_type: Column, metadata: Column) -> Column:
    """``{source, doc_type}`` overlaid with the document's own metadata; its keys win.

    Written with filters, so it does not depend on the session's duplicate-key setting.
    """
    own = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    base = F.create_map(F.lit("source"), source, F.lit("doc_type"), doc_type)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)


def metadata_filter(rows: DataFrame, condition: str | Column) -> DataFrame:
    """Rows meeting a filter expression; use it before a top-k, never after."""
    return rows.filter(F.expr(condition) if isinstance(condition, str) else condition)


def metadata_at(metadata: Column, path: str, kind: str) -> Column:
    """A value of JSON metadata held as VARIANT, at a path such as ``$.stats.pages``, as a type; null where it is absent or of another type."""
    return F.try_variant_get(metadata, path, kind)


def missing_fields(fields: list[str]) -> Column:
    """Names of the required fields that are null or blank."""
    return F.array_compact(F.array(*[
        F.when(F.col(f).isNull() | (strip(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields
    ]))


def validate_required_fields(rows: DataFrame, key: str, fields: list[str], label: str = "Document") -> DataFrame:
    """One message per row and missing field."""
    return rows.select(F.col(key), F.explode(missing_fields(fields)).alias("field")).select(
        key, "field",
        F.concat(F.lit(f"{label} "), F.col(key).cast("string"), F.lit(": missing '"), "field", F.lit("'"))
        .alias("message"),
    )


def valid_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.filter(F.size(missing_fields(fields)) == 0)


def delete_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the least by a digest of all its columns, so that a repeated job picks the same."""
    row = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"_by_{k}") for k in keys]).agg(
        F.min_by(row, F.sha2(F.to_json(row), 256)).alias("_row")).select("_row.*")


def new_rows(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not in the table; one row per key."""
    return match(one_per_key(rows, keys), table.select(*keys).distinct(), keys, "left_anti")


def merge_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table plus the rows whose key is new."""
    return table.unionByName(new_rows(table, rows, [key]).select(*table.columns))


def skip_existing(docs: DataFrame, processed: DataFrame, source: str = "source", key: str = "doc_key") -> DataFrame:
    """Documents whose md5(source) has not been processed."""
    return docs.withColumn(key, doc_id(F.col(source))).join(processed.select(key).distinct(), key, "left_anti")


def join_chunk_embedding(chunks: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """Chunk and vector by record key; positions are not keys in a distributed table."""
    return chunks.join(embeddings, key)


def known_metrics(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested metric names that exist."""
    return requested.join(known.select("metric").distinct(), "metric", "left_semi")


def dataset_profile(rows: DataFrame, text: str, tokens: Column) -> DataFrame:
    """Row count, column count and length statistics in one pass."""
    return rows.agg(
        F.count("*").alias("num_samples"),
        F.lit(len(rows.columns)).cast("long").alias("num_columns"),
        F.sum(F.length(text)).cast("long").alias("total_chars"),
        F.max(F.length(text)).cast("long").alias("max_chars"),
        F.sum(F.size(tokens)).cast("long").alias("total_tokens"),
    )
