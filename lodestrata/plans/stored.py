"""Queries that write a given table with a sink and read it back with a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.plans import inputs
from lodestrata.plans.catalog import query
from lodestrata.plans.corpus import FIXED_CHUNKS_SQL, OVERLAP, SIZE
from lodestrata.functions import chunking
from lodestrata.operators import records
from lodestrata.sources import artifacts, sinks
from lodestrata.sources.documents import read_documents
from lodestrata.sources.vector_table import VectorTable
from lodestrata.streaming.run import new_folder


@query("write_chunks", FIXED_CHUNKS_SQL + """
SELECT doc_id, chunk_index, start_char, end_char, text, 'corpus' AS origin FROM made""")
def write_chunks(t):
    docs, folder = records.drop_empty_documents(inputs.documents(t)), new_folder(t.spark)
    rows = chunking.explode_chunks(docs, chunking.fixed_chunks(F.col("text"), SIZE, OVERLAP), "doc_id").select(
        "text", "chunk_index", "start_char", "end_char",
        F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("origin"), F.lit("corpus")).alias("metadata"))
    sinks.write_chunks(rows, folder)
    made = t.spark.read.schema(schemas.CHUNK).json(folder)
    return made.select(
        F.col("metadata")["doc_id"].cast("long").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start_char", "end_char")],
        "text", F.col("metadata")["origin"].alias("origin"))


@query("write_embeddings", """
SELECT vec_id, label, len(embedding)::BIGINT AS dimension, round(list_sum(list_transform(embedding, lambda x: x::FLOAT::DOUBLE)) + 1e-10, 4) AS total FROM embeddings""")
def write_embeddings(t):
    folder = new_folder(t.spark)
    rows = t.embeddings.select(
        F.col("vec_id").cast("string").alias("text"), F.lit(0).alias("chunk_index"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), F.col("embedding").cast("array<float>").alias("embedding"),
        F.lit("given").alias("model"), F.size("embedding").alias("dimension"))
    sinks.write_embeddings(rows, folder)
    made = t.spark.read.schema(schemas.EMBEDDED_CHUNK).parquet(folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return made.select(
        F.col("text").cast("long").alias("vec_id"), F.col("metadata")["label"].cast(t.embeddings.schema["label"].dataType).alias("label"),
        F.col("dimension").cast("long").alias("dimension"), inputs.rounded(total, 4).alias("total"))


@query("write_training_jsonl", "SELECT doc_id, lang, text FROM documents")
def write_training_jsonl(t):
    rows, folder = t.documents.select("doc_id", "lang", "text"), new_folder(t.spark)
    sinks.write_training_jsonl(rows, folder)
    return artifacts.load_training_data(t.spark, folder, rows.schema, "text", ["doc_id"])


@query("vector_table", """
SELECT vec_id AS id, 'given' AS source FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id AND quality = 0)
UNION ALL SELECT vec_id, 'again' FROM embeddings
  WHERE vec_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id AND quality = 0)""")
def vector_table(t):
    """Create, insert, insert again what is there and what is new, delete, read."""
    table = VectorTable(t.spark, new_folder(t.spark)).create()
    rows = t.embeddings.select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("vector"),
        F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("text"), F.lit("given").alias("source"), F.lit(0).alias("chunk_index"))
    other = rows.filter(F.col("id").cast("long") % 2 == 0).withColumn("source", F.lit("again"))
    table.insert(rows)
    table.insert(rows.unionByName(other).unionByName(other), unique=True)
    table.delete(t.labels.filter("quality = 0").select(F.col("doc_id").cast("string").alias("id")))
    return table.read().select(F.col("id").cast("long").alias("id"), "source")


@query("append_results", """
WITH r AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, n, day FROM r, (VALUES ('2024-01-01'), ('2024-01-02')) d(day)""")
def append_results(t):
    folder = new_folder(t.spark)
    results = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    for day in ("2024-01-01", "2024-01-02"):
        sinks.append_results(results, folder, f"{day} 00:00:00")
    return t.spark.read.parquet(folder).select("lang", "n", F.date_format("run_ts", "yyyy-MM-dd").alias("day"))


@query("load_eval_data", """
WITH s AS (SELECT conv_id || '-' || turn AS question, text AS answer FROM conversations)
SELECT format, question, answer, 2::BIGINT AS contexts FROM s, (VALUES ('jsonl'), ('parquet'), ('csv')) f(format)""")
def load_eval_data(t):
    """The same samples from every format that Spark writes; in csv the contexts are JSON."""
    rows = t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question"), F.col("text").alias("answer"),
        F.array(F.lit("a, \"b\""), F.lit("c")).alias("contexts"), F.lit(None).cast("string").alias("ground_truth"))
    made = None
    for name in ("jsonl", "parquet", "csv"):
        folder = new_folder(t.spark)
        if name == "csv":
            rows.withColumn("contexts", F.to_json("contexts")).write.option("header", "true").option("escape", '"').csv(folder)
        else:
            rows.write.format("json" if name == "jsonl" else name).save(folder)
        part = artifacts.load_eval_data(t.spark, folder, name).select(
            F.lit(name).alias("format"), "question", "answer", F.size("contexts").cast("long").alias("contexts"))
        made = part if made is None else made.unionByName(part)
    return made


@query("scan_local_documents", "SELECT lang, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY lang")
def scan_local_documents(t):
    """Texts as files in a folder per language, each text ended by a line feed; a file is a document of the scan."""
    folder = new_folder(t.spark)
    t.documents.select(F.col("text").alias("value"), "lang").write.partitionBy("lang").text(folder)
    made = read_documents(t.spark, folder)
    lang = F.regexp_extract("source", "lang=([^/]+)/", 1).alias("lang")
    return made.groupBy(lang).agg(F.sum(F.length("content")).cast("long").alias("chars"))
