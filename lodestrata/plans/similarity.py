"""Queries over vectors: arithmetic, search, table changes and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import vectors
from lodestrata.operators import embedding, lsh, records, search
from lodestrata.plans import inputs
from lodestrata.plans.catalog import query
from lodestrata.plans.inputs import rounded, tokens_sql
from lodestrata.session import checkpoint_dir

K = 10


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _label_centres(t):
    """One query vector per label, the mean of its members."""
    return vectors.mean_pool(_vectors(t), ["label"]).withColumnRenamed("label", "query_id")


CENTRES_SQL = """
parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(x) AS x FROM parts GROUP BY ALL),
centres AS (SELECT label AS query_id, list(x ORDER BY pos) AS centre FROM means GROUP BY label)"""

SCORED_SQL = f"""
WITH {CENTRES_SQL},
scored AS (SELECT query_id, vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], centre), 9) AS score
           FROM embeddings, centres),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
"""


@query("mean_pool", """
WITH parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos,
                      CASE WHEN embedding[1] > 0 THEN 1.0 ELSE 0.0 END AS w FROM embeddings)
SELECT label, pos - 1 AS pos, round(sum(x * w) / greatest(sum(w), 1e-9) + 1e-10, 6) AS x FROM parts GROUP BY label, pos""")
def mean_pool(t):
    masked = _vectors(t).withColumn("mask", (F.col("vector")[0] > 0).cast("int"))
    pooled = vectors.mean_pool(masked, ["label"], mask="mask")
    return pooled.select("label", F.posexplode("vector").alias("pos", "x")).select(
        "label", F.col("pos").cast("long").alias("pos"), rounded("x").alias("x"))


@query("l2_normalize", """
WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings),
normed AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos, sqrt(list_dot_product(v, v)) AS n FROM scaled)
SELECT vec_id, pos - 1 AS pos, round(x / n + 1e-10, 6) AS x FROM normed""")
def l2_normalize(t):
    scaled = F.transform(vectors.as_double(F.col("embedding")), lambda x: x * (F.col("label") + 1))
    unit = t.embeddings.select("vec_id", vectors.l2_normalize(scaled).alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), rounded("x").alias("x"))


@query("cosine_similarity", f"""
WITH {CENTRES_SQL}
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], centre) + 1e-10, 6) AS score
FROM embeddings JOIN centres ON query_id = label""")
def cosine_similarity(t):
    """Each vector against the centre of its own label."""
    centres = _label_centres(t).select(F.col("query_id").alias("label"), F.col("vector").alias("centre"))
    return _vectors(t).join(centres, "label").select(
        "id", rounded(vectors.cosine_similarity(F.col("vector"), F.col("centre"))).alias("score"))


WHOLE_SQL = """
WITH parts AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT pos, avg(x) AS x FROM parts GROUP BY ALL),
q AS (SELECT list(x ORDER BY pos) AS centre FROM means)
SELECT vec_id AS id, label, round(score + 1e-10, 6) AS score FROM (
  SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], centre), 9) AS score FROM embeddings, q {where})
ORDER BY score DESC, id LIMIT 10"""


def _search_whole(t, condition=None):
    rows = _vectors(t)
    target = vectors.mean_pool(rows, []).first()["vector"]
    return search.vector_search(rows, target, K, condition).select("id", "label", rounded("score").alias("score"))


@query("vector_search", WHOLE_SQL.format(where=""))
def vector_search(t):
    """The vectors nearest to the mean of the whole table."""
    return _search_whole(t)


@query("vector_search_filtered", WHOLE_SQL.format(where="WHERE label = 3"))
def vector_search_filtered(t):
    return _search_whole(t, "label = 3")


@query("vector_search_variant", """
WITH rows AS (SELECT vec_id, embedding, label, json_object('tag', 'v' || label, 'stats', json_object('label', label, 'first', embedding[1]::DOUBLE)) AS metadata FROM embeddings),
parts AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
whole AS (SELECT list(x ORDER BY pos) AS centre FROM (SELECT pos, avg(x) AS x FROM parts GROUP BY pos))
SELECT vec_id AS id, label, round(score + 1e-10, 6) AS score FROM (
  SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], centre), 9) AS score FROM rows, whole
  WHERE json_extract(metadata, '$.stats.label')::INT BETWEEN 2 AND 6 AND json_extract(metadata, '$.stats.first')::DOUBLE > 0
    AND json_extract_string(metadata, '$.tag') <> 'v4')
ORDER BY score DESC, id LIMIT 10""")
def vector_search_variant(t):
    """Typed conditions on nested JSON metadata, tested before the top-k."""
    rows = _vectors(t).withColumn("metadata", F.parse_json(F.to_json(F.struct(
        F.concat(F.lit("v"), "label").alias("tag"), F.struct("label", F.col("vector")[0].cast("double").alias("first")).alias("stats")))))
    at = lambda path, kind: records.metadata_at(F.col("metadata"), path, kind)
    wanted = at("$.stats.label", "int").between(2, 6) & (at("$.stats.first", "double") > 0) & (at("$.tag", "string") != "v4")
    target = vectors.mean_pool(_vectors(t), []).first()["vector"]
    return search.vector_search(rows, target, K, wanted).select("id", "label", rounded("score").alias("score"))


BATCH_SQL = SCORED_SQL + f"SELECT query_id, id, round(score + 1e-10, 6) AS score, rank FROM ranked WHERE rank <= {K}"


def _hits(df):
    return df.select("query_id", "id", rounded("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_search_batch", BATCH_SQL)
def vector_search_batch(t):
    return _hits(search.vector_search_batch(_vectors(t), _label_centres(t), K))


@query("vector_search_cells", BATCH_SQL)
def vector_search_cells(t):
    """The cell index with the exact finish gives the exact answer."""
    index = search.build_cells(_vectors(t), n_cells=8)
    return _hits(search.search_cells(index, _label_centres(t), K, nprobe=2, exact=True))


@query("vector_search_ann", f"""
WITH {CENTRES_SQL},
asked AS (SELECT 'label ' || query_id AS query_id FROM centres UNION ALL SELECT 'row ' || vec_id FROM embeddings WHERE vec_id % 100 = 0),
size AS (SELECT least({K}, count(*)) AS wanted FROM embeddings)
SELECT query_id, wanted, true AS recalled, true AS recalled_on_average FROM asked, size""")
def vector_search_ann(t):
    """Whether the hash index finds at least 0.9 of each query's exact hits, and 0.95 on average.

    Queries are the label centres and every row whose id is divisible by 100.
    """
    rows = _vectors(t)
    queries = _label_centres(t).select(F.concat(F.lit("label "), "query_id").alias("query_id"), "vector").unionAll(
        rows.filter("id % 100 = 0").select(F.concat(F.lit("row "), "id"), vectors.as_double(F.col("vector"))))
    # the queries, the exact hits and the recalls are each read more than once
    checkpoint_dir(rows.sparkSession)
    queries = queries.checkpoint()
    exact = search.vector_search_batch(rows, queries, K).checkpoint()
    found = lsh.search_signs(lsh.build_sign_index(rows), queries, K)
    recall = search.recall_at_k(found, exact, K).join(exact.groupBy("query_id").agg(F.count("*").alias("wanted")), "query_id").checkpoint()
    mean = recall.agg(F.avg("recall").alias("mean"))
    return recall.crossJoin(mean).select(
        "query_id", "wanted", (F.col("recall") >= 0.9).alias("recalled"), (F.col("mean") >= 0.95).alias("recalled_on_average"))


@query("retrieve_contexts", SCORED_SQL + f"""
SELECT query_id, count(*) AS n, md5(string_agg(text, E'\\n' ORDER BY rank)) AS digest
FROM ranked JOIN documents ON doc_id = id WHERE rank <= {K} GROUP BY query_id""")
def retrieve_contexts(t):
    hits = search.vector_search_batch(_vectors(t), _label_centres(t), K)
    found = search.retrieve_contexts(hits, t.documents.select(F.col("doc_id").alias("id"), "text"))
    return found.select("query_id", F.size("contexts").cast("long").alias("n"),
                        F.md5(F.array_join("contexts", "\n")).alias("digest"))


@query("join_chunk_embedding", """
SELECT doc_id, n_chars, label, len(embedding)::BIGINT AS dimension FROM documents JOIN embeddings ON vec_id = doc_id""")
def join_chunk_embedding(t):
    docs = t.documents.select("doc_id", "n_chars")
    vecs = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").cast("long").alias("dimension"))
    return records.join_chunk_embedding(docs, vecs, "doc_id").select("doc_id", "n_chars", "label", "dimension")


@query("vector_insert", """
SELECT doc_id AS id, false AS fresh FROM labels
UNION ALL SELECT vec_id, true FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)""")
def vector_insert(t):
    """Insert all vectors into a table that holds the labelled ones."""
    table = t.labels.select(F.col("doc_id").alias("id"), F.lit(False).alias("fresh"))
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(True).alias("fresh"))
    return records.merge_new(table, rows, "id")


@query("vector_delete", """
SELECT vec_id AS id, label FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id AND quality = 0)""")
def vector_delete(t):
    drop = t.labels.filter("quality = 0").select(F.col("doc_id").alias("id"))
    return records.delete_ids(_vectors(t), drop, "id").select("id", "label")


@query("vector_count", "SELECT count(*) AS entities, count(DISTINCT label) AS labels FROM embeddings")
def vector_count(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("entities"), F.count("*").alias("labels"))


# -- embedding -----------------------------------------------------------------------


def embedded_sql(source: str, key: str) -> str:
    """Hashed unit vectors of texts as (key, slot, value) rows."""
    return f"""
tokens AS (SELECT {key}, unnest({tokens_sql('text')}) AS w FROM {source}),
counts AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS slot, count(*) AS c FROM tokens GROUP BY ALL),
slots AS (SELECT {key}, slot, (c / sqrt(sum(c * c) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v FROM counts)"""


def _fingerprint(df, *keys):
    v = vectors.as_double(F.col("embedding"))
    weighted = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return df.select(*keys, F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("slots"),
                     F.round(weighted, 3).alias("fingerprint"))


FINGERPRINT_SQL = "count(*) AS slots, round(sum(v * (slot + 1)), 3) AS fingerprint FROM slots"
DOC_SQL = f"WITH {embedded_sql('documents', 'doc_id')} SELECT doc_id, {FINGERPRINT_SQL} GROUP BY doc_id"


@query("embed_chunks", DOC_SQL)
def embed_chunks(t):
    return _fingerprint(embedding.embed_chunks(inputs.documents(t)), "doc_id").filter("slots > 0")


@query("embed_distributed", DOC_SQL)
def embed_distributed(t):
    """The same model with the rows spread over a given number of tasks."""
    return _fingerprint(embedding.embed_chunks(t.documents, partitions=16), "doc_id").filter("slots > 0")


@query("embed_query", f"""
WITH asked AS (SELECT conv_id || '-' || turn AS qid, text FROM conversations WHERE role = 'user'),
{embedded_sql('asked', 'qid')} SELECT qid, {FINGERPRINT_SQL} GROUP BY qid""")
def embed_query(t):
    asked = t.conversations.filter("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), "text")
    return _fingerprint(embedding.embed_chunks(asked), "qid").filter("slots > 0")


@query("embed_distinct", f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents),
uniq AS (SELECT DISTINCT text, md5(text) AS k FROM lines),
{embedded_sql('uniq', 'k')},
prints AS (SELECT k, {FINGERPRINT_SQL} GROUP BY k)
SELECT doc_id, count(*) AS lines, sum(slots)::BIGINT AS slots FROM lines JOIN prints ON k = md5(text) GROUP BY doc_id""")
def embed_distinct(t):
    """Lines repeat across documents; each distinct line is embedded once."""
    lines = inputs.documents(t).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("text"))
    made = _fingerprint(embedding.embed_distinct(lines), "doc_id").filter("slots > 0")
    return made.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("slots").alias("slots"))
