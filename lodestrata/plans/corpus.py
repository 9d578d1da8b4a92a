"""Queries over documents and pages: text, elements, chunks and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import chunking, elements, text
from lodestrata.operators import records, serving, training
from lodestrata.plans import inputs
from lodestrata.plans.catalog import query
from lodestrata.plans.inputs import MARKDOWN_SQL, RAG_SAMPLES_SQL, SPACE_SQL, strip_sql, tokens_sql

SIZE, OVERLAP = 512, 50

NOT_BLANK_SQL = r"regexp_matches(text, '[^\t-\r\x1c-\x20\x85\p{Z}]')"

FIXED_CHUNKS_SQL = rf"""
WITH RECURSIVE
words AS MATERIALIZED (
  SELECT doc_id, j, word, sum(length(word) + 1) OVER w - length(word) - 1 AS pos, sum(length(word) + 1) OVER w AS fin
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS j
        FROM documents WHERE {NOT_BLANK_SQL})
  WINDOW w AS (PARTITION BY doc_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
-- first word start inside the overlap reach before each word
reach AS MATERIALIZED (
  SELECT a.doc_id, a.j, min(b.pos) AS back
  FROM words a JOIN words b ON b.doc_id = a.doc_id AND b.j < a.j AND b.j >= a.j - {OVERLAP} AND b.pos >= a.pos - {OVERLAP}
  GROUP BY ALL),
chunks(doc_id, k, fresh, start) AS (
  SELECT doc_id, 0::BIGINT, j, 0::HUGEINT FROM words WHERE j = 1
  UNION ALL
  SELECT n.doc_id, n.k + 1, n.j, greatest(n.start, coalesce(r.back, w.pos))
  FROM (SELECT c.doc_id, c.k, c.start, min(x.j) AS j
        FROM chunks c JOIN words x ON x.doc_id = c.doc_id AND x.j > c.fresh AND x.fin > c.start + {SIZE}
        GROUP BY ALL) n
  JOIN words w ON w.doc_id = n.doc_id AND w.j = n.j
  LEFT JOIN reach r ON r.doc_id = n.doc_id AND r.j = n.j),
ends AS (
  SELECT c.*, lead(w.pos) OVER (PARTITION BY c.doc_id ORDER BY c.k) AS stop
  FROM chunks c JOIN words w ON w.doc_id = c.doc_id AND w.j = c.fresh),
spans AS (
  SELECT e.doc_id, e.k AS chunk_index, e.start::BIGINT AS true_start,
         coalesce(e.stop - 1, length(d.text))::BIGINT AS fin, d.text AS doc_text
  FROM ends e JOIN documents d USING (doc_id)),
made AS (
  SELECT doc_id, chunk_index, true_start - chunk_index AS start_char, fin - chunk_index AS end_char, true_start,
         substr(doc_text, true_start + 1, fin - true_start) AS text
  FROM spans)
"""


def _fixed(t):
    docs = records.drop_empty_documents(inputs.documents(t))
    return chunking.explode_chunks(docs, chunking.fixed_chunks(F.col("text"), SIZE, OVERLAP), "doc_id", "lang")


@query("chunk_fixed", FIXED_CHUNKS_SQL + "SELECT doc_id, chunk_index, start_char, end_char, true_start, text FROM made")
def chunk_fixed(t):
    return _fixed(t).select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
        *[F.col(c).cast("long").alias(c) for c in ("start_char", "end_char", "true_start")], "text")


@query("chunk_summary", FIXED_CHUNKS_SQL + """
SELECT d.lang, count(*) AS chunks, round(avg(length(m.text)), 6) AS mean_chars,
       count(DISTINCT substr(md5(m.text), 1, 16) || '-' || chunk_index) AS distinct_ids
FROM made m JOIN documents d USING (doc_id) GROUP BY d.lang""")
def chunk_summary(t):
    """Chunks, mean length and distinct ids per language; ids are deduplicated before they are counted."""
    ids = text.record_id(F.col("text"), F.col("chunk_index"))
    per_id = _fixed(t).groupBy("lang", ids.alias("id")).agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return per_id.groupBy("lang").agg(
        F.sum("n").alias("chunks"),
        F.round(F.sum("chars") / F.sum("n"), 6).alias("mean_chars"),
        F.count("*").alias("distinct_ids"))


SEMANTIC_CTES = rf"""paras AS (
  SELECT doc_id, pi, {strip_sql('para')} AS para
  FROM (SELECT doc_id, unnest(string_split(body, E'\n\n')) AS para,
               generate_subscripts(string_split(body, E'\n\n'), 1) AS pi
        FROM (SELECT doc_id, replace(text, E'\n', E'\n\n') AS body FROM documents))),
cut AS (
  SELECT doc_id, pi, length(para) > {SIZE} AS big,
         CASE WHEN length(para) > {SIZE}
              THEN string_split(regexp_replace(para, '([.!?]){SPACE_SQL}+', '\1' || chr(1), 'g'), chr(1))
              ELSE [para] END AS parts
  FROM paras WHERE para <> ''),
pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) AS i, txt, length(txt) AS len,
         CASE WHEN NOT big THEN 'P' WHEN si = 1 THEN 'S0' ELSE 'S' END AS kind
  FROM (SELECT doc_id, pi, big, unnest(parts) AS txt, generate_subscripts(parts, 1) AS si FROM cut)),
walk(doc_id, i, cur, start, k, outtext, outstart) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, '', 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM pieces
  UNION ALL
  SELECT doc_id, i,
         CASE WHEN over OR cur = '' THEN txt ELSE cur || sep || txt END,
         CASE WHEN emit THEN start + length(cur) + length(sep) ELSE start END,
         CASE WHEN emit THEN k + 1 ELSE k END,
         CASE WHEN emit THEN cur END, CASE WHEN emit THEN start END
  FROM (SELECT *, over AND CASE WHEN kind = 'S' THEN cur <> '' ELSE length(cur) >= {OVERLAP} END AS emit
        FROM (SELECT p.*, w.cur, w.start, w.k, CASE WHEN p.kind = 'S' THEN ' ' ELSE E'\n\n' END AS sep,
                     p.kind = 'S0' OR length(w.cur) + p.len + CASE WHEN p.kind = 'S' THEN 1 ELSE 2 END > {SIZE} AS over
              FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.i = w.i + 1))),
done AS (
  SELECT doc_id, k - 1 AS chunk_index, outtext AS text, outstart AS start_char FROM walk WHERE outtext IS NOT NULL
  UNION ALL
  SELECT doc_id, k, cur, start FROM walk
  WHERE (doc_id, i) IN (SELECT doc_id, max(i) FROM pieces GROUP BY doc_id) AND length(cur) >= {OVERLAP})"""


@query("chunk_semantic", f"""WITH RECURSIVE {SEMANTIC_CTES}
SELECT doc_id, chunk_index, start_char, start_char + length(text) AS end_char, text FROM done""")
def chunk_semantic(t):
    """Lines stand for paragraphs, so both paragraph and sentence cuts occur."""
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    cut = chunking.chunker("semantic", SIZE, OVERLAP)
    return chunking.explode_chunks(inputs.documents(t), cut(body), "doc_id").select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start_char", "end_char")], "text")


WINDOW_CHUNKS_SQL = rf"""
WITH made AS (
  SELECT doc_id, start_char // 80 AS chunk_no, start_char, substr(text, start_char + 1, 100) AS text
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 80)) AS start_char FROM documents)),
kept AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS chunk_index, start_char,
         start_char + length(text) AS end_char, text
  FROM made WHERE {strip_sql('text')} <> '')
"""


def _windows(t):
    return chunking.explode_chunks(inputs.documents(t), chunking.window_chunks(F.col("text"), 100, 20), "doc_id").select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start_char", "end_char")], "text")


@query("chunk_char_window", WINDOW_CHUNKS_SQL + "SELECT * FROM kept")
def chunk_char_window(t):
    return _windows(t)


@query("chunker_dispatch", FIXED_CHUNKS_SQL + f""", {SEMANTIC_CTES}, windows AS (
  SELECT doc_id, text FROM (
    SELECT doc_id, substr(text, s + 1, {SIZE}) AS text
    FROM (SELECT doc_id, text, unnest(range(0, length(text), {SIZE - OVERLAP})) AS s FROM documents))
  WHERE {NOT_BLANK_SQL})
SELECT 'fixed' AS strategy, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM made
UNION ALL SELECT 'semantic', count(*), sum(length(text))::BIGINT FROM done
UNION ALL SELECT 'window', count(*), sum(length(text))::BIGINT FROM windows""")
def chunker_dispatch(t):
    """The strategy name picks the chunker; for the semantic one lines stand for paragraphs."""
    docs = records.drop_empty_documents(inputs.documents(t))
    body = {"semantic": F.replace("text", F.lit("\n"), F.lit("\n\n"))}
    parts = [
        chunking.explode_chunks(docs, chunking.chunker(s, SIZE, OVERLAP)(body.get(s, F.col("text"))), "doc_id")
        .agg(F.count("*").alias("chunks"), F.sum(F.length("text")).cast("long").alias("chars"))
        .select(F.lit(s).alias("strategy"), "chunks", "chars")
        for s in ("fixed", "semantic", "window")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("record_id", WINDOW_CHUNKS_SQL + """
SELECT doc_id, chunk_index, substr(md5(text), 1, 16) || '-' || chunk_index AS id FROM kept""")
def record_id(t):
    return _windows(t).select("doc_id", "chunk_index", text.record_id(F.col("text"), F.col("chunk_index")).alias("id"))


@query("doc_id", "SELECT doc_id, md5(source || '/' || doc_id) AS doc_key FROM documents")
def doc_id(t):
    return t.documents.select("doc_id", text.doc_id(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("doc_key"))


@query("doc_type", r"""
SELECT page_id, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.](\.[^.]+)$', 1)) AS doc_type FROM pages""")
def doc_type(t):
    return t.pages.select("page_id", text.doc_type(F.col("url")).alias("doc_type"))


@query("extension_filter", r"""
SELECT page_id FROM pages WHERE regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.](\.[^.]+)$', 1)
IN ('.txt', '.md', '.pdf', '.docx', '.html')""")
def extension_filter(t):
    from lodestrata.sources.documents import DOCUMENT_SUFFIXES

    suffix = F.regexp_extract(text.file_name(F.col("url")), r"[^.](\.[^.]+)\z", 1)
    return t.pages.filter(suffix.isin(*DOCUMENT_SUFFIXES)).select("page_id")


@query("decode_ignore", "SELECT doc_id, replace(text, chr(233), '') AS text FROM documents")
def decode_ignore(t):
    """Each e-acute is broken into its lone lead byte, which decoding must drop."""
    broken = F.replace(F.hex(F.col("text").cast("binary")), F.lit("C3A9"), F.lit("C3"))
    return inputs.documents(t).select("doc_id", text.decode_ignore(F.unhex(broken)).alias("text"))


@query("normalize_whitespace", rf"""
SELECT doc_id, trim(regexp_replace(text, '{SPACE_SQL}+', ' ', 'g'), ' ') AS text FROM documents""")
def normalize_whitespace(t):
    return t.documents.select("doc_id", text.normalize_whitespace(F.col("text")).alias("text"))


@query("drop_empty_documents", rf"""
SELECT doc_id, part FROM (
  SELECT doc_id, 'line' AS part, regexp_extract(text, '\n(.*)$', 1) AS text FROM documents
  UNION ALL SELECT doc_id, 'text', text FROM documents)
WHERE {NOT_BLANK_SQL}""")
def drop_empty_documents(t):
    """Whole documents, and the last line of each, which is empty for documents of one line."""
    line = t.documents.select("doc_id", F.lit("line").alias("part"), F.regexp_extract("text", r"\n(.*)\z", 1).alias("text"))
    whole = t.documents.select("doc_id", F.lit("text").alias("part"), "text")
    return records.drop_empty_documents(line.unionByName(whole)).select("doc_id", "part")


ELEMENTS_SQL = rf"""
md_parts AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pi
  FROM (SELECT doc_id, string_split(regexp_replace({MARKDOWN_SQL}, '(?m)(^#{{1,6}}{SPACE_SQL}+.+$)',
               chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)),
md AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi) - 1 AS element_index,
         CASE WHEN starts_with(text, '#') THEN 'title' WHEN starts_with(text, '```') THEN 'code'
              ELSE 'paragraph' END AS element_type, text
  FROM (SELECT doc_id, pi, {strip_sql('part')} AS text FROM md_parts) WHERE text <> ''),
h1 AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g') AS s FROM pages),
h2 AS (SELECT page_id, regexp_replace(s, '(?i)<(h[1-6]|title)\b[^>]*>', chr(1) || 'T', 'g') AS s FROM h1),
h3 AS (SELECT page_id, regexp_replace(s, '(?i)<li\b[^>]*>', chr(1) || 'L', 'g') AS s FROM h2),
h4 AS (SELECT page_id, regexp_replace(s, '(?i)</(h[1-6]|title|li)>|</?({elements.BLOCK_TAGS})\b[^>]*>|\n[ \t\r]*\n', chr(1) || 'N', 'g') AS s FROM h3),
h5 AS (SELECT page_id, regexp_replace(s, '<[a-zA-Z/!][^>]*>', '', 'g') AS s FROM h4),
h6 AS (SELECT page_id, replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
              '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS s FROM h5),
html_parts AS (
  SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pi
  FROM (SELECT page_id, string_split('N' || s, chr(1)) AS parts FROM h6)),
generic AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pi) - 1 AS element_index, element_type, text
  FROM (SELECT page_id, pi, CASE substr(part, 1, 1) WHEN 'T' THEN 'Title' WHEN 'L' THEN 'ListItem'
               ELSE 'NarrativeText' END AS element_type,
               trim(regexp_replace(substr(part, 2), '{SPACE_SQL}+', ' ', 'g'), ' ') AS text FROM html_parts)
  WHERE text <> '')
"""


def _exploded(df, key, expr):
    return df.select(key, F.posexplode(expr).alias("element_index", "e")).select(
        key, F.col("element_index").cast("long").alias("element_index"), "e.element_type", "e.text")


@query("markdown_elements", "WITH " + ELEMENTS_SQL + "SELECT * FROM md")
def markdown_elements(t):
    return _exploded(inputs.documents(t), "doc_id", elements.markdown_elements(inputs.as_markdown(F.col("text"))))


@query("generic_elements", "WITH " + ELEMENTS_SQL + "SELECT * FROM generic")
def generic_elements(t):
    return _exploded(inputs.spread(t.pages), "page_id", elements.generic_elements(F.col("html")))


def _mixed(t):
    docs = t.documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"),
        inputs.as_markdown(F.col("text")).alias("content"), F.lit(".md").alias("doc_type"))
    pages = t.pages.select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"),
        F.col("html").alias("content"), F.lit(".html").alias("doc_type"))
    return inputs.spread(docs.unionByName(pages))


@query("parser_dispatch", "WITH " + ELEMENTS_SQL + """
SELECT 'd' || doc_id AS key, element_index, element_type, text FROM md
UNION ALL SELECT 'p' || page_id, element_index, element_type, text FROM generic""")
def parser_dispatch(t):
    return _exploded(_mixed(t), "key", elements.parse_elements(F.col("content"), F.col("doc_type")))


@query("combine_elements", "WITH " + ELEMENTS_SQL + r"""
SELECT 'd' || doc_id AS key, string_agg(text, E'\n\n' ORDER BY element_index) AS text FROM md GROUP BY ALL
UNION ALL SELECT 'p' || page_id, string_agg(text, E'\n\n' ORDER BY element_index) FROM generic GROUP BY ALL""")
def combine_elements(t):
    """Joined inside the row, before any explode."""
    made = elements.parse_elements(F.col("content"), F.col("doc_type"))
    return _mixed(t).select("key", elements.combine_elements(made).alias("text")).filter("text <> ''")


@query("element_count", "WITH " + ELEMENTS_SQL + """
, per AS (SELECT 'd' || doc_id AS key, '.md' AS doc_type, count(*) AS n FROM md GROUP BY ALL
          UNION ALL SELECT 'p' || page_id, '.html', count(*) FROM generic GROUP BY ALL)
SELECT doc_type, count(*) AS documents, sum(n)::BIGINT AS elements, max(n) AS most FROM per GROUP BY doc_type""")
def element_count(t):
    n = F.size(elements.parse_elements(F.col("content"), F.col("doc_type")))
    return _mixed(t).select("doc_type", n.alias("n")).filter("n > 0").groupBy("doc_type").agg(
        F.count("*").alias("documents"), F.sum("n").alias("elements"), F.max("n").cast("long").alias("most"))


@query("metadata_merge", """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'mirror/' || source ELSE source END AS source, '.txt' AS doc_type, lang,
       3::BIGINT AS entries FROM documents""")
def metadata_merge(t):
    """English documents carry their own source, which wins over the scan's."""
    own = F.when(F.col("lang") == "en", F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("source"), F.concat(F.lit("mirror/"), F.col("source")))
    ).otherwise(F.create_map(F.lit("lang"), F.col("lang")))
    merged = t.documents.select("doc_id", records.merge_metadata(F.col("source"), F.lit(".txt"), own).alias("m"))
    return merged.select(
        "doc_id", F.col("m")["source"].alias("source"), F.col("m")["doc_type"].alias("doc_type"),
        F.col("m")["lang"].alias("lang"), F.size("m").cast("long").alias("entries"))


@query("metadata_filter", "SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def metadata_filter(t):
    rows = t.documents.select("doc_id", F.create_map(F.lit("category"), F.col("lang")).alias("metadata"), "lang")
    return records.metadata_filter(rows, "metadata['category'] = 'de'").select("doc_id", "lang")


@query("validate_required_fields", """
WITH rows AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
missing AS (SELECT doc_id, 'quality' AS field FROM rows WHERE quality IS NULL
            UNION ALL SELECT doc_id, 'toxic' FROM rows WHERE toxic IS NULL)
SELECT doc_id, field, 'Document ' || doc_id || ': missing ''' || field || '''' AS message FROM missing""")
def validate_required_fields(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return records.validate_required_fields(rows, "doc_id", ["quality", "toxic"])


@query("validate_training_rows", f"WITH {RAG_SAMPLES_SQL}" + """
SELECT case_id, 'output' AS field, 'Example ' || case_id || ': missing ''output''' AS message
FROM samples WHERE ground_truth IS NULL""")
def validate_training_rows(t):
    rows = inputs.rag_samples(t).select(
        "case_id", F.col("question").alias("instruction"), F.col("ground_truth").alias("output"))
    return records.validate_required_fields(rows, "case_id", ["instruction", "output"], "Example")


@query("whitespace_token_count", rf"""
SELECT conv_id, turn, n AS n_tokens, n >= 60 AS enough
FROM (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '{SPACE_SQL}+'), lambda w: w <> ''))::BIGINT AS n
      FROM conversations WHERE role = 'assistant')""")
def whitespace_token_count(t):
    replies = t.conversations.filter("role = 'assistant'")
    return serving.token_count_check(replies, "text", 60).select(
        "conv_id", "turn", F.col("n_tokens").cast("long").alias("n_tokens"), "enough")


@query("project_text_column", f"""
SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents""")
def project_text_column(t):
    return training.project_text_column(t.documents, "text", "doc_id").select(
        "doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("tokenize_truncate", f"""
SELECT doc_id, array_to_string(w[1:256], ' ') AS tokens, least(len(w), 256)::BIGINT AS n_tokens, len(w) > 256 AS truncated
FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)""")
def tokenize_truncate(t):
    return training.tokenize_truncate(inputs.documents(t), "text", ["doc_id"], 256).select(
        "doc_id", F.array_join("tokens", " ").alias("tokens"), F.col("n_tokens").cast("long").alias("n_tokens"), "truncated")


@query("dataset_profile", f"""
SELECT count(*) AS num_samples, 5::BIGINT AS num_columns, sum(length(text))::BIGINT AS total_chars,
       max(length(text))::BIGINT AS max_chars, sum(len({tokens_sql('text')}))::BIGINT AS total_tokens FROM documents""")
def dataset_profile(t):
    return records.dataset_profile(t.documents, "text", text.word_tokens(F.col("text")))


@query("ingest_metrics", FIXED_CHUNKS_SQL + f"""
SELECT (SELECT count(*) FROM documents) AS documents_loaded,
       (SELECT count(*) FROM documents WHERE {NOT_BLANK_SQL}) AS documents_parsed,
       count(*) AS chunks_created, count(*) AS vectors_stored,
       count(DISTINCT substr(md5(text), 1, 16) || '-' || chunk_index) AS distinct_records FROM made""")
def ingest_metrics(t):
    """All counters in one scan: chunk ids are counted per row first, then once per distinct id."""
    docs = inputs.documents(t).select("doc_id", "text", text.is_blank(F.col("text")).alias("blank"))
    ids = F.transform(
        chunking.fixed_chunks(F.col("text"), SIZE, OVERLAP),
        lambda c, i: text.record_id(c["text"], i))
    listed = docs.select("blank", F.posexplode_outer(F.when(~F.col("blank"), ids)).alias("i", "id"))
    first = (F.coalesce("i", F.lit(0)) == 0).cast("long")
    per_id = listed.groupBy("id").agg(
        F.sum(first).alias("loaded"), F.sum(first * (~F.col("blank")).cast("long")).alias("parsed"),
        F.count("id").alias("chunks"))
    return per_id.agg(
        F.sum("loaded").alias("documents_loaded"), F.sum("parsed").alias("documents_parsed"),
        F.sum("chunks").alias("chunks_created"), F.sum("chunks").alias("vectors_stored"),
        F.count("id").alias("distinct_records"))


@query("skip_existing", """
SELECT doc_id, md5(source || '/' || doc_id) AS doc_key FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def skip_existing(t):
    """Labelled documents stand for those already processed."""
    docs = t.documents.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"))
    done = docs.join(t.labels, "doc_id", "left_semi").select(text.doc_id(F.col("source")).alias("doc_key"))
    return records.skip_existing(docs, done).select("doc_id", "doc_key")
