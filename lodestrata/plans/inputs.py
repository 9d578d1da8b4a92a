"""How the given tables stand in for corpora, requests, logs and registries.

Each input has a Spark form and the same thing as SQL text for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.documents import spread

SPACE_SQL = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def tokens_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; the small shift keeps decimal ties from falling either way with the summing order."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-10, digits)


def documents(t) -> DataFrame:
    return spread(t.documents)


# Markdown made from plain prose: a line that begins with A..E becomes a header.
def as_markdown(text: Column) -> Column:
    return F.regexp_replace(text, "\n([A-E])", "\n## $1")


MARKDOWN_SQL = r"regexp_replace(text, '\n([A-E])', E'\n## \\1', 'g')"


# Requests made from events.
def requests(t) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("model-"), (F.col("user_id") % 5).cast("string")).alias("model"),
        F.when(F.col("event_type") == "error", "500").when(F.col("event_type") == "signup", "404")
        .otherwise("200").alias("status"),
        (F.col("value") / 100).alias("latency"),
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("prompt_tokens"),
        F.floor("value").cast("long").alias("completion_tokens"),
        "user_id",
    )


REQUESTS_SQL = r"""
requests AS (
  SELECT event_id AS request_id, ts, epoch_us(ts) AS us, 'model-' || (user_id % 5) AS model,
         CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '404' ELSE '200' END AS status,
         value / 100 AS latency, regexp_extract(props, '(\d+)', 1)::BIGINT AS prompt_tokens,
         floor(value)::BIGINT AS completion_tokens, user_id
  FROM events)"""


# Evaluation scores made from order lines: three metrics of each framework per case.
def scores(t) -> DataFrame:
    lines = t.lineitem.select(
        "l_returnflag",
        F.concat(F.lit("run-"), F.col("l_suppkey").cast("string")).alias("run"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string")).alias("case_id"),
        (0.5 + F.col("l_quantity") / 100).alias("faithfulness"),
        (F.col("l_quantity") / 50).alias("answer_relevancy"),
        (1 - F.col("l_tax") * 5).alias("context_precision"),
        (1 - F.col("l_discount")).alias("relevance"),
        F.abs("l_tax").alias("toxicity"),
        F.abs("l_discount").alias("hallucination"),
    )
    names = ["faithfulness", "answer_relevancy", "context_precision", "relevance", "toxicity", "hallucination"]
    long = lines.unpivot(["l_returnflag", "run", "case_id"], names, "metric", "score")
    low = F.col("metric").isin("toxicity", "hallucination")
    return long.select(
        F.col("l_returnflag").alias("dataset"), "run", "case_id",
        F.when(F.col("metric").isin(*names[:3]), "ragas").otherwise("deepeval").alias("framework"),
        "metric", "score",
        F.when(low, F.col("score") <= 0.095).otherwise(F.col("score") >= 0.5).alias("success"),
    )


SCORES_SQL = """
lines AS (
  SELECT l_returnflag AS dataset, 'run-' || l_suppkey AS run,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey AS case_id,
         0.5::DOUBLE + l_quantity / 100 AS faithfulness, l_quantity / 50 AS answer_relevancy,
         1 - l_tax * 5 AS context_precision, 1 - l_discount AS relevance,
         abs(l_tax) AS toxicity, abs(l_discount) AS hallucination
  FROM lineitem),
scores AS (
  SELECT dataset, run, case_id,
         CASE WHEN metric IN ('faithfulness', 'answer_relevancy', 'context_precision')
              THEN 'ragas' ELSE 'deepeval' END AS framework,
         metric, score,
         CASE WHEN metric IN ('toxicity', 'hallucination') THEN score <= 0.095 ELSE score >= 0.5 END AS success
  FROM lines UNPIVOT (score FOR metric IN
    (faithfulness, answer_relevancy, context_precision, relevance, toxicity, hallucination)))"""


# Checkpoints made from orders: a customer is a run, the order key its step.
def checkpoints(t) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("step"),
        F.concat(F.lit("run-"), F.col("o_custkey").cast("string"), F.lit("/checkpoint-"),
                 F.col("o_orderkey").cast("string")).alias("path"),
        F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 10000)).cast("double").alias("metric"),
    )


CHECKPOINTS_SQL = """
checkpoints AS (
  SELECT o_custkey AS run_id, o_orderkey AS step,
         'run-' || o_custkey || '/checkpoint-' || o_orderkey AS path,
         CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 10000) END::DOUBLE AS metric
  FROM orders)"""


# Training logs made from events: a user is a run, the event id its step.
def training_logs(t) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    pairs = F.array(
        F.struct(F.lit("loss").alias("key"), (value / 100).alias("value")),
        F.struct(F.lit("epoch").alias("key"), F.col("event_id").cast("double").alias("value")),
        F.struct(F.when(kind == "view", "eval_loss").when(kind == "click", "samples_per_second")
                 .when(kind == "error", "_internal").when(kind == "signup", "grad_norm")
                 .otherwise("learning_rate").alias("key"),
                 F.when(kind == "view", value / 90).otherwise(value).alias("value")),
    )
    return t.events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.map_from_entries(pairs).alias("logs"))


TRAINING_LOGS_SQL = """
log_values AS (
  SELECT user_id AS run_id, event_id AS step, 'loss' AS name, value / 100 AS value FROM events
  UNION ALL SELECT user_id, event_id, 'epoch', event_id::DOUBLE FROM events
  UNION ALL SELECT user_id, event_id,
         CASE event_type WHEN 'view' THEN 'eval_loss' WHEN 'click' THEN 'samples_per_second'
                         WHEN 'error' THEN '_internal' WHEN 'signup' THEN 'grad_norm' ELSE 'learning_rate' END,
         CASE event_type WHEN 'view' THEN value / 90 ELSE value END FROM events)"""


# Question-answer samples made from conversations: a user turn, the assistant turn after
# it, the two turns before as contexts and the turn after the answer as ground truth.
# Turns are one row per (conv_id, turn), so each join meets at most one row.
def rag_samples(t) -> DataFrame:
    turns = t.conversations.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select(
        "conv_id", "turn", "m.role", "m.text")

    def at(shift: int, name: str, role: str | None = None) -> DataFrame:
        rows = turns if role is None else turns.filter(F.col("role") == role)
        return rows.select("conv_id", (F.col("turn") - shift).alias("turn"), F.col("text").alias(name))

    keys = ["conv_id", "turn"]
    joined = (
        turns.filter("role = 'user'").select(*keys, F.col("text").alias("question"))
        .join(at(1, "answer", "assistant"), keys)
        .join(at(2, "ground_truth"), keys, "left")
        .join(at(-1, "c1"), keys, "left").join(at(-2, "c2"), keys, "left")
    )
    return joined.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"),
        "conv_id", "turn", "question", "answer", F.array_compact(F.array("c1", "c2")).alias("contexts"), "ground_truth")


RAG_SAMPLES_SQL = """
turns AS (
  SELECT conv_id, turn, min({'role': role, 'text': text}) AS m FROM conversations GROUP BY ALL),
flat AS (SELECT conv_id, turn, m.role AS role, m.text AS text FROM turns),
samples AS (
  SELECT q.conv_id || '-' || q.turn AS case_id, q.conv_id, q.turn, q.text AS question, a.text AS answer,
         list_filter([c1.text, c2.text], lambda x: x IS NOT NULL) AS contexts, g.text AS ground_truth
  FROM flat q
  JOIN flat a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  LEFT JOIN flat g ON g.conv_id = q.conv_id AND g.turn = q.turn + 2
  LEFT JOIN flat c1 ON c1.conv_id = q.conv_id AND c1.turn = q.turn - 1
  LEFT JOIN flat c2 ON c2.conv_id = q.conv_id AND c2.turn = q.turn - 2
  WHERE q.role = 'user')"""
