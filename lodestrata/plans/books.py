"""Queries over training rows, logs, checkpoints, trials, versions and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import registry, training
from lodestrata.plans import inputs
from lodestrata.plans.catalog import query
from lodestrata.plans.inputs import CHECKPOINTS_SQL, TRAINING_LOGS_SQL, rounded
from lodestrata.sources.artifacts import load_train_eval_split
from lodestrata.sources.artifacts import load_training_data as load_training_rows
from lodestrata.sources.sinks import write_training_jsonl
from lodestrata.streaming.run import new_folder


@query("first_n", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def first_n(t):
    return training.first_n(t.documents.select("doc_id", "lang", "n_chars"), 100, ["doc_id"])


@query("eval_first_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100 // 10")
def eval_first_n(t):
    return training.eval_first_n(t.documents.select("doc_id", "lang"), 100, ["doc_id"])


@query("load_training_data", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 200")
def load_training_data(t):
    """All documents as a training file; the first rows of it are the feature."""
    rows, folder = t.documents.select("doc_id", "text"), new_folder(t.spark)
    write_training_jsonl(rows, folder)
    return load_training_rows(t.spark, folder, rows.schema, "text", ["doc_id"], 200)


@query("load_train_eval_split", """
WITH s AS (SELECT doc_id, md5('split:' || doc_id) >= 'e6' AS held FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY doc_id) AS n FROM s)
SELECT CASE WHEN held THEN 'eval' ELSE 'train' END AS split, doc_id FROM r WHERE n <= CASE WHEN held THEN 20 ELSE 200 END""")
def split(t):
    """A hash of the key splits the rows; each split keeps its first rows."""
    held = F.md5(F.concat(F.lit("split:"), F.col("doc_id").cast("string"))) >= "e6"
    docs = t.documents.select("doc_id")
    train, test = load_train_eval_split(docs.filter(~held), docs.filter(held), ["doc_id"], 200)
    return train.select(F.lit("train").alias("split"), "doc_id").unionByName(
        test.select(F.lit("eval").alias("split"), "doc_id"))


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def seeded_sample(t):
    return training.seeded_sample(t.documents.select("doc_id", "lang"), 100, "doc_id")


@query("rename_training_metrics", f"WITH {TRAINING_LOGS_SQL}" + r"""
SELECT run_id, step, CASE WHEN starts_with(name, 'eval_') THEN 'eval/' || substr(name, 6)
                          WHEN name IN ('loss', 'learning_rate', 'epoch') THEN 'train/' || name ELSE name END AS metric,
       round(value + 1e-10, 6) AS value FROM log_values WHERE NOT starts_with(name, '_')""")
def rename_training_metrics(t):
    return training.rename_training_metrics(inputs.training_logs(t)).withColumn("value", rounded("value"))


@query("rename_eval_metrics", f"WITH {TRAINING_LOGS_SQL}" + """
SELECT run_id, step, 'eval/' || replace(name, 'eval_', '') AS metric, round(value + 1e-10, 6) AS value FROM log_values""")
def rename_eval_metrics(t):
    return training.rename_eval_metrics(inputs.training_logs(t)).withColumn("value", rounded("value"))


PERPLEXITY_SQL = """
SELECT source, sum(sqrt(n_chars) / 20 * n_chars) / sum(n_chars) AS avg_loss,
       exp(sum(sqrt(n_chars) / 20 * n_chars) / sum(n_chars)) AS perplexity FROM documents GROUP BY source"""


def _perplexity(t):
    rows = t.documents.select("source", (F.sqrt("n_chars") / 20).alias("loss"), F.col("n_chars").alias("tokens"))
    return training.perplexity(rows, ["source"])


@query("perplexity", f"SELECT source, round(avg_loss + 1e-10, 6) AS avg_loss, round(perplexity, 4) AS perplexity FROM ({PERPLEXITY_SQL})")
def perplexity(t):
    return _perplexity(t).select("source", rounded("avg_loss").alias("avg_loss"), F.round("perplexity", 4).alias("perplexity"))


@query("register_gate", f"SELECT source, coalesce(perplexity, 0) <= 50 AS register FROM ({PERPLEXITY_SQL})")
def register_gate(t):
    return training.register_gate(_perplexity(t)).select("source", "register")


@query("training_health", f"WITH {TRAINING_LOGS_SQL}" + """
, last AS (SELECT run_id, arg_max(value, step) FILTER (name = 'loss') AS loss,
                  arg_max(value, step) FILTER (name = 'eval_loss') AS eval_loss,
                  arg_max(value, step) FILTER (name = 'samples_per_second') AS rate FROM log_values GROUP BY run_id)
SELECT run_id, round(loss + 1e-10, 6) AS loss, loss < 1 AS converged, eval_loss - loss < 0.5 AS no_overfit,
       rate > 5 AS fast_enough FROM last""")
def training_health(t):
    return training.training_health(inputs.training_logs(t)).select(
        "run_id", rounded("loss").alias("loss"), "converged", "no_overfit", "fast_enough")


# -- checkpoints ---------------------------------------------------------------------


@query("keep_best_n_checkpoints", f"WITH {CHECKPOINTS_SQL}" + """
, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY metric ASC NULLS LAST, step) AS rank FROM checkpoints)
SELECT run_id, step, path, metric, rank FROM r WHERE rank <= 3""")
def keep_best_n_checkpoints(t):
    kept = training.keep_best_checkpoints(inputs.checkpoints(t), 3, block_width=5000)
    return kept.withColumn("rank", F.col("rank").cast("long"))


@query("latest_checkpoint", f"WITH {CHECKPOINTS_SQL} SELECT run_id, max(step) AS step, arg_max(path, step) AS path FROM checkpoints GROUP BY run_id")
def latest_checkpoint(t):
    return training.latest_checkpoint(inputs.checkpoints(t))


@query("best_checkpoint", f"WITH {CHECKPOINTS_SQL}" + """
, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY metric DESC NULLS LAST,
          CASE WHEN metric IS NULL THEN -step ELSE step END) AS n FROM checkpoints)
SELECT run_id, step, path, metric FROM r WHERE n = 1""")
def best_checkpoint(t):
    return training.best_checkpoint(inputs.checkpoints(t), greater_is_better=True)


@query("last_metric_before_save", f"WITH {TRAINING_LOGS_SQL}" + """
, steps AS (SELECT DISTINCT run_id, step FROM log_values),
e AS (SELECT run_id, step, value FROM log_values WHERE name = 'eval_loss')
SELECT run_id, step, round(last_value(value IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY step) + 1e-10, 6) AS metric_at_save
FROM steps LEFT JOIN e USING (run_id, step)""")
def last_metric_before_save(t):
    made = training.last_metric_before_save(inputs.training_logs(t), "eval_loss", block_width=1000)
    return made.select("run_id", "step", rounded("metric_at_save").alias("metric_at_save"))


@query("resume_checkpoint", f"WITH {CHECKPOINTS_SQL}" + """
, failures AS (SELECT run_id, max(step) AS failed_step FROM checkpoints WHERE metric IS NULL GROUP BY run_id)
SELECT run_id, failed_step, max(step) AS resume_step, arg_max(path, step) AS resume_path
FROM checkpoints JOIN failures USING (run_id) WHERE step < failed_step GROUP BY ALL""")
def resume_checkpoint(t):
    """The last save without a metric stands for the failure."""
    saves = inputs.checkpoints(t)
    failures = saves.filter("metric is null").groupBy("run_id").agg(F.max("step").alias("failed_step"))
    return training.resume_checkpoint(saves, failures)


@query("seeded_sample_share", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT (SELECT count(*) // 10 FROM documents)")
def seeded_sample_share(t):
    """A tenth of the rows: the draw at which they end is found by histograms, and a filter takes them."""
    rows = t.documents.select("doc_id", "lang")
    return training.seeded_sample(rows, rows.count() // 10, "doc_id", in_one_task=8)


@query("first_n_share", """
SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT (SELECT count(*) // 5 FROM lineitem)""")
def first_n_share(t):
    """A fifth of the line items by date, with many ties on each date."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    return training.first_n(rows, rows.count() // 5, ["l_shipdate", "l_orderkey", "l_linenumber"], in_one_task=10)


# -- early stopping ------------------------------------------------------------------


def stopping_sql(key: str, patience: int, threshold: float) -> str:
    return f"""
WITH RECURSIVE
evals AS MATERIALIZED (
  SELECT {key} AS run_id, event_id AS step, value AS m,
         row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS n FROM events),
walk(run_id, n, best, misses, stop) AS (
  SELECT run_id, n, m, 0, NULL::BIGINT FROM evals WHERE n = 1
  UNION ALL
  SELECT e.run_id, e.n, CASE WHEN e.m < w.best - {threshold} THEN e.m ELSE w.best END,
         CASE WHEN e.m < w.best - {threshold} THEN 0 ELSE w.misses + 1 END,
         CASE WHEN NOT e.m < w.best - {threshold} AND w.misses + 1 >= {patience} THEN e.step END
  FROM walk w JOIN evals e ON e.run_id = w.run_id AND e.n = w.n + 1 WHERE w.stop IS NULL),
last AS (SELECT run_id, arg_max(best, n) AS best, max(stop) AS stop_step FROM walk GROUP BY run_id)
SELECT run_id, evaluations, round(best + 1e-10, 6) AS best, stop_step, stop_step IS NOT NULL AS stopped
FROM last JOIN (SELECT run_id, count(*) AS evaluations FROM evals GROUP BY run_id) USING (run_id)"""


def _stopping(t, key, patience, threshold):
    evals = t.events.select(F.col(key).alias("run_id"), F.col("event_id").alias("step"), F.col("value").alias("metric"))
    return training.early_stopping(evals, patience, threshold, block_width=1000).withColumn("best", rounded("best"))


@query("early_stopping", stopping_sql("user_id", 12, 0.0))
def early_stopping(t):
    return _stopping(t, "user_id", 12, 0.0)


@query("early_stopping_threshold", stopping_sql("user_id", 20, 0.5))
def early_stopping_threshold(t):
    return _stopping(t, "user_id", 20, 0.5)


@query("early_stopping_long_runs", stopping_sql("event_type", 1500, 0.02))
def early_stopping_long_runs(t):
    """Few runs, each holding a large share of all rows."""
    return _stopping(t, "event_type", 1500, 0.02)


# -- trials --------------------------------------------------------------------------


@query("best_trial", """
WITH r AS (SELECT o_custkey AS study, o_orderkey AS trial_id, o_totalprice AS metric,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n
           FROM orders WHERE o_orderstatus = 'F')
SELECT study, trial_id, metric FROM r WHERE n = 1""")
def best_trial(t):
    trials = t.orders.select(
        F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("trial_id"), F.col("o_totalprice").alias("metric"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("status"))
    return training.best_trial(trials, ["study"])


@query("sample_search_space", """
WITH u AS (SELECT o_orderkey AS trial_id,
  ('0x' || substr(md5('42:' || o_orderkey || ':batch_size'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS a,
  ('0x' || substr(md5('42:' || o_orderkey || ':dropout'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS b,
  ('0x' || substr(md5('42:' || o_orderkey || ':learning_rate'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS c FROM orders)
SELECT trial_id, [4, 8, 16][floor(a * 3)::INT + 1] AS batch_size, round(0.1 * b + 1e-10, 6) AS dropout,
       round(1e6 * exp(ln(1e-5) + c * ln(100)), 3) AS learning_rate_ppm FROM u""")
def sample_search_space(t):
    """One draw per order as a trial."""
    space = {"batch_size": ("choice", [4, 8, 16]), "dropout": ("uniform", 0.0, 0.1),
             "learning_rate": ("loguniform", 1e-5, 1e-3)}
    drawn = training.sample_search_space(t.orders.select(F.col("o_orderkey").alias("trial_id")), space)
    return drawn.select("trial_id", "batch_size", rounded("dropout").alias("dropout"),
                        F.round(F.col("learning_rate") * 1e6, 3).alias("learning_rate_ppm"))


# -- registry ------------------------------------------------------------------------


MOVES_SQL = """
moves AS (SELECT o_custkey AS name, floor(o_totalprice / 100000)::BIGINT AS version, o_orderkey AS seq,
                 CASE o_orderstatus WHEN 'F' THEN 'Production' WHEN 'O' THEN 'Staging' ELSE 'Archived' END AS stage
          FROM orders)"""


def _moves(t):
    return t.orders.select(
        F.col("o_custkey").alias("name"), F.floor(F.col("o_totalprice") / 100000).cast("long").alias("version"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", "Production").when(F.col("o_orderstatus") == "O", "Staging")
        .otherwise("Archived").alias("stage"))


@query("latest_model_version", """
SELECT o_custkey AS name, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS stage FROM orders GROUP BY o_custkey""")
def latest_model_version(t):
    rows = t.orders.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"),
                           F.col("o_orderstatus").alias("stage"))
    return registry.latest_model_version(rows)


@query("latest_model_version_by_stage", """
SELECT o_custkey AS name, o_orderstatus AS stage, max(o_orderkey) AS version FROM orders GROUP BY ALL""")
def latest_model_version_by_stage(t):
    rows = t.orders.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"),
                           F.col("o_orderstatus").alias("stage"))
    return registry.latest_model_version(rows, by_stage=True)


@query("stage_history", f"WITH {MOVES_SQL}" + """
, last AS (SELECT name, version, max(seq) AS since, arg_max(stage, seq) AS stage FROM moves GROUP BY ALL)
SELECT name, version, since, CASE WHEN stage <> 'Archived' AND EXISTS (
         SELECT 1 FROM moves m WHERE m.name = l.name AND m.stage = l.stage AND m.version <> l.version AND m.seq > l.since)
       THEN 'Archived' ELSE stage END AS stage FROM last l""")
def stage_history(t):
    return registry.current_stages(_moves(t))


@query("rollback_target", """
SELECT o_custkey AS name, o_orderkey AS seq,
       max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (
         PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rollback_to
FROM orders""")
def rollback_target(t):
    rows = t.orders.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("seq"),
                           F.col("o_orderkey").alias("version"), "o_orderstatus")
    made = registry.rollback_target(rows, F.col("o_orderstatus") == "F", block_width=2000)
    return made.select("name", "seq", "rollback_to")


@query("lineage_check", """
SELECT DISTINCT 'order-' || l_orderkey AS stage, 'part-' || l_partkey AS input FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)""")
def lineage_check(t):
    """Orders as stages that read parts; parts up to size 5 were never registered."""
    stages = t.lineitem.select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("stage"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("input")).distinct()
    parts = t.part.filter("p_size > 5").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("artifact"))
    return registry.lineage_gaps(stages, parts).select("stage", "input")


@query("lineage_ancestors", """
WITH RECURSIVE edges AS (
  SELECT 'order-' || o_orderkey AS child, 'customer-' || o_custkey AS parent FROM orders
  UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey FROM customer
  UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey FROM nation),
up(artifact, ancestor, distance) AS (
  SELECT child, parent, 1 FROM edges
  UNION ALL SELECT u.artifact, e.parent, u.distance + 1 FROM up u JOIN edges e ON e.child = u.ancestor)
SELECT artifact, ancestor, min(distance)::BIGINT AS distance FROM up GROUP BY ALL""")
def lineage_ancestors(t):
    def edge(df, child, ck, parent, pk):
        name = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
        return df.select(name(child, ck).alias("child"), name(parent, pk).alias("parent"))

    edges = (
        edge(t.orders, "order", "o_orderkey", "customer", "o_custkey")
        .unionByName(edge(t.customer, "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(edge(t.nation, "nation", "n_nationkey", "region", "n_regionkey")))
    return registry.ancestors(edges).withColumn("distance", F.col("distance").cast("long"))


@query("stage_throughput", """
SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS items, round(sum(l_extendedprice / 1000), 3) AS seconds,
       round(sum(l_quantity) / sum(l_extendedprice / 1000) + 1e-10, 6) AS items_per_second FROM lineitem GROUP BY ALL""")
def stage_throughput(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("items"),
                             (F.col("l_extendedprice") / 1000).alias("seconds"))
    return registry.stage_throughput(rows, ["l_returnflag", "l_linestatus"]).select(
        "l_returnflag", "l_linestatus", "items", F.round("seconds", 3).alias("seconds"),
        rounded("items_per_second").alias("items_per_second"))
