"""Queries over request, gauge and job rows: counters, windows, quantiles, routing and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import alerts, evaluation, serving, signals, telemetry
from lodestrata.plans import inputs
from lodestrata.plans.catalog import query
from lodestrata.plans.inputs import REQUESTS_SQL, rounded
from lodestrata.streaming.run import new_folder

REQ = f"WITH {REQUESTS_SQL}"
HOUR = 3600


def start_of(column: str = "window"):
    return F.unix_timestamp(F.col(column)["start"].cast("timestamp")).alias("start")


def start_sql(seconds: int) -> str:
    return f"(us // {seconds * 1_000_000}) * {seconds} AS start"


def shown_bound():
    return F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")).alias("le")


BOUNDS_SQL = "bounds AS (SELECT unnest([0.1, 0.25, 0.5, 1, 2.5, 5, 10, 'inf'::DOUBLE]) AS le)"
LE_SQL = "CASE WHEN le = 'inf'::DOUBLE THEN '+Inf' ELSE le::DOUBLE::VARCHAR END AS le"


# -- counters ------------------------------------------------------------------------


@query("request_counters", REQ + "SELECT model, status, count(*) AS requests FROM requests GROUP BY ALL")
def request_counters(t):
    return telemetry.request_counters(inputs.requests(t))


@query("token_counters", REQ + """
SELECT model, 'prompt' AS type, sum(prompt_tokens)::BIGINT AS tokens FROM requests GROUP BY model
UNION ALL SELECT model, 'completion', sum(completion_tokens)::BIGINT FROM requests GROUP BY model""")
def token_counters(t):
    return telemetry.token_counters(inputs.requests(t))


@query("server_stats", REQ + """
SELECT count(*) AS total_requests, sum(prompt_tokens)::BIGINT AS prompt_tokens,
       sum(completion_tokens)::BIGINT AS generated_tokens, count(*) FILTER (status <> '200') AS errors,
       count(*) FILTER (us + round(latency * 3600 * 1000000)::BIGINT > (SELECT max(us) FROM requests)) AS active FROM requests""")
def server_stats(t):
    """Latency read as hours, so that some requests are active at the end."""
    return telemetry.server_stats(inputs.requests(t).withColumn("latency", F.col("latency") * 3600))


@query("peak_active", REQ + """
, marks AS (SELECT model, us AS tick, 1 AS change FROM requests
          UNION ALL SELECT model, us + round(latency * 60 * 1000000)::BIGINT, -1 FROM requests),
steps AS (SELECT model, tick, sum(change) AS change FROM marks GROUP BY ALL),
run AS (SELECT model, sum(change) OVER (PARTITION BY model ORDER BY tick) AS active FROM steps)
SELECT model, max(active)::BIGINT AS peak FROM run GROUP BY model""")
def peak_active(t):
    """Latency read as minutes, so that requests overlap."""
    return telemetry.peak_active(inputs.requests(t).withColumn("latency", F.col("latency") * 60), ["model"])


@query("latency_histogram", REQ + f""", {BOUNDS_SQL}
SELECT model, {LE_SQL}, count(*) FILTER (latency <= le) AS count FROM requests, bounds GROUP BY model, bounds.le""")
def latency_histogram(t):
    return telemetry.latency_histogram(inputs.requests(t), ["model"]).select("model", shown_bound(), "count")


@query("latency_bucket_increase", REQ + f""", {BOUNDS_SQL},
r AS (SELECT latency, {start_sql(HOUR)} FROM requests)
SELECT start, {LE_SQL}, count(*) FILTER (latency <= le) AS count FROM r, bounds GROUP BY start, bounds.le""")
def latency_bucket_increase(t):
    made = telemetry.latency_histogram(inputs.requests(t), [telemetry.in_window(HOUR).alias("window")])
    return made.select(start_of(), shown_bound(), "count")


@query("histogram_quantile", REQ + f""", {BOUNDS_SQL},
h AS (SELECT model, le, count(*) FILTER (latency <= le) AS c FROM requests, bounds GROUP BY ALL),
w AS (SELECT *, max(c) OVER (PARTITION BY model) * 0.95 AS rank, coalesce(lag(le) OVER o, 0) AS low,
             coalesce(lag(c) OVER o, 0) AS below FROM h WINDOW o AS (PARTITION BY model ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY le) AS n FROM w WHERE c >= rank)
SELECT model, round(CASE WHEN le = 'inf'::DOUBLE THEN 10 ELSE low + (le - low) * (rank - below) / (c - below) END + 1e-10, 6) AS quantile
FROM f WHERE n = 1""")
def histogram_quantile(t):
    buckets = telemetry.latency_histogram(inputs.requests(t), ["model"])
    return telemetry.histogram_quantile(buckets, ["model"], 0.95).withColumn("quantile", rounded("quantile"))


# -- windows -------------------------------------------------------------------------


@query("request_rate", REQ + f"""
, r AS (SELECT model, {start_sql(HOUR)} FROM requests)
SELECT start, model, count(*) AS requests, round(count(*) / 3600 + 1e-10, 6) AS rate FROM r GROUP BY ALL""")
def request_rate(t):
    return telemetry.request_rate(inputs.requests(t), ["model"], HOUR).select(
        start_of(), "model", "requests", rounded("rate").alias("rate"))


@query("request_rate_sliding", REQ + """
, r AS (SELECT model, unnest([(us // 900000000 - i) * 900 for i in range(0, 4)]) AS start FROM requests)
SELECT start, model, count(*) AS requests, round(count(*) / 3600 + 1e-10, 6) AS rate FROM r GROUP BY ALL""")
def request_rate_sliding(t):
    return telemetry.request_rate(inputs.requests(t), ["model"], HOUR, 900).select(
        start_of(), "model", "requests", rounded("rate").alias("rate"))


@query("request_rate_total", REQ + f"""
, r AS (SELECT {start_sql(300)} FROM requests)
SELECT start, count(*) AS requests, round(count(*) / 300 + 1e-10, 6) AS rate FROM r GROUP BY ALL""")
def request_rate_total(t):
    return telemetry.request_rate(inputs.requests(t), [], 300).select(
        start_of(), "requests", rounded("rate").alias("rate"))


@query("latency_quantiles", REQ + f"""
, r AS (SELECT model, latency, {start_sql(86400)} FROM requests),
q AS (SELECT start, model, unnest([0.5, 0.95, 0.99]) AS prob,
             unnest(quantile_cont(latency, [0.5, 0.95, 0.99])) AS value FROM r GROUP BY start, model)
SELECT start, model, prob::DOUBLE AS prob, round(value + 1e-10, 6) AS value FROM q""")
def latency_quantiles(t):
    rows = inputs.requests(t).withColumn("window", telemetry.in_window(86400))
    return telemetry.latency_quantiles(rows, ["window", "model"]).select(
        start_of(), "model", "prob", rounded("value").alias("value"))


@query("latency_quantiles_sketch")
def latency_quantiles_sketch(t):
    return telemetry.latency_quantiles_sketch(inputs.requests(t), ["model"])


@query("latency_quantiles_rollup", REQ + f"""
, r AS (SELECT model, latency, {start_sql(HOUR)} FROM requests), p AS (SELECT unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS prob)
SELECT start, model, prob, count(latency) AS n, true AS within FROM r, p GROUP BY ALL""")
def latency_quantiles_rollup(t):
    """Hourly quantiles merged from one stored sketch a minute, and whether their true rank is within the bound."""
    rows, folder = inputs.requests(t), new_folder(t.spark)
    telemetry.latency_rollups(rows, ["model"]).write.parquet(f"{folder}/rollups")
    return within_rank(rows, telemetry.rolled_quantiles(t.spark.read.parquet(f"{folder}/rollups"), ["model"], HOUR, ROLLED), HOUR)


ROLLED = (0.5, 0.9, 0.95, 0.99)


def within_rank(rows, quantiles, seconds):
    """Whether the share of values up to each quantile is its probability, give or take the sketch's bound and one value."""
    start = (F.floor(F.unix_micros("ts") / (seconds * 1_000_000)) * seconds).cast("long")
    raw = rows.select("model", start.alias("start"), "latency")
    ranks = raw.join(quantiles, ["model", "start"]).groupBy("start", "model", "prob", "n").agg(
        F.count_if(F.col("latency") <= F.col("value")).alias("upto"), F.count_if(F.col("latency") < F.col("value")).alias("below"))
    bound = F.lit(telemetry.rank_bound()) + 1 / F.col("n")
    return ranks.select("start", "model", "prob", "n", (
        (F.col("upto") / F.col("n") >= F.col("prob") - bound) & (F.col("below") / F.col("n") <= F.col("prob") + bound)).alias("within"))


@query("error_ratio", REQ + f"""
, r AS (SELECT model, status, {start_sql(HOUR)} FROM requests)
SELECT start, model, count(*) AS requests, count(*) FILTER (starts_with(status, '5')) AS errors,
       round(count(*) FILTER (starts_with(status, '5')) / count(*) + 1e-10, 6) AS ratio FROM r GROUP BY ALL""")
def error_ratio(t):
    return telemetry.error_ratio(inputs.requests(t), ["model"], HOUR).select(
        start_of(), "model", "requests", "errors", rounded("ratio").alias("ratio"))


@query("status_counts", REQ + f"""
, r AS (SELECT status, {start_sql(HOUR)} FROM requests) SELECT start, status, count(*) AS requests FROM r GROUP BY ALL""")
def status_counts(t):
    return telemetry.status_counts(inputs.requests(t)).select(start_of(), "status", "requests")


@query("token_throughput", REQ + f"""
, r AS (SELECT model, prompt_tokens, completion_tokens, {start_sql(300)} FROM requests)
SELECT start, model, 'prompt' AS type, round(sum(prompt_tokens) / 300 + 1e-10, 6) AS rate FROM r GROUP BY start, model
UNION ALL SELECT start, model, 'completion', round(sum(completion_tokens) / 300 + 1e-10, 6) FROM r GROUP BY start, model""")
def token_throughput(t):
    return telemetry.token_throughput(inputs.requests(t)).select(
        start_of(), "model", "type", rounded("rate").alias("rate"))


@query("avg_batch_size", REQ + "SELECT model, round(avg(prompt_tokens) + 1e-10, 6) AS average FROM requests GROUP BY model")
def avg_batch_size(t):
    return telemetry.average_gauge(inputs.requests(t), ["model"], "prompt_tokens").withColumn("average", rounded("average"))


@query("counter_increase", """
WITH s AS (SELECT event_type, epoch_us(ts) // 3600000000 * 3600 AS start, value,
                  lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events)
SELECT start, event_type, round(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) + 1e-10, 6) AS increase
FROM s GROUP BY ALL""")
def counter_increase(t):
    samples = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    made = telemetry.counter_increase(samples, ["event_type"], HOUR, order=["ts", "event_id"])
    return made.select(start_of(), "event_type", rounded("increase").alias("increase"))


# -- jobs and gauges -----------------------------------------------------------------


JOBS_SQL = """
jobs AS (SELECT o_orderpriority AS queue, o_orderdate AS ts,
  CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' THEN 'failed'
       WHEN o_totalprice > 250000 THEN 'active' ELSE 'pending' END AS status FROM orders)"""
NOW = "2000-01-01 00:00:00"


def _jobs(t):
    s = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderpriority").alias("queue"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(s == "F", "succeeded").when(s == "O", "failed")
        .when(F.col("o_totalprice") > 250000, "active").otherwise("pending").alias("status"))


@query("job_status_counts", f"WITH {JOBS_SQL}" + f"""
SELECT queue, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'pending') AS pending,
       count(*) FILTER (status = 'succeeded' AND recent) AS succeeded, count(*) FILTER (status = 'failed' AND recent) AS failed
FROM (SELECT *, ts > TIMESTAMP '{NOW}' - INTERVAL 720 HOURS AND ts <= TIMESTAMP '{NOW}' AS recent FROM jobs) GROUP BY queue""")
def job_status_counts(t):
    now = F.lit(NOW).cast("timestamp")
    return telemetry.job_status_counts(_jobs(t), now, 720, ["queue"])


@query("job_success_rate", f"WITH {JOBS_SQL}" + """
SELECT queue, round(100.0 * count(*) FILTER (status = 'succeeded') / count(*) FILTER (status IN ('succeeded', 'failed')) + 1e-10, 6)
  AS success_rate FROM jobs GROUP BY queue""")
def job_success_rate(t):
    return telemetry.job_success_rate(_jobs(t), ["queue"]).withColumn("success_rate", rounded("success_rate"))


@query("job_duration", """
WITH f AS (SELECT l_orderkey, max(l_shipdate) AS finished FROM lineitem GROUP BY 1)
SELECT o_orderkey, (epoch_us(finished) - epoch_us(o_orderdate)) / 1000000 AS seconds FROM orders JOIN f ON l_orderkey = o_orderkey""")
def job_duration(t):
    """An order runs from its date to its last shipment."""
    done = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("finished"))
    jobs = t.orders.select("o_orderkey", F.col("o_orderdate").alias("started")).join(
        done, F.col("l_orderkey") == F.col("o_orderkey"))
    return telemetry.job_duration(jobs).select("o_orderkey", "seconds")


@query("request_timer", """
WITH f AS (SELECT l_orderkey AS request_id, min(l_shipdate) AS ts FROM lineitem GROUP BY 1)
SELECT request_id, (epoch_us(f.ts) - epoch_us(o_orderdate)) / 1000000 AS seconds FROM orders JOIN f ON request_id = o_orderkey""")
def request_timer(t):
    starts = t.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("ts"))
    ends = t.lineitem.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.min("l_shipdate").alias("ts"))
    return telemetry.request_timer(starts, ends)


@query("training_curves", """
SELECT user_id AS run_id, epoch_us(ts) // 86400000000 * 86400 AS start,
       round(avg(value) FILTER (event_type = 'view') + 1e-10, 6) AS eval_loss, round(avg(value) FILTER (event_type = 'click') + 1e-10, 6) AS loss
FROM events GROUP BY ALL""")
def training_curves(t):
    points = t.events.select(
        F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "value",
        F.when(F.col("event_type") == "view", "eval_loss").when(F.col("event_type") == "click", "loss")
        .otherwise("other").alias("metric"))
    return telemetry.training_curves(points, ["eval_loss", "loss"], 86400).select(
        "run_id", start_of(), rounded("eval_loss").alias("eval_loss"), rounded("loss").alias("loss"))


@query("gauge_utilisation", """
SELECT epoch_us(ts) // 86400000000 * 86400 AS start, event_type, round(avg(value / 500) + 1e-10, 6) AS mean_share,
       round(max(value / 500) + 1e-10, 6) AS peak_share, round(max(value * 1048576) / 1048576 + 1e-10, 6) AS peak_mib FROM events GROUP BY ALL""")
def gauge_utilisation(t):
    samples = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"),
                              (F.col("value") * 1048576).alias("used"), F.lit(500.0 * 1048576).alias("total"))
    return telemetry.gauge_utilisation(samples, ["event_type"], 86400).select(
        start_of(), "event_type", *[rounded(c).alias(c) for c in ("mean_share", "peak_share", "peak_mib")])


@query("component_up", "SELECT user_id AS job, arg_max((event_type <> 'error')::INT, ts) AS latest FROM events GROUP BY user_id")
def component_up(t):
    samples = t.events.select(F.col("user_id").alias("job"), "ts", (F.col("event_type") != "error").cast("int").alias("value"))
    return telemetry.component_up(samples, ["job"])


@query("gauge_record", "SELECT user_id, event_type, arg_max(value, ts) AS latest FROM events GROUP BY ALL")
def gauge_record(t):
    return telemetry.gauge_latest(t.events, ["user_id", "event_type"])


# -- serving -------------------------------------------------------------------------


RULES = [("token", "code-model"), ("mail", "mail-model"), ("the", "english-model")]


@query("route_by_rule", """
SELECT doc_id, CASE WHEN contains(lower(text), 'token') THEN 'code-model' WHEN contains(lower(text), 'mail') THEN 'mail-model'
                    WHEN contains(lower(text), 'the') THEN 'english-model' ELSE 'base-model' END AS model FROM documents""")
def route_by_rule(t):
    return serving.route_by_rule(t.documents, RULES, "base-model").select("doc_id", "model")


@query("fallback_first_healthy", REQ + """
, health AS (SELECT (us // 3600000000) * 3600 AS start, model, count(*) FILTER (status = '500') * 4 <= count(*) AS healthy
            FROM requests GROUP BY ALL),
chains AS (SELECT * FROM (VALUES ('main', 'model-0', 0), ('main', 'model-1', 1), ('main', 'model-2', 2),
                                 ('spare', 'model-3', 0), ('spare', 'model-4', 1)) c(chain, model, position))
SELECT start, chain, arg_min(model, position) FILTER (healthy) AS model FROM chains JOIN health USING (model) GROUP BY start, chain""")
def fallback_first_healthy(t):
    """Hourly health from the error share; the chains are configuration."""
    hourly = inputs.requests(t).groupBy(F.window("ts", "1 hour").alias("window"), "model").agg(
        (F.count_if(F.col("status") == "500") * 4 <= F.count("*")).alias("healthy"))
    chains = serving.chain_table(t.spark, {"main": ["model-0", "model-1", "model-2"], "spare": ["model-3", "model-4"]})
    made = serving.fallback_first_healthy(chains, hourly.select(start_of(), "model", "healthy"), ["start", "chain"])
    return made.filter("start is not null")


BUCKET_SQL = "('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 100"


@query("canary_split", f"SELECT event_id AS request_id, {BUCKET_SQL} < 10 AS canary FROM events")
def canary_split(t):
    return serving.canary_split(inputs.requests(t), 10).select("request_id", "canary")


@query("canary_counts", f"""
SELECT count(*) AS total, (count(*) * 10 // 100) AS planned_canary, count(*) FILTER ({BUCKET_SQL} < 10) AS canary,
       count(*) FILTER ({BUCKET_SQL} >= 10) AS stable, count(*) - count(*) * 10 // 100 AS planned_stable FROM events""")
def canary_counts(t):
    return serving.canary_counts(serving.canary_split(inputs.requests(t), 10), 10)


@query("desired_replicas", REQ + """
, load AS (SELECT (us // 3600000000) * 3600 AS start, model, 3 AS replicas, count(*) * 20 AS utilization FROM requests GROUP BY ALL)
SELECT start, model, utilization, greatest(1, least(10, trunc(replicas * utilization / 70)))::BIGINT AS desired FROM load""")
def desired_replicas(t):
    load = inputs.requests(t).groupBy(F.window("ts", "1 hour").alias("window"), "model").agg(
        (F.count("*") * 20).alias("utilization")).withColumn("replicas", F.lit(3))
    return serving.desired_replicas(load).select(start_of(), "model", "utilization", F.col("desired").cast("long").alias("desired"))


@query("rate_limit_check", REQ + """
, w AS (SELECT request_id, count(*) OVER o AS requests_in_window, sum(prompt_tokens + completion_tokens) OVER o AS tokens_in_window
       FROM requests WINDOW o AS (PARTITION BY model ORDER BY us RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW))
SELECT request_id, requests_in_window, tokens_in_window::BIGINT AS tokens_in_window,
       requests_in_window >= 8 OR tokens_in_window >= 900 AS limited FROM w""")
def rate_limit_check(t):
    made = serving.rate_limit_check(inputs.requests(t), ["model"], 8, 900, seconds=7200, block_seconds=86_400)
    return made.select("request_id", "requests_in_window", "tokens_in_window", "limited")


# -- alerts --------------------------------------------------------------------------


# Events as a fleet's telemetry: time runs twenty times as fast, so that a minute holds several rows.
FLEET_SQL = """
WITH fleet AS (
  SELECT event_id, epoch_us(ts) // 20 AS us, (epoch_us(ts) // 20) // 60000000 * 60 AS mi, user_id, 'model-' || (user_id % 5) AS model,
         event_type, value FROM events),
requests AS (SELECT *, CASE event_type WHEN 'error' THEN '500' ELSE '200' END AS status, value / 40 AS latency FROM fleet)"""


def _fleet(t):
    us = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 20).cast("long")
    return t.events.select(
        "event_id", F.timestamp_micros(us).alias("ts"), "user_id", F.concat(F.lit("model-"), (F.col("user_id") % 5).cast("string")).alias("model"),
        "event_type", "value", F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"), (F.col("value") / 40).alias("latency"))


COMPONENTS = ("mlflow_up", "workflow_up", "milvus_up", "litellm_up")
RANGES = {"model_load_failures_10m": 10, "training_failures_5m": 5, "training_loss_increase_1h": 60, "run_failures_10m": 10, "s3_errors_5m": 5}

SIGNALS_SQL = f"""
, mins AS (SELECT model AS series, unnest(range(mi, mi + 300, 60)) AS tick, latency, status FROM requests),
cum AS (SELECT series, tick, le, count(*) FILTER (latency <= le) AS c FROM mins, {{bounds}} GROUP BY ALL),
cw AS (SELECT *, max(c) OVER (PARTITION BY series, tick) * 0.99 AS rank, coalesce(lag(le) OVER o, 0) AS low,
              coalesce(lag(c) OVER o, 0) AS below FROM cum WINDOW o AS (PARTITION BY series, tick ORDER BY le)),
cf AS (SELECT *, row_number() OVER (PARTITION BY series, tick ORDER BY le) AS n FROM cw WHERE c >= rank),
gauges AS (
  SELECT 'inference_up' AS signal, model AS series, us, mi, (event_type <> 'error')::DOUBLE AS value FROM fleet
  UNION ALL SELECT ['mlflow_up', 'workflow_up', 'milvus_up', 'litellm_up'][user_id % 4 + 1], 'main', us, mi,
                   (event_type IN ('view', 'click'))::DOUBLE FROM fleet
  UNION ALL SELECT 'gpu_utilization', model, us, mi, value / 20 FROM fleet
  UNION ALL SELECT 'gpu_memory_share', model, us, mi, value / 15 FROM fleet
  UNION ALL SELECT 'gpu_temperature', model, us, mi, value * 4 FROM fleet
  UNION ALL SELECT 'ray_missing_nodes', model, us, mi, floor(value / 10) FROM fleet
  UNION ALL SELECT 'run_seconds', model, us, mi, value * 4000 FROM fleet
  UNION ALL SELECT 'volume_share', model, us, mi, value / 10 FROM fleet),
newest AS (SELECT signal, series, mi, arg_max(value, us) AS value FROM gauges GROUP BY ALL),
held AS (SELECT signal, series, mi, unnest(range(mi, mi + 300, 60)) AS tick, value FROM newest),
grown AS (
  SELECT user_id % 5 AS k, model, mi, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS growth
  FROM (SELECT *, lag(value) OVER (PARTITION BY model ORDER BY us, event_id) AS prev FROM fleet)),
ranges AS (SELECT * FROM (VALUES {", ".join(f"('{{k}}', {{v}})".format(k=k, v=v) for k, v in RANGES.items())}) r(signal, minutes)),
jobs AS (SELECT 'user-' || user_id AS series, us, event_id, mi, (event_type <> 'error')::INT AS value FROM fleet),
moved AS (SELECT *, coalesce(value <> lag(value) OVER (PARTITION BY series ORDER BY us, event_id), false) AS moved FROM jobs),
jmin AS (SELECT series, mi, count(*) FILTER (moved) AS changes, arg_max(value, (us, event_id)) AS value FROM moved GROUP BY ALL),
jheld AS (SELECT series, mi, unnest(range(mi, mi + 3600, 60)) AS tick, changes, value FROM jmin),
grid AS (SELECT DISTINCT model AS series, unnest(range(mi, mi + 300, 60)) AS tick FROM fleet),
saves AS (SELECT DISTINCT model AS series, mi AS tick FROM fleet WHERE value > 150),
signals AS (
  SELECT 'error_ratio_5m' AS signal, series, tick, count(*) FILTER (status = '500') / count(*) AS value FROM mins GROUP BY series, tick
  UNION ALL SELECT 'latency_p99_5m', series, tick, CASE WHEN le = 'inf'::DOUBLE THEN 10 ELSE low + (le - low) * (rank - below) / (c - below) END
            FROM cf WHERE n = 1
  UNION ALL SELECT signal, series, tick, arg_max(value, mi) FROM held GROUP BY signal, series, tick
  UNION ALL SELECT signal, model, tick, sum(growth) FROM (
      SELECT signal, model, unnest(range(mi, mi + minutes * 60, 60)) AS tick, growth FROM grown, ranges) GROUP BY ALL
  UNION ALL SELECT 'training_unchanged_1h', series, tick, (sum(changes) = 0 AND arg_max(value, mi) = 1)::DOUBLE FROM jheld GROUP BY series, tick
  UNION ALL SELECT 'seconds_since_checkpoint', g.series, g.tick, (g.tick - s.tick)::DOUBLE FROM grid g ASOF JOIN saves s ON g.series = s.series AND g.tick >= s.tick)""".replace(
    "{bounds}", "(SELECT unnest([0.1, 0.25, 0.5, 1, 2.5, 5, 10, 'inf'::DOUBLE]) AS le)")


def _signals(t):
    """All signals of the rule table on a one-minute grid."""
    rows = _fleet(t)
    v, model = F.col("value"), F.col("model")
    at = signals.minute(F.col("ts"))
    # The newest row of each model and minute shows all of the model's gauges.
    shown = rows.groupBy(model.alias("series"), at.alias("from")).agg(F.max_by(F.struct("value", "event_type"), "ts").alias("_newest")).select("series", "from", "_newest.*")
    of_model = {"gpu_utilization": v / 20, "gpu_memory_share": v / 15, "gpu_temperature": v * 4, "ray_missing_nodes": F.floor(v / 10),
                "run_seconds": v * 4000, "volume_share": v / 10, "inference_up": (F.col("event_type") != "error").cast("double")}
    gauges = shown.select("series", "from", F.inline(F.array(*[
        F.struct(F.lit(k).alias("signal"), value.cast("double").alias("value")) for k, value in of_model.items()])))
    component = F.get(F.array(*map(F.lit, COMPONENTS)), (F.col("user_id") % 4).cast("int"))
    up = rows.groupBy(component.alias("signal"), at.alias("from")).agg(
        F.max_by(F.col("event_type").isin("view", "click").cast("double"), "ts").alias("value")).withColumn("series", F.lit("main"))
    counters = rows.select("ts", "event_id", "value", model.alias("series"))
    jobs = rows.select("ts", "event_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("series"),
                       (F.col("event_type") != "error").cast("int").alias("value"))
    grid = signals.ticks(shown.select("series", "from"), ["series"], signals.LOOKBACK).select("series", "at")
    saves = rows.filter("value > 150").select(model.alias("series"), at.alias("at")).distinct()
    since = alerts.staleness(saves, ["series"], grid).filter("value is not null").select(
        F.lit("seconds_since_checkpoint").alias("signal"), "series", "at", F.col("value").cast("double").alias("value"))
    parts = [signals.request_signals(rows), signals.held_gauges(gauges.unionByName(up)), signals.increase_signals(counters, RANGES, ["ts", "event_id"]),
             signals.unchanged_signal(jobs, "training_unchanged_1h", order=["ts", "event_id"]), since]
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made


RULES_SQL = ", rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r.name}', '{r.signal}', '{r.op}', {float(r.limit)}, {r.for_seconds}, '{r.severity}')" for r in alerts.RULES
) + """) r(rule, signal, op, upper, hold, severity)),
hit AS (SELECT rule, severity, hold, series, tick FROM signals JOIN rules USING (signal) WHERE CASE op WHEN '==' THEN value = upper ELSE value > upper END),
isl AS (SELECT *, tick - 60 * row_number() OVER (PARTITION BY rule, series ORDER BY tick) AS g FROM hit),
fired AS (
  SELECT rule, severity, series, min(tick) AS started_at, min(tick) + hold AS fired_at, max(tick) AS last_true_at
  FROM isl GROUP BY rule, severity, hold, series, g HAVING max(tick) >= min(tick) + hold)"""


@query("alert_signals", FLEET_SQL + SIGNALS_SQL + """
SELECT signal, count(*) AS steps, count(DISTINCT series) AS series, round(avg(value) + 1e-10, 4) AS mean, round(max(value) + 1e-10, 4) AS most
FROM signals GROUP BY signal""")
def alert_signals(t):
    per_series = _signals(t).groupBy("signal", "series").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.max("value").alias("most"))
    return per_series.groupBy("signal").agg(
        F.sum("n").alias("steps"), F.count("*").alias("series"), rounded(F.sum("s") / F.sum("n"), 4).alias("mean"),
        rounded(F.max("most"), 4).alias("most"))


@query("alert_rules", FLEET_SQL + SIGNALS_SQL + RULES_SQL + "SELECT * FROM fired")
def alert_rules(t):
    made = alerts.alert_intervals(_signals(t), alerts.rule_table(t.spark), signals.MINUTE)
    return made.select("rule", "severity", "series", "started_at", "fired_at", "last_true_at")


@query("alert_coverage", FLEET_SQL + SIGNALS_SQL + RULES_SQL + """
SELECT rule, signal, coalesce(s.n, 0) AS steps, coalesce(f.n, 0) AS firings FROM rules
LEFT JOIN (SELECT signal, count(*) AS n FROM signals GROUP BY signal) s USING (signal)
LEFT JOIN (SELECT rule, count(*) AS n FROM fired GROUP BY rule) f USING (rule)""")
def alert_coverage(t):
    """Every rule with its steps and firings; one without a signal would show 0 steps."""
    made, rules = _signals(t), alerts.rule_table(t.spark)
    return signals.rule_activity(made, alerts.alert_intervals(made, rules, signals.MINUTE), rules)


@query("checkpoint_staleness", REQ + """
, grid AS (SELECT DISTINCT model, us // 3600000000 * 3600 AS at FROM requests),
seen AS (SELECT DISTINCT model, us // 3600000000 * 3600 AS at FROM requests WHERE latency > 1)
SELECT model, g.at, g.at - max(s.at) AS value FROM grid g LEFT JOIN seen s USING (model)
WHERE s.at IS NULL OR s.at <= g.at GROUP BY model, g.at
UNION ALL SELECT model, g.at, NULL FROM grid g WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.model = g.model AND s.at <= g.at)""")
def checkpoint_staleness(t):
    """Hours since the last slow request, which stands for a saved checkpoint."""
    rows = inputs.requests(t).withColumn("at", (F.floor(F.unix_timestamp("ts") / HOUR) * HOUR).cast("long"))
    grid = rows.select("model", "at").distinct()
    saves = rows.filter("latency > 1").select("model", "at").distinct()
    return alerts.staleness(saves, ["model"], grid)


DAILY_SQL = """
day AS (SELECT *, us // 86400000000 * 86400 AS start FROM requests),
vals AS (SELECT start, model, 'error_rate' AS metric, count(*) FILTER (status = '500') / count(*) AS value FROM day GROUP BY ALL
         UNION ALL SELECT start, model, 'p99_latency', quantile_cont(latency, 0.99) FROM day GROUP BY ALL),
lim AS (SELECT * FROM (VALUES ('error_rate', 0.2), ('p99_latency', 2.0)) l(metric, upper))"""


def _daily(t):
    rows = inputs.requests(t).withColumn("start", (F.floor(F.unix_timestamp("ts") / 86400) * 86400).cast("long"))
    errors = rows.groupBy("start", "model").agg((F.count_if(F.col("status") == "500") / F.count("*")).alias("value"))
    p99 = telemetry.latency_quantiles(rows, ["start", "model"], [0.99])
    return errors.select("start", "model", F.lit("error_rate").alias("metric"), "value").unionByName(
        p99.select("start", "model", F.lit("p99_latency").alias("metric"), "value"))


def _limits(t):
    return t.spark.createDataFrame([("error_rate", 0.2), ("p99_latency", 2.0)], "metric string, upper double")


ROLLBACK_SQL = REQ + f", {DAILY_SQL}" + """
SELECT start, model, bool_or(value > upper) AS {flag},
       coalesce(string_agg(CASE WHEN value > upper THEN metric || ' ' || printf('%.2f', value + 1e-9) || ' > '
                           || printf('%.2f', upper) END, '; ' ORDER BY metric), '') AS reasons
FROM vals JOIN lim USING (metric) GROUP BY start, model"""


@query("threshold_join", ROLLBACK_SQL.replace("{flag}", "breached"))
def threshold_join(t):
    return evaluation.threshold_join(_daily(t), _limits(t), ["start", "model"])


@query("rollback_decision", ROLLBACK_SQL.replace("{flag}", "rollback"))
def rollback_decision(t):
    return evaluation.threshold_join(_daily(t), _limits(t), ["start", "model"]).withColumnRenamed("breached", "rollback")
