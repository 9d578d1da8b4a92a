"""Streaming queries: the given tables drained as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.chunking import fixed_chunks
from lodestrata.operators import alerts, telemetry
from lodestrata.plans import inputs
from lodestrata.plans.books import stopping_sql
from lodestrata.plans.inputs import rounded
from lodestrata.plans.catalog import Tables, query
from lodestrata.plans.corpus import FIXED_CHUNKS_SQL, OVERLAP, SIZE
from lodestrata.plans.fleet import BOUNDS_SQL, HOUR, LE_SQL, REQ, ROLLED, shown_bound, start_sql, within_rank
from lodestrata.sources.documents import is_folder
from lodestrata.streaming import rates, tables
from lodestrata.streaming.alerts import silence_rules, stream_alerts, stream_silence
from lodestrata.streaming.run import new_folder, run_available


class StreamedTables(Tables):
    """The same tables as file streams; a table is one file or a folder of files."""

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        feed = self.spark.readStream.schema(self.spark.read.parquet(path).schema)
        # a file source watches folders: a single file is picked out of the folder it lies in
        return feed.parquet(path) if is_folder(self.spark, path) else feed.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def _requests(t):
    return inputs.requests(StreamedTables(t.spark, t.folder))


# A window is out once the watermark, ten minutes behind the newest row, has passed its end.
CLOSED_SQL = "start + {seconds} <= (SELECT max(us) - 600000000 FROM requests) / 1000000"


@query("stream_request_rate", REQ + f"""
, r AS (SELECT model, {start_sql(HOUR)} FROM requests)
SELECT start, model, count(*) AS requests, round(count(*) / 3600 + 1e-10, 6) AS rate FROM r
WHERE {CLOSED_SQL.format(seconds=HOUR)} GROUP BY ALL""")
def stream_request_rate(t):
    made = run_available(rates.stream_request_rate(_requests(t), HOUR), new_folder(t.spark))
    return made.withColumn("rate", rounded("rate"))


@query("stream_error_ratio", REQ + f"""
, r AS (SELECT model, status, {start_sql(HOUR)} FROM requests)
SELECT start, model, count(*) AS requests, count(*) FILTER (status = '500') AS errors,
       round(count(*) FILTER (status = '500') / count(*) + 1e-10, 6) AS ratio FROM r
WHERE {CLOSED_SQL.format(seconds=HOUR)} GROUP BY ALL""")
def stream_error_ratio(t):
    made = run_available(rates.stream_error_ratio(_requests(t), HOUR), new_folder(t.spark))
    return made.withColumn("ratio", rounded("ratio"))


@query("stream_latency_histogram", REQ + f""", {BOUNDS_SQL},
r AS (SELECT model, latency, {start_sql(HOUR)} FROM requests)
SELECT start, model, {LE_SQL}, count(*) FILTER (latency <= le) AS count FROM r, bounds
WHERE {CLOSED_SQL.format(seconds=HOUR)} GROUP BY start, model, bounds.le""")
def stream_latency_histogram(t):
    made = run_available(rates.stream_latency_histogram(_requests(t), HOUR), new_folder(t.spark))
    return made.select("start", "model", shown_bound(), "count")


@query("stream_alerts", REQ + f"""
, r AS (SELECT model, status, {start_sql(HOUR)} FROM requests),
ratios AS (SELECT model, start, count(*) FILTER (status = '500') / count(*) AS ratio FROM r
           WHERE {CLOSED_SQL.format(seconds=HOUR)} GROUP BY ALL),
rules AS (SELECT * FROM (VALUES ('InferenceHighErrorRate', 0.01), ('InferenceCriticalErrorRate', 0.05)) v(rule, upper)),
isl AS (SELECT rule, model, start, start - 3600 * row_number() OVER (PARTITION BY rule, model ORDER BY start) AS g
        FROM ratios JOIN rules ON ratio > upper)
SELECT rule, model AS series, 'firing' AS event, min(start) AS started_at, min(start) + 3600 AS fired_at
FROM isl GROUP BY rule, model, g HAVING max(start) > min(start)""")
def streamed_alerts(t):
    """One stream closes the hourly error ratios, a second one reads them and keeps alert state."""
    first, second = new_folder(t.spark), new_folder(t.spark)
    closed = run_available(rates.stream_error_ratio(_requests(t), HOUR), first)
    steps = t.spark.readStream.schema(closed.schema).parquet(f"{first}/out").select(
        F.lit("error_ratio_5m").alias("signal"), F.col("model").alias("series"), F.col("start").alias("at"),
        F.col("ratio").alias("value"))
    made = run_available(stream_alerts(steps, alerts.rule_table(t.spark), HOUR), second)
    return made.filter("event = 'firing'").select("rule", "series", "event", "started_at", F.col("at").alias("fired_at"))


@query("stream_latency_rollup", REQ + f"""
, r AS (SELECT model, latency, {start_sql(HOUR)} FROM requests WHERE {CLOSED_SQL.format(seconds=60).replace("start", "us // 60000000 * 60")}),
p AS (SELECT unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS prob)
SELECT start, model, prob, count(latency) AS n, true AS within FROM r, p GROUP BY ALL""")
def stream_latency_rollup(t):
    """Minute sketches written by a stream, merged into hourly quantiles by a batch."""
    made = run_available(rates.stream_latency_rollups(_requests(t)), new_folder(t.spark))
    rows = inputs.requests(t)
    closed = rows.withColumn("minute", (F.floor(F.unix_micros("ts") / 60_000_000) * 60).cast("long")).join(
        made.select("model", F.col("start").alias("minute")), ["model", "minute"], "left_semi")
    return within_rank(closed, telemetry.rolled_quantiles(made, ["model"], HOUR, ROLLED), HOUR)


@query("stream_counter_increase", """
WITH s AS (SELECT event_type, epoch_us(ts) // 1000000 AS sec, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL),
d AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY sec) AS prev FROM s)
SELECT sec // 3600 * 3600 AS start, event_type, round(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) + 1e-10, 6) AS increase
FROM d WHERE sec <= (SELECT max(sec) - 600 FROM s) GROUP BY ALL""")
def stream_counter_increase(t):
    """Counters read once a second: growth by keyed state, summed by hour."""
    first, second = new_folder(t.spark), new_folder(t.spark)
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    seconds = t.events.groupBy(F.col("event_type").alias("series"), at.alias("at")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    seconds.write.parquet(f"{first}/in")
    feed = t.spark.readStream.schema(seconds.schema).parquet(f"{first}/in")
    made = run_available(rates.stream_counter_growth(feed), second)
    hour = (F.floor(F.col("at") / HOUR) * HOUR).cast("long")
    return made.groupBy(hour.alias("start"), F.col("series").alias("event_type")).agg(rounded(F.sum("growth")).alias("increase"))


@query("stream_silence", """
WITH fleet AS (SELECT 'model-' || (user_id % 5) AS series, epoch_us(ts) // 20000000 AS sec, value, event_type FROM events),
-- one sample a second at most: the last row of a second stands for it
saves AS (SELECT DISTINCT series, sec, 0 AS value FROM fleet WHERE value > 150),
jobs AS (SELECT series, sec, max((event_type <> 'error')::INT) AS value FROM fleet WHERE value > 40 GROUP BY ALL),
moved AS (SELECT series, sec, value FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY sec) AS before FROM jobs) WHERE before IS NULL OR before <> value),
samples AS (SELECT 'CheckpointMissing' AS rule, 3600 AS quiet, 600 AS hold, series, sec, true AS watched FROM saves
            UNION ALL SELECT 'TrainingJobStuck', 3600, 7200, series, sec, value = 1 FROM moved),
now AS (SELECT max(sec) AS sec FROM (SELECT sec FROM saves UNION ALL SELECT sec FROM jobs)),
gaps AS (SELECT s.*, coalesce(lead(s.sec) OVER (PARTITION BY rule, series ORDER BY s.sec), now.sec) AS until,
                lead(s.sec) OVER (PARTITION BY rule, series ORDER BY s.sec) AS next FROM samples s, now),
fired AS (SELECT * FROM gaps WHERE watched AND until > sec + quiet + hold)
SELECT rule, series, 'firing' AS event, sec + quiet AS started_at, sec + quiet + hold AS fired_at FROM fired
UNION ALL SELECT rule, series, 'resolved', sec + quiet, next FROM fired WHERE next IS NOT NULL""")
def streamed_silence(t):
    """Checkpoints that stay out and jobs that stay as they are fire by timers, without a row."""
    fleet = StreamedTables(t.spark, t.folder).events.select(
        F.concat(F.lit("model-"), (F.col("user_id") % 5).cast("string")).alias("series"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 20_000_000).cast("long").alias("at"), "value", "event_type")
    first, second = new_folder(t.spark), new_folder(t.spark)
    kinds = F.filter(F.array(
        F.when(F.col("value") > 150, F.struct(F.lit("checkpoint_saved").alias("signal"), F.lit(0.0).alias("value"))),
        F.when(F.col("value") > 40, F.struct(F.lit("training_job_active").alias("signal"), (F.col("event_type") != "error").cast("double").alias("value")))),
        lambda x: x.isNotNull())
    seconds = run_available(fleet.select("series", "at", F.inline(kinds)), first).groupBy("signal", "series", "at").agg(F.max("value").alias("value"))
    seconds.write.parquet(f"{first}/seconds")
    samples = t.spark.readStream.schema(seconds.schema).parquet(f"{first}/seconds")
    made = run_available(stream_silence(samples, silence_rules(alerts.rule_table(t.spark))), second)
    return made.select("rule", "series", "event", "started_at", F.col("at").alias("fired_at"))


@query("stream_early_stopping", stopping_sql("user_id", 20, 0.5))
def stream_early_stopping(t):
    folder = new_folder(t.spark)
    evals = StreamedTables(t.spark, t.folder).events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("value").alias("metric"))
    tables.stream_early_stopping(evals, folder, patience=20, threshold=0.5).awaitTermination()
    return tables.stopping_state(t.spark, folder).select(
        "run_id", "evaluations", rounded("best").alias("best"), "stop_step", "stopped")


@query("stream_ingest", FIXED_CHUNKS_SQL + """
SELECT d.source || '/' || doc_id AS source, chunk_index, substr(md5(m.text), 1, 16) || '-' || chunk_index AS id
FROM made m JOIN documents d USING (doc_id)""")
def stream_ingest(t):
    folder = new_folder(t.spark)
    docs = StreamedTables(t.spark, t.folder).documents.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), "text")
    tables.stream_ingest(docs, folder, fixed_chunks(F.col("text"), SIZE, OVERLAP)).awaitTermination()
    return tables.ingested(t.spark, folder).select("source", F.col("chunk_index").cast("long").alias("chunk_index"), "id")


@query("stream_ingest_within", FIXED_CHUNKS_SQL + """
SELECT d.source || '/' || doc_id AS source, chunk_index, substr(md5(m.text), 1, 16) || '-' || chunk_index AS id
FROM made m JOIN documents d USING (doc_id)""")
def stream_ingest_within(t):
    """Every document lands twice within the day; keyed state that expires drops the second."""
    first, second = new_folder(t.spark), new_folder(t.spark)
    docs = t.documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), "text",
                              F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 3600).alias("landed_at"))
    docs.unionAll(docs).write.parquet(f"{first}/in")
    feed = t.spark.readStream.schema(docs.schema).parquet(f"{first}/in")
    tables.stream_ingest_within(feed, second, fixed_chunks(F.col("text"), SIZE, OVERLAP)).awaitTermination()
    made = t.spark.read.parquet(f"{second}/out")
    return made.select("source", F.col("chunk_index").cast("long").alias("chunk_index"), "id")
