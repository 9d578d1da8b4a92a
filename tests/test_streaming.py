from pyspark.sql import functions as F

from lodestrata.functions.chunking import fixed_chunks
from lodestrata.operators import alerts, training
from lodestrata.streaming import rates, tables
from lodestrata.streaming.alerts import silence_rules, stream_alerts, stream_silence
from lodestrata.streaming.run import run_available

REQ = "s long, model string, status string, latency double"


def landing(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_late_rows_are_dropped_and_windows_come_once(spark, tmp_path):
    landing(spark, tmp_path / "in", [(0, "m", "200", 0.1), (100, "m", "500", 0.1), (4000, "m", "200", 0.1)], REQ)
    stream = lambda: spark.readStream.schema(REQ).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("s"))
    first = run_available(rates.stream_error_ratio(stream(), 300), str(tmp_path / "w"))
    assert [(r["start"], r["requests"], r["errors"]) for r in first.collect()] == [(0, 2, 1)]
    landing(spark, tmp_path / "in", [(50, "m", "500", 0.1), (9000, "m", "200", 0.1)], REQ)
    second = run_available(rates.stream_error_ratio(stream(), 300), str(tmp_path / "w"))
    assert sorted((r["start"], r["requests"]) for r in second.collect()) == [(0, 2), (3900, 1)]


def test_alerts_across_batches(spark, tmp_path):
    schema = "signal string, series string, at long, value double"
    rules = alerts.rule_table(spark, [alerts.Rule("R", "x", ">", 1, 120, "warning", "c")])
    feed = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    # Times start at 600: a row at the epoch is not after the watermark a stream starts with.
    rows = [("x", "s", 600 + a, float(v)) for a, v in
            [(0, 2), (60, 2), (120, 2), (180, 0), (240, 2), (300, 2), (420, 2), (480, 3), (540, 3), (600, 3)]]
    for part in (rows[:2], rows[2:5], rows[5:]):
        landing(spark, tmp_path / "in", part, schema)
        out = run_available(stream_alerts(feed(), rules, 60), str(tmp_path / "w"))
    got = sorted((r["at"], r["event"], r["started_at"]) for r in out.collect())
    assert got == [(720, "firing", 600), (780, "resolved", 600), (1140, "firing", 1020)]


def drained(spark, folder, parts, schema, build):
    for part in parts:
        landing(spark, folder / "in", part, schema)
        out = run_available(build(spark.readStream.schema(schema).parquet(str(folder / "in"))), str(folder / "w"))
    return sorted((r["rule"], r["series"], r["at"], r["event"], r["started_at"]) for r in out.collect())


def test_alerts_of_shuffled_and_late_steps_and_of_a_series_that_stops(spark, tmp_path):
    schema = "signal string, series string, at long, value double"
    rules = alerts.rule_table(spark, [alerts.Rule("R", "x", ">", 1, 120, "warning", "c")])
    row = lambda s, at, v=2.0: ("x", s, 600 + at, v)
    parts = [
        [row("s", 120), row("s", 0), row("t", 60), row("t", 0)],  # 60 of s comes a batch later, within the lateness
        [row("s", 60), row("t", 120), row("t", 180)],
        [row("u", 1000, 0.0)],  # nothing more of s and t: both resolve by time alone
        [row("s", 60, 0.0), row("u", 2000, 0.0)],  # far too late, so dropped
    ]
    got = drained(spark, tmp_path, parts, schema, lambda feed: stream_alerts(feed, rules, 60, "90 seconds"))
    assert got == [("R", "s", 720, "firing", 600), ("R", "s", 780, "resolved", 600), ("R", "t", 720, "firing", 600), ("R", "t", 840, "resolved", 600)]


def test_rules_on_silence(spark, tmp_path):
    schema = "signal string, series string, at long, value double"
    rules = silence_rules(alerts.rule_table(spark))
    save, job = (lambda s, at: ("checkpoint_saved", s, at, None)), (lambda s, at, v: ("training_job_active", s, at, float(v)))
    parts = [
        [save("a", 10), save("b", 10), save("a", 3000), job("j", 100, 1), job("k", 100, 1), job("l", 100, 0)],
        [job("k", 5000, 0), job("j", 5000, 1), save("b", 4100)],  # b saves again in time, j says the same, k has changed
        [save("c", 8000)],  # a has been silent for over 4,200 seconds
        [save("a", 9000), save("c", 9500)],
        [job("l", 12_000, 0)],  # j is unchanged and active for three hours, l is not active
        [job("j", 13_000, 0)],
    ]
    got = drained(spark, tmp_path, parts, schema, lambda feed: stream_silence(feed, rules))
    assert [g for g in got if g[0] == "CheckpointMissing"] == [
        ("CheckpointMissing", "a", 7200, "firing", 6600), ("CheckpointMissing", "a", 9000, "resolved", 6600), ("CheckpointMissing", "b", 8300, "firing", 7700)]
    assert [g for g in got if g[0] == "TrainingJobStuck"] == [
        ("TrainingJobStuck", "j", 10_900, "firing", 3700), ("TrainingJobStuck", "j", 13_000, "resolved", 3700)]


def test_early_stopping_stream_equals_batch(spark, tmp_path):
    schema = "run_id string, step long, metric double"
    rows = [(f"r{i % 3}", i, 100 - i * 0.3 + (i * 7 % 11)) for i in range(200)]
    for part in (rows[:20], rows[20:150], rows[150:]):
        landing(spark, tmp_path / "in", part, schema)
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        tables.stream_early_stopping(feed, str(tmp_path / "w"), patience=9, threshold=0.4).awaitTermination()
    fields = ["run_id", "evaluations", "best", "stop_step", "stopped"]
    want = training.early_stopping(spark.createDataFrame(rows, schema), 9, 0.4)
    shown = lambda d: sorted(map(str, d.select(*fields).collect()))
    assert shown(tables.stopping_state(spark, str(tmp_path / "w"))) == shown(want)
    # The three drains were restarts of one stream; a batch writes the states of its own runs only.
    landing(spark, tmp_path / "in", [("r1", 500, 1.0)], schema)
    before = spark.read.parquet(str(tmp_path / "w/out")).count()
    tables.stream_early_stopping(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "w"), patience=9, threshold=0.4).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "w/out")).count() == before + 1


def test_ingest_skips_known_sources(spark, tmp_path):
    schema = "source string, text string"
    feed = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    chunks = fixed_chunks(F.col("text"), 20, 5)
    landing(spark, tmp_path / "in", [("a", "one two three four five six"), ("b", " ")], schema)
    tables.stream_ingest(feed(), str(tmp_path / "w"), chunks).awaitTermination()
    n = tables.ingested(spark, str(tmp_path / "w")).count()
    assert n == 2
    landing(spark, tmp_path / "in", [("a", "other text"), ("c", "new"), ("c", "new")], schema)
    tables.stream_ingest(feed(), str(tmp_path / "w"), chunks).awaitTermination()
    rows = tables.ingested(spark, str(tmp_path / "w")).collect()
    assert sorted(r["source"] for r in rows) == ["a", "a", "c"]
    # a document without chunks has been seen all the same
    landing(spark, tmp_path / "in", [("b", "text at last"), ("d", "more")], schema)
    tables.stream_ingest(feed(), str(tmp_path / "w"), chunks).awaitTermination()
    assert sorted(r["source"] for r in tables.ingested(spark, str(tmp_path / "w")).collect()) == ["a", "a", "c", "d"]


def test_counter_growth_across_restarts(spark, tmp_path):
    """Shuffled samples, resets and a late one give what the batch gives, whatever the batches."""
    schema = "series string, at long, value double"
    a = [(60 * (10 + i), v) for i, v in enumerate([5.0, 7.0, 7.0, 1.0, 4.0, 2.0, 3.0])]
    parts = [[("s", *a[1]), ("s", *a[0]), ("t", 700, 9.0)], [("s", *a[3]), ("s", *a[2])], [("s", *a[4]), ("s", *a[6]), ("s", *a[5])],
             [("t", 5000, 10.0), ("s", 5000, 3.0)], [("s", *a[2]), ("t", 9000, 1.0), ("s", 9000, 4.0)]]
    for part in parts:
        landing(spark, tmp_path / "in", part, schema)
        out = run_available(rates.stream_counter_growth(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "2 minutes"), str(tmp_path / "w"))
    got = sorted((r["series"], r["at"], r["growth"]) for r in out.collect())
    assert got == [("s", 600, 0.0), ("s", 660, 2.0), ("s", 720, 0.0), ("s", 780, 1.0), ("s", 840, 3.0), ("s", 900, 2.0), ("s", 960, 1.0),
                   ("s", 5000, 0.0), ("t", 700, 0.0), ("t", 5000, 1.0)]


def test_ingest_drops_a_source_that_comes_again_within_the_time(spark, tmp_path):
    schema = "source string, text string, landed long"
    feed = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("landed_at", F.timestamp_seconds("landed"))
    for part in ([("a", "one two three", 1000), ("b", "four", 1000)], [("a", "again", 1500), ("c", "five", 1600)], [("d", "far on", 90_000)], [("e", "on", 90_001), ("a", "much later", 90_001)]):
        landing(spark, tmp_path / "in", part, schema)
        tables.stream_ingest_within(feed(), str(tmp_path / "w"), fixed_chunks(F.col("text"), 20, 5), "1 hour").awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "w/out"))
    assert sorted((r["source"], r["text"]) for r in rows.collect()) == [
        ("a", "much later"), ("a", "one two three"), ("b", "four"), ("c", "five"), ("d", "far on"), ("e", "on")]


def test_tables_that_are_folders_of_files(spark, folder, tmp_path):
    """A streamed table gives the same rows as one file and as a folder of part files."""
    from lodestrata.plans import all_queries

    for name in ("documents", "events"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_ingest", "stream_request_rate"):
        build = all_queries()[name]
        got, want = ([tuple(r) for r in build(spark, f).collect()] for f in (str(tmp_path), folder))
        assert want and sorted(got) == sorted(want), name


class Kept(dict):
    """A map or value state in memory that counts its calls."""

    calls = 0

    def _called(self, made=None):
        Kept.calls += 1
        return made

    def updateValue(self, key, value):
        self[key] = self._called(value)

    def getValue(self, key):
        return self._called(self[key])

    def containsKey(self, key):
        return self._called(key in self)

    def removeKey(self, key):
        self._called(self.pop(key, None))

    def keys(self):
        return self._called(list(dict.keys(self)))

    def iterator(self):
        return self._called(list(self.items()))

    def exists(self):
        return "value" in self

    def get(self):
        return self["value"]

    def update(self, value):
        self["value"] = value


class Handle:
    getMapState = getValueState = lambda self, *a: Kept()
    registerTimer = deleteTimer = lambda self, *a: None


def test_waiting_rows_take_a_call_by_stretch():
    """20,000 samples of a counter wait and are taken in some dozen calls of the state store."""
    import types

    import pandas as pd

    made, Kept.calls = rates.CounterState(), 0
    made.init(Handle())
    at = lambda seconds: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: seconds * 1000)
    rows = pd.DataFrame({"at": range(20_000), "value": [float(i % 7) for i in range(20_000)]}).sample(frac=1.0, random_state=1)
    assert not sum(len(p) for p in made.handleInputRows(("s",), iter([rows[:9000], rows[9000:]]), at(-1)))
    out = pd.concat(made.handleExpiredTimer(("s",), at(12_345), None))
    assert list(out["at"]) == list(range(12_346))
    assert list(out["growth"]) == [0.0 if i == 0 or i % 7 == 0 else 1.0 for i in range(12_346)]
    rest = pd.concat(made.handleExpiredTimer(("s",), at(30_000), None))
    assert list(rest["at"]) == list(range(12_346, 20_000))
    assert Kept.calls < 200
