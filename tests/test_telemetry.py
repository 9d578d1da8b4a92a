import pytest
from pyspark.sql import functions as F

from lodestrata.operators import alerts, serving, telemetry


def requests(spark, rows):
    """(second, model, status, latency) rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "request_id long, s long, model string, status string, latency double")
    return df.select("request_id", F.timestamp_seconds("s").alias("ts"), "model", "status", "latency",
                     F.lit(2).cast("long").alias("prompt_tokens"), F.lit(3).cast("long").alias("completion_tokens"))


def test_histogram_and_quantile(spark):
    df = requests(spark, [(0, "m", "200", v) for v in (0.05, 0.1, 0.2, 0.4, 20.0)])
    h = telemetry.latency_histogram(df, ["model"])
    assert [r["count"] for r in h.orderBy("le").collect()] == [2, 3, 4, 4, 4, 4, 4, 5]
    q = lambda p: telemetry.histogram_quantile(h, ["model"], p).first()["quantile"]
    assert q(0.2) == pytest.approx(0.05)
    assert q(0.5) == pytest.approx(0.1 + 0.15 * 0.5)
    assert q(0.99) == 10.0
    assert q(0.0) == 0.0


def test_counter_resets(spark):
    df = spark.createDataFrame([("a", 0, 5.0), ("a", 10, 8.0), ("a", 70, 2.0), ("a", 90, 4.0), ("b", 5, 9.0)], "k string, s long, value double")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    for block in (15, 86_400):
        made = telemetry.counter_increase(df, ["k"], 60, block_seconds=block)
        got = {(r["k"], int(r["window"]["start"].timestamp())): r["increase"] for r in made.collect()}
        assert got == {("a", 0): 3.0, ("a", 60): 4.0, ("b", 0): 0.0}


def test_rates(spark):
    df = requests(spark, [(10, "m", "200", 0.1), (200, "m", "500", 0.1), (310, "m", "200", 0.1)])
    assert [r["rate"] for r in telemetry.request_rate(df, ["model"]).orderBy("window").collect()] == [2 / 300, 1 / 300]
    assert telemetry.request_rate(df, ["model"], 300, 60).count() == 10
    assert telemetry.error_ratio(df, ["model"]).orderBy("window").first()["ratio"] == 0.5
    row = telemetry.server_stats(df).first()
    assert tuple(row)[:4] == (3, 6, 9, 1)


def test_peak_active(spark):
    df = requests(spark, [(0, "m", "200", 100.0), (20, "m", "200", 100.0), (30, "m", "200", 1.0), (300, "m", "200", 1.0), (300, "m", "200", 2.0)])
    for block in (1, 10, 3600):
        assert telemetry.peak_active(df, ["model"], block).first()["peak"] == 3
    assert telemetry.server_stats(df).first()["active"] == 2


def test_sketch_is_close(spark):
    df = spark.range(20_000).select(F.lit("m").alias("model"), (F.col("id") / 20_000).alias("latency"))
    for r in telemetry.latency_quantiles_sketch(df, ["model"]).collect():
        assert r["value"] == pytest.approx(r["prob"], abs=0.03)


def test_jobs(spark):
    df = spark.createDataFrame([("active", 0), ("pending", 0), ("succeeded", 90_000), ("succeeded", 0), ("failed", 99_000)],
                               "status string, s long").withColumn("ts", F.timestamp_seconds("s"))
    now = F.timestamp_seconds(F.lit(100_000))
    assert tuple(telemetry.job_status_counts(df, now).first()) == (1, 1, 1, 1)
    assert telemetry.job_success_rate(df, []).first()[0] == pytest.approx(200 / 3)
    assert telemetry.job_success_rate(df.filter("status = 'active'"), []).first()[0] is None


def test_alert_intervals(spark):
    assert len(alerts.RULES) == 23
    rules = alerts.rule_table(spark, [alerts.Rule("R", "x", ">", 1, 120, "warning", "c"), alerts.Rule("Z", "x", "==", 0, 0, "info", "c")])
    values = [(0, 2), (60, 2), (120, 2), (180, 0), (240, 2), (300, 2), (420, 2), (480, 3), (540, 3), (600, 3)]
    df = spark.createDataFrame([("x", "s", a, float(v)) for a, v in values], "signal string, series string, at long, value double")
    got = sorted((r["rule"], r["started_at"], r["fired_at"], r["last_true_at"]) for r in alerts.alert_intervals(df, rules, 60).collect())
    assert got == [("R", 0, 120, 120), ("R", 420, 540, 600), ("Z", 180, 180, 180)]


def test_staleness(spark):
    seen = spark.createDataFrame([("a", 5), ("a", 50)], "k string, at long")
    grid = spark.createDataFrame([("a", t) for t in (0, 10, 50, 70)], "k string, at long")
    got = [(r["at"], r["value"]) for r in alerts.staleness(seen, ["k"], grid).orderBy("at").collect()]
    assert got == [(0, None), (10, 5), (50, 0), (70, 20)]


def test_serving(spark):
    prompts = spark.createDataFrame([("Write Python Code",), ("What is this?",)], "text string")
    routed = serving.route_by_rule(prompts, [("code", "coder"), ("write", "writer")], "base")
    assert [r["model"] for r in routed.collect()] == ["coder", "base"]
    chains = serving.chain_table(spark, {"c": ["m1", "m2", "m3"], "d": ["m1"]})
    health = spark.createDataFrame([("m1", False), ("m2", True)], "model string, healthy boolean")
    assert {r["chain"]: r["model"] for r in serving.fallback_first_healthy(chains, health).collect()} == {"c": "m2", "d": None}
    load = spark.createDataFrame([(2, 30), (2, 90), (5, 70), (9, 500)], "replicas int, utilization int")
    assert [r["desired"] for r in serving.desired_replicas(load).collect()] == [1, 2, 5, 10]
    counts = serving.canary_counts(serving.canary_split(spark.range(1000).withColumnRenamed("id", "request_id"), 10), 10).first()
    assert (counts["planned_canary"], counts["planned_stable"]) == (100, 900)
    assert counts["canary"] + counts["stable"] == 1000 and 60 < counts["canary"] < 140


def test_rate_limit(spark):
    df = requests(spark, [(s, "m", "200", 0.1) for s in (0, 1, 2, 59, 60, 61)])
    made = serving.rate_limit_check(df, ["model"], max_requests=5, block_seconds=60).orderBy("ts").collect()
    assert [r["requests_in_window"] for r in made] == [1, 2, 3, 4, 4, 4]
    assert [r["tokens_in_window"] for r in made] == [5, 10, 15, 20, 20, 20]
    assert not any(r["limited"] for r in made)
