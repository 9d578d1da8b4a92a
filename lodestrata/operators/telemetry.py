"""Counters, histograms, windowed rates, quantiles and gauges over request and sample rows.

The grouped forms take a batch or a streaming DataFrame alike. A rate is an exact count
per second of its window; counter samples with resets go through ``counter_increase``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.blocks import exact_quantiles, previous_row, running, step_block, time_block

# Histogram bounds in seconds.
LATENCY_BOUNDS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
QUANTILES = (0.5, 0.95, 0.99)


def in_window(seconds: int, slide: int | None = None, ts: str = "ts") -> Column:
    """Tumbling or sliding window of event time."""
    return F.window(F.col(ts), f"{seconds} seconds", f"{slide or seconds} seconds")


def request_counters(requests: DataFrame) -> DataFrame:
    return requests.groupBy("model", "status").agg(F.count("*").alias("requests"))


def token_counters(requests: DataFrame) -> DataFrame:
    """Token totals by model and type; summed wide, then turned into rows."""
    sums = requests.groupBy("model").agg(
        F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"))
    return sums.unpivot(["model"], ["prompt", "completion"], "type", "tokens")


def _started() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _ended() -> Column:
    return _started() + F.round(F.col("latency") * 1_000_000).cast("long")


def server_stats(requests: DataFrame) -> DataFrame:
    """Totals of a server over its request rows, and the requests still active when the last one started."""
    newest = requests.agg(F.max(_started())).scalar()  # part of the one plan
    return requests.agg(
        F.count("*").alias("total_requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("generated_tokens"),
        F.count_if(F.col("status") != "200").alias("errors"),
        F.count_if(_ended() > newest).alias("active"),
    )


def peak_active(requests: DataFrame, keys: list[str], block_seconds: int = 3600) -> DataFrame:
    """Largest number of requests running at once, from starts (+1) and ends (-1).

    An end counts before a start at the same instant. Changes are summed per instant and then
    run in time blocks per key, so a busy key is many tasks.
    """
    marks = requests.select(*keys, F.explode(F.array(
        F.struct(_started().alias("at"), F.lit(1).alias("change")),
        F.struct(_ended().alias("at"), F.lit(-1).alias("change")))).alias("m"))
    steps = marks.groupBy(*keys, F.col("m.at").alias("at")).agg(F.sum("m.change").alias("change"))
    active = running(steps, keys, ["at"], step_block(F.col("at"), block_seconds * 1_000_000), sums={"active": F.col("change")})
    return active.groupBy(*keys).agg(F.max("active").alias("peak"))


def latency_histogram(requests: DataFrame, keys: list, bounds=LATENCY_BOUNDS, value: str = "latency") -> DataFrame:
    """Cumulative buckets ``(le, count)``; all bounds are counted in one pass over the rows."""
    names = [f"b{i}" for i in range(len(bounds))] + ["inf"]
    tests = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(value)]
    wide = requests.groupBy(*keys).agg(*[t.alias(n) for t, n in zip(tests, names)])
    rest = [c for c in wide.columns if c not in names]
    pairs = F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(n).alias("count"))
        for b, n in zip([*bounds, float("inf")], names)])
    return wide.select(*rest, F.inline(pairs))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile by linear interpolation inside cumulative buckets.

    The first bucket starts at 0; a rank in the unbounded bucket gives the last finite
    bound; null without observations. A key has as many rows as there are bounds.
    """
    order = Window.partitionBy(*keys).orderBy("le")
    every = Window.partitionBy(*keys)
    finite = F.when(F.col("le") < float("inf"), F.col("le"))
    rows = (
        buckets.withColumn("_total", F.max("count").over(every))
        .withColumn("_top", F.max(finite).over(every))
        .withColumn("_low", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
        .withColumn("_below", F.coalesce(F.lag("count").over(order), F.lit(0)))
    )
    rank = F.col("_total") * q
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * (rank - F.col("_below")) / (F.col("count") - F.col("_below"))
    value = F.when(F.col("le") == float("inf"), F.col("_top")).when(
        F.col("count") > F.col("_below"), inside).otherwise(F.col("_low"))
    hit = rows.filter((F.col("count") >= rank) & (F.col("_total") > 0))
    return hit.groupBy(*keys).agg(F.min_by(value, "le").alias("quantile"))


def request_rate(requests: DataFrame, keys: list[str], seconds: int = 300, slide: int | None = None) -> DataFrame:
    """Requests per second and window."""
    return requests.groupBy(in_window(seconds, slide).alias("window"), *keys).agg(
        F.count("*").alias("requests"), (F.count("*") / seconds).alias("rate"))


def error_ratio(requests: DataFrame, keys: list[str], seconds: int = 300, slide: int | None = None) -> DataFrame:
    """Share of 5xx answers per window, in one pass."""
    errors = F.count_if(F.col("status").startswith("5"))
    return requests.groupBy(in_window(seconds, slide).alias("window"), *keys).agg(
        F.count("*").alias("requests"), errors.alias("errors"), (errors / F.count("*")).alias("ratio"))


def status_counts(requests: DataFrame, seconds: int = 3600) -> DataFrame:
    return requests.groupBy(in_window(seconds).alias("window"), "status").agg(F.count("*").alias("requests"))


def token_throughput(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """Prompt and completion tokens per second by model and window."""
    sums = requests.groupBy(in_window(seconds).alias("window"), "model").agg(
        (F.sum("prompt_tokens") / seconds).alias("prompt"), (F.sum("completion_tokens") / seconds).alias("completion"))
    return sums.unpivot(["window", "model"], ["prompt", "completion"], "type", "rate")


def latency_quantiles(requests: DataFrame, keys: list[str], probs=QUANTILES, value: str = "latency",
                      bucket_width: float = 0.05, levels: int = 2) -> DataFrame:
    """Exact interpolated quantiles; a key that owns most rows is spread over value buckets."""
    return exact_quantiles(requests, keys, value, list(probs), bucket_width, levels)


def latency_quantiles_sketch(requests: DataFrame, keys: list[str], probs=QUANTILES, value: str = "latency") -> DataFrame:
    """Quantiles from a mergeable KLL sketch: bounded memory, one pass, approximate."""
    sketch = requests.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value)).alias("s"))
    values = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("s", F.lit(float(p))).alias("value"))
        for p in probs])
    return sketch.select(*keys, F.inline(values))


def latency_rollups(requests: DataFrame, keys: list[str], seconds: int = 60, value: str = "latency", ts: str = "ts", k: int = 800) -> DataFrame:
    """One stored sketch per key and bucket of time, ``start`` in seconds: what any longer window is merged from."""
    start = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")
    return requests.groupBy(*keys, start.alias("start")).agg(
        F.kll_sketch_agg_double(F.col(value), F.lit(k)).alias("sketch"), F.count(value).alias("n"))


def rolled_quantiles(rollups: DataFrame, keys: list[str], seconds: int, probs=QUANTILES) -> DataFrame:
    """Quantiles of longer windows from the rollups alone: sketches merge, so no request is read again.

    A sketch of size k is off by at most ``rank_bound(k)`` in rank with 99 % confidence, merged or not.
    """
    window = (F.floor(F.col("start") / seconds) * seconds).cast("long")
    merged = rollups.groupBy(*keys, window.alias("start")).agg(F.kll_merge_agg_double("sketch").alias("s"), F.sum("n").alias("n"))
    values = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("s", F.lit(float(p))).alias("value")) for p in probs])
    return merged.select(*keys, "start", "n", F.inline(values))


def rank_bound(k: int = 800) -> float:
    """The published rank error of a KLL sketch of size k, for one quantile."""
    return 2.296 / k ** 0.9723


def counter_increase(samples: DataFrame, keys: list[str], seconds: int, ts: str = "ts", value: str = "value",
                     order: list[str] | None = None, block_seconds: int = 3600) -> DataFrame:
    """Growth of a counter per window; a fall is a reset, after which the value counts from 0.

    The first sample of a series has nothing before it and adds nothing.
    """
    rows = previous_row(samples, keys, order or [ts], [value], time_block(F.col(ts), block_seconds))
    prev, now = F.col(f"prev_{value}"), F.col(value)
    step = F.when(prev.isNull(), 0.0).when(now < prev, now).otherwise(now - prev)
    return rows.groupBy(in_window(seconds, ts=ts).alias("window"), *keys).agg(F.sum(step).alias("increase"))


def job_status_counts(jobs: DataFrame, now: Column, hours: int = 24, keys: list[str] | None = None) -> DataFrame:
    """Active and pending jobs, and those succeeded or failed in the last hours."""
    recent = (F.col("ts") > now - F.expr(f"interval {hours} hours")) & (F.col("ts") <= now)
    return jobs.groupBy(*(keys or [])).agg(
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if((F.col("status") == "succeeded") & recent).alias("succeeded"),
        F.count_if((F.col("status") == "failed") & recent).alias("failed"),
    )


def job_success_rate(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Percent succeeded of those finished; null if none finished."""
    ok, bad = F.count_if(F.col("status") == "succeeded"), F.count_if(F.col("status") == "failed")
    return jobs.groupBy(*keys).agg((100.0 * ok / F.nullif(ok + bad, F.lit(0))).alias("success_rate"))


def job_duration(jobs: DataFrame) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return jobs.withColumn("seconds", (micros("finished") - micros("started")) / 1_000_000)


def training_curves(points: DataFrame, names: list[str], seconds: int, keys: list[str] = ["run_id"]) -> DataFrame:
    """Mean of each named metric per run and window, one column per name."""
    return points.groupBy(*keys, in_window(seconds).alias("window")).pivot("metric", names).agg(F.avg("value"))


def gauge_latest(samples: DataFrame, keys: list[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """Latest value of each gauge series; ``ts`` must be unique per series."""
    return samples.groupBy(*keys).agg(F.max_by(value, ts).alias("latest"))


component_up = gauge_latest


def gauge_utilisation(samples: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Used over total per window, as mean and peak, with the peak in MiB."""
    share = F.col("used") / F.nullif(F.col("total"), F.lit(0.0))
    return samples.groupBy(in_window(seconds).alias("window"), *keys).agg(
        F.avg(share).alias("mean_share"), F.max(share).alias("peak_share"),
        (F.max("used") / 1048576.0).alias("peak_mib"))


def average_gauge(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    return samples.groupBy(*keys).agg(F.avg(value).alias("average"))


def request_timer(starts: DataFrame, ends: DataFrame, key: str = "request_id") -> DataFrame:
    """Latency from start and end rows that share a request id."""
    begin = starts.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("_from"))
    finish = ends.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("_to"))
    return begin.join(finish, key).select(key, ((F.col("_to") - F.col("_from")) / 1_000_000).alias("seconds"))
