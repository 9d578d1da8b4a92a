"""Signals on a one-minute grid for the alert rules.

Raw rows are summed or reduced once per (series, minute). Ranges and lookbacks then work on those
rows alone: the newest row stands at each minute until the next one comes or its range ends, so the
cost follows the minutes and not the rows, and windows run over the minutes of a series.
All results are ``(signal, series, at, value)``, ``at`` in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.blocks import previous_row, time_block
from lodestrata.operators.telemetry import LATENCY_BOUNDS, histogram_quantile

MINUTE = 60
# A gauge stays at its last sample for so many minutes.
LOOKBACK = 5


def minute(ts: Column) -> Column:
    """Start of a timestamp's minute, in seconds."""
    return (F.floor(F.unix_micros(ts.cast("timestamp")) / 60_000_000) * MINUTE).cast("long")


def reached(at: Column, minutes: Column | int) -> Column:
    """The minutes whose range of so many minutes still holds this one."""
    span = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.explode(F.sequence(at, at + (span - 1) * MINUTE, F.lit(MINUTE).cast("long")))


def request_signals(requests: DataFrame, minutes: int = 5, bounds=LATENCY_BOUNDS) -> DataFrame:
    """Error ratio and 99th percentile (from latency buckets) of the last minutes, per model."""
    counts = [F.count_if(F.col("latency") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    names = [f"b{i}" for i in range(len(bounds))]
    each = requests.groupBy(F.col("model").alias("series"), minute(F.col("ts")).alias("at")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status").startswith("5")).alias("errors"), F.count("latency").alias("inf"), *counts)
    rolled = each.withColumn("at", reached(F.col("at"), minutes)).groupBy("series", "at").agg(
        *[F.sum(c).alias(c) for c in ("n", "errors", "inf", *names)])
    ratio = rolled.select(F.lit("error_ratio_5m").alias("signal"), "series", "at", (F.col("errors") / F.col("n")).alias("value"))
    buckets = rolled.select("series", "at", F.inline(F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(c).alias("count")) for b, c in zip([*bounds, float("inf")], [*names, "inf"])])))
    p99 = histogram_quantile(buckets, ["series", "at"], 0.99)
    return ratio.unionByName(p99.select(F.lit("latency_p99_5m").alias("signal"), "series", "at", F.col("quantile").alias("value")))


def ticks(each: DataFrame, keys: list[str], minutes: int, at: str = "from") -> DataFrame:
    """Every minute ``at`` at which a row of ``each`` is the newest of its keys and at most so many minutes old.

    A row stands until the next one comes, so minutes are made once and not per row that reaches them.
    """
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    last = F.least(F.col(at) + (minutes - 1) * MINUTE, F.coalesce(following - MINUTE, F.col(at) + (minutes - 1) * MINUTE))
    made = each.withColumn("_last", last)
    return made.withColumn("at", F.explode(F.sequence(F.col(at), F.col("_last"), F.lit(MINUTE).cast("long")))).drop("_last")


def held_gauges(each: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Samples ``(signal, series, from, value)``, one a minute at most, held for the lookback."""
    return ticks(each, ["signal", "series"], lookback).select("signal", "series", "at", "value")


def gauge_signals(samples: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """The newest sample of each ``(signal, series)``, held for the lookback; ``ts`` is unique per series."""
    each = samples.groupBy("signal", "series", minute(F.col("ts")).alias("from")).agg(F.max_by("value", "ts").alias("value"))
    return held_gauges(each, lookback)


def increase_signals(samples: DataFrame, minutes: dict[str, int], order: list[str] | None = None) -> DataFrame:
    """Growth of a counter ``(series, ts, value)`` over the range of each signal; a fall is a reset, after which the value counts from 0.

    Growth is summed per (series, minute) once; all ranges are window sums over the minutes that the longest one reaches.
    """
    rows = previous_row(samples, ["series"], order or ["ts"], ["value"], time_block(F.col("ts")))
    now, before = F.col("value"), F.col("prev_value")
    growth = F.when(before.isNull(), 0.0).when(now < before, now).otherwise(now - before)
    each = rows.groupBy("series", minute(F.col("ts")).alias("from")).agg(F.sum(growth).alias("growth"))
    grid = ticks(each, ["series"], max(minutes.values())).withColumn("growth", F.when(F.col("at") == F.col("from"), F.col("growth")))
    run = Window.partitionBy("series").orderBy("at")
    spans = sorted(set(minutes.values()))
    summed = grid.select("series", "at", "from", *[
        F.sum("growth").over(run.rangeBetween(-(m - 1) * MINUTE, 0)).alias(f"_{m}") for m in spans])
    return summed.select("series", "at", F.inline(F.filter(F.array(*[
        F.when(F.col("at") - F.col("from") < m * MINUTE, F.struct(F.lit(signal).alias("signal"), F.col(f"_{m}").alias("value")))
        for signal, m in minutes.items()]), lambda x: x.isNotNull()))).select("signal", "series", "at", "value")


def unchanged_signal(samples: DataFrame, signal: str, minutes: int = 60, order: list[str] | None = None) -> DataFrame:
    """1 where the last value of a series is 1 and it has not changed over the range, else 0."""
    rows = previous_row(samples, ["series"], order or ["ts"], ["value"], time_block(F.col("ts")))
    changed = F.coalesce(F.col("value") != F.col("prev_value"), F.lit(False))
    each = rows.groupBy("series", minute(F.col("ts")).alias("from")).agg(
        F.bool_or(changed).alias("changed"), F.max_by("value", F.struct(*(order or ["ts"]))).alias("value"))
    so_far = Window.partitionBy("series").orderBy("from").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("moved", F.max(F.when(F.col("changed"), F.col("from"))).over(so_far))
    quiet = F.col("moved").isNull() | (F.col("at") - F.col("moved") >= minutes * MINUTE)
    stuck = quiet & (F.col("value") == 1)
    return ticks(each, ["series"], minutes).select(F.lit(signal).alias("signal"), "series", "at", F.coalesce(stuck, F.lit(False)).cast("double").alias("value"))


def rule_activity(signals: DataFrame, intervals: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with its signal's steps and its firings; a rule without a signal shows 0 steps."""
    steps = signals.groupBy("signal").agg(F.count("*").alias("steps"))
    fired = intervals.groupBy("rule").agg(F.count("*").alias("firings"))
    joined = rules.select("rule", "signal").join(steps, "signal", "left").join(fired, "rule", "left")
    return joined.select("rule", "signal", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("steps", "firings")])
