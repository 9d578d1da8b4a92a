"""Windowed telemetry over unbounded request streams.

The aggregates are those of the batch operators behind a watermark: a window is written
once, when the watermark passes its end, and rows later than that are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import telemetry
from lodestrata.streaming.alerts import InOrder, keyed_state

LATENESS = "10 minutes"


def _start() -> "F.Column":
    return F.unix_timestamp(F.col("window")["start"]).alias("start")


def stream_request_rate(requests: DataFrame, seconds: int = 300, slide: int | None = None, lateness: str = LATENESS) -> DataFrame:
    made = telemetry.request_rate(requests.withWatermark("ts", lateness), ["model"], seconds, slide)
    return made.select(_start(), "model", "requests", "rate")


def stream_error_ratio(requests: DataFrame, seconds: int = 300, lateness: str = LATENESS) -> DataFrame:
    made = telemetry.error_ratio(requests.withWatermark("ts", lateness), ["model"], seconds)
    return made.select(_start(), "model", "requests", "errors", "ratio")


def stream_latency_histogram(requests: DataFrame, seconds: int = 3600, lateness: str = LATENESS) -> DataFrame:
    keys = [telemetry.in_window(seconds).alias("window"), "model"]
    made = telemetry.latency_histogram(requests.withWatermark("ts", lateness), keys)
    return made.select(_start(), "model", "le", "count")


def stream_latency_rollups(requests: DataFrame, seconds: int = 60, lateness: str = LATENESS, k: int = 800) -> DataFrame:
    """One sketch per model and bucket, out once the watermark has passed the bucket; batch windows merge them."""
    made = requests.withWatermark("ts", lateness).groupBy(telemetry.in_window(seconds).alias("window"), "model").agg(
        F.kll_sketch_agg_double("latency", F.lit(k)).alias("sketch"), F.count("latency").alias("n"))
    return made.select(_start(), "model", "sketch", "n")


class CounterState(InOrder):
    """Per series the last sample; each later one adds its growth. A fall is a reset, after which the value counts from 0."""

    ROW, STATE = "value double", "value double"
    EVENT = ["series", "at", "growth"]

    def pass_time(self, state, now, events):
        return state

    def take(self, state, at, row, events):
        now = row[0]
        events.append((at, 0.0 if state is None else now if now < state[0] else now - state[0]))
        return (now,)

    def wake_at(self, state):
        return None


def stream_counter_growth(samples: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Growth ``(series, at, growth)`` of each sample of ``samples(series, at, value)`` over the one before it in time.

    ``at`` is a whole number that orders a series, one sample each, and ``ts`` its time: samples may come
    in any order within the lateness, which holds them back so long. Windows of any length sum the growth.
    """
    keyed_state(samples.sparkSession)
    kind = samples.schema["series"].dataType.simpleString()
    timed = samples.select("series", "at", F.timestamp_seconds("at").alias("ts"), F.col("value").cast("double").alias("value")).withWatermark("ts", lateness)
    return timed.groupBy("series").transformWithStateInPandas(
        statefulProcessor=CounterState(), outputStructType=f"series {kind}, at long, growth double", outputMode="Append", timeMode="EventTime")
