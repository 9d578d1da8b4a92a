"""Alerts over streams: keyed state for the ``for`` clause, and event-time timers for what does not come.

Both processors take rows in the order of their time whatever order they arrive in: rows wait in
keyed state until the watermark has passed them, a timer wakes their key, and rows later than
the watermark are dropped by Spark. State of a series is gone once nothing can fire or resolve.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestrata.operators.alerts import holds

OUT = "rule string, series string, event string, started_at long, at long"
# Rows that wait are kept by stretches of so many seconds: a call to the state store reads or writes a stretch, not a row.
STRETCH = 3600
# Rows of a key that are gathered before they are put into their stretches.
GATHERED = 500_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Operators with their own state need a store that keeps it by column family."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Rows of a key in the order of ``at`` once the watermark has passed them.

    A subclass says what it keeps of a row (``ROW``, after ``at``) and between rows (``STATE``), what a
    row does (``take``), what the passing of time does (``pass_time``) and when it next has to be woken (``wake_at``).
    """

    ROW, STATE = "", ""
    EVENT = ["rule", "series", "event", "started_at", "at"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch long", "rows binary")
        self.state = handle.getValueState("state", self.STATE)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gathered: list[tuple] = []
        for batch in rows:
            gathered.extend(batch[["at", *(c.split()[0] for c in self.ROW.split(", "))]].itertuples(index=False, name=None))
            if len(gathered) >= GATHERED:
                self._keep(gathered)
                gathered = []
        self._keep(gathered)
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield from self._advance(key, timerValues)

    def _keep(self, rows: list[tuple]) -> None:
        """Put rows into their stretches; of two rows at one time the later one stays."""
        parts: dict[int, dict] = {}
        for at, *row in rows:
            parts.setdefault(int(at) // STRETCH, {})[int(at)] = tuple(row)
        for stretch, part in parts.items():
            self._write(stretch, {**self._read(stretch), **part} if self.waiting.containsKey((stretch,)) else part)

    def _read(self, stretch: int) -> dict:
        return pickle.loads(self.waiting.getValue((stretch,))[0])

    def _write(self, stretch: int, rows: dict) -> None:
        self.waiting.updateValue((stretch,), (pickle.dumps(rows),))

    def _advance(self, key, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        state = self.state.get() if self.state.exists() else None
        events: list[tuple] = []
        times: list[int] = []
        for stretch in sorted(k[0] for k in self.waiting.keys()):
            rows = self._read(stretch)
            due = sorted(at for at in rows if at <= now)
            for at in due:
                state = self.take(self.pass_time(state, at, events), at, rows.pop(at), events)
            if rows:
                if due:
                    self._write(stretch, rows)
                times.append(min(rows))
                break
            self.waiting.removeKey((stretch,))
            if events:
                yield self._made(key, events)
                events = []
        state = self.pass_time(state, now, events)
        if state is None:
            self.state.clear()
        else:
            self.state.update(tuple(state))
        times += [t for t in [self.wake_at(state)] if t is not None]
        self._wake(min(times) if times else None)
        yield self._made(key, events)

    def _made(self, key, events: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *e) for e in events], columns=self.EVENT)

    def _wake(self, at: int | None) -> None:
        """One timer per key; a timer is due once the watermark is behind it, so it stands just before the time."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before * 1000 - 1)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at * 1000 - 1)
            self.timer.update((at,))

    def close(self) -> None:
        pass


class AlertState(InOrder):
    """Per (rule, series): start of the unbroken run, its last step and whether it fired.

    Signals have one row per series and grid step. A step that does not come ends the run like one on
    which the rule does not hold, as soon as the watermark has passed it.
    """

    ROW, STATE = "true boolean, for_seconds long", "started long, last long, fired boolean"

    def __init__(self, step: int):
        self.step = step

    def _end(self, state, at, events):
        if state[2]:
            events.append(("resolved", state[0], at))

    def pass_time(self, state, now, events):
        if state is not None and now > state[1] + self.step:
            self._end(state, state[1] + self.step, events)
            return None
        return state

    def take(self, state, at, row, events):
        true, hold = row
        if not true:
            if state is not None:
                self._end(state, at, events)
            return None
        started, _, fired = state or (at, at, False)
        if not fired and at - started >= hold:
            fired = True
            events.append(("firing", started, at))
        return started, at, fired

    def wake_at(self, state):
        return None if state is None else state[1] + self.step + 1


class SilenceState(InOrder):
    """Per (rule, series): since when nothing changed, the value since then, and whether that fired.

    A rule with ``unchanged`` watches for a change of value and only while it is 1; any row counts for the others.
    Silence of ``limit`` seconds starts the alert and ``for_seconds`` more fire it, without a row.
    """

    ROW, STATE = "value double, quiet long, for_seconds long, unchanged boolean", "since long, value double, quiet long, hold long, watched boolean, fired boolean"

    def pass_time(self, state, now, events):
        if state is None:
            return None
        since, value, quiet, hold, watched, fired = state
        if watched and not fired and now > since + quiet + hold:
            fired = True
            events.append(("firing", since + quiet, since + quiet + hold))
        return since, value, quiet, hold, watched, fired

    def take(self, state, at, row, events):
        value, quiet, hold, unchanged = row
        if state is not None and unchanged and value == state[1]:
            return state
        if state is not None and state[5]:
            events.append(("resolved", state[0] + state[2], at))
        return at, value, quiet, hold, not unchanged or value == 1, False

    def wake_at(self, state):
        return state[0] + state[2] + state[3] + 1 if state is not None and state[4] and not state[5] else None


def _timed(rows: DataFrame, lateness: str) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", lateness)


def stream_alerts(signals: DataFrame, rules: DataFrame, step: int, lateness: str = "0 seconds") -> DataFrame:
    """Firing and resolved events of ``signals(signal, series, at, value)``.

    Steps may arrive in any order within ``lateness``; a series that stops sending resolves when time passes its next step.
    """
    keyed_state(signals.sparkSession)
    tested = _timed(signals, lateness).join(rules, "signal").select(
        "rule", "series", "at", "ts", F.col("for_seconds").cast("long").alias("for_seconds"),
        F.coalesce(holds(F.col("value"), F.col("op"), F.col("limit")), F.lit(False)).alias("true"))
    return tested.groupBy("rule", "series").transformWithStateInPandas(
        statefulProcessor=AlertState(step), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


# Rules on what does not come: the signal of their samples, seconds of silence, whether only a change counts.
SILENCE = {"CheckpointMissing": ("checkpoint_saved", 3600, False), "TrainingJobStuck": ("training_job_active", 3600, True)}


def silence_rules(rules: DataFrame) -> DataFrame:
    """The rules on silence with the signal they watch: ``(rule, watched, quiet, for_seconds, unchanged)``."""
    chosen = None
    for name, (signal, quiet, unchanged) in SILENCE.items():
        row = rules.filter(F.col("rule") == name).select(
            "rule", F.lit(signal).alias("watched"), F.lit(quiet).cast("long").alias("quiet"),
            F.col("for_seconds").cast("long").alias("for_seconds"), F.lit(unchanged).alias("unchanged"))
        chosen = row if chosen is None else chosen.unionByName(row)
    return chosen


def stream_silence(samples: DataFrame, rules: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Firing and resolved events of rules on silence; ``samples(signal, series, at, value)`` are the raw changes."""
    keyed_state(samples.sparkSession)
    named = _timed(samples, lateness).join(rules, F.col("signal") == F.col("watched")).select(
        "rule", "series", "at", "ts", _plain(F.col("value")).alias("value"), "quiet", "for_seconds", "unchanged")
    return named.groupBy("rule", "series").transformWithStateInPandas(
        statefulProcessor=SilenceState(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def _plain(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))
