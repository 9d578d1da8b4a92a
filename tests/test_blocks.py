"""Blocked operators against pandas, with one key holding most rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import blocks


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 6, n).astype(str)),
        "step": rng.permutation(n) * 3,
        "v": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 40, n)),
    })
    rows = [(r.k, int(r.step), None if np.isnan(r.v) else float(r.v)) for r in pdf.itertuples()]
    return pdf.sort_values(["k", "step"]), spark.createDataFrame(rows, "k string, step long, v double").cache()


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_running_and_previous(frame, width):
    pdf, df = frame
    block = blocks.step_block(F.col("step"), width)
    got = blocks.running(df, ["k"], ["step"], block, sums={"s": F.col("v")}, mins={"lo": F.col("v")},
                         maxs={"hi": F.col("v")}, lasts={"last": F.col("v")}).toPandas().sort_values(["k", "step"])
    g = pdf.groupby("k")["v"]
    filled = pdf.assign(v=pdf["v"].fillna(0)).groupby("k")["v"].cumsum().where(g.ffill().notna().values)
    np.testing.assert_allclose(got["s"], filled)
    np.testing.assert_allclose(got["lo"], g.cummin().groupby(pdf["k"]).ffill())
    np.testing.assert_allclose(got["hi"], g.cummax().groupby(pdf["k"]).ffill())
    np.testing.assert_allclose(got["last"], g.ffill())
    before = blocks.running(df, ["k"], ["step"], block, lasts={"last": F.col("v")}, inclusive=False).toPandas()
    np.testing.assert_allclose(before.sort_values(["k", "step"])["last"], g.ffill().groupby(pdf["k"]).shift())
    prev = blocks.previous_row(df, ["k"], ["step"], ["v", "step"], block).toPandas().sort_values(["k", "step"])
    np.testing.assert_allclose(prev["prev_v"], g.shift())
    np.testing.assert_allclose(prev["prev_step"].astype(float), pdf.groupby("k")["step"].shift())


def test_trailing_range(spark):
    rng = np.random.default_rng(4)
    secs = np.sort(rng.integers(0, 3000, 400))
    rows = [(str(i % 2 if i % 3 else 0), int(s)) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for block in (60, 100, 5000):
        made = blocks.trailing_range(df, ["k"], "ts", 60, {"n": F.count(F.lit(1))}, block)
        want = sorted((k, s, sum(1 for a, b in rows if a == k and s - 60 < b <= s)) for k, s in rows)
        assert sorted((r["k"], r["s"], r["n"]) for r in made.collect()) == want


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500).astype(str), "v": np.round(rng.exponential(1, 500), 2)})
    pdf.loc[len(pdf)] = ["solo", 7.0]
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.33, 0.5, 0.99, 1.0]
    for width in (0.05, 1.0, 100.0):
        got = {(r["k"], r["prob"]): r["value"] for r in blocks.exact_quantiles(df, ["k"], "v", probs, width).collect()}
        want = {(k, p): g.quantile(p) for k, g in pdf.groupby("k")["v"] for p in probs}
        assert got.keys() == want.keys()
        for key in want:
            assert got[key] == pytest.approx(want[key])


def test_null_key_is_a_group(spark):
    rows = [(None if i % 2 else "a", i, float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, step long, v double")
    got = blocks.previous_row(df, ["k"], ["step"], ["v"], blocks.step_block(F.col("step"), 5)).collect()
    assert all(r["prev_v"] == (None if r["step"] < 2 else float((r["step"] - 2) % 7)) for r in got) and len(got) == 40
    sums = blocks.running(df, ["k"], ["step"], blocks.step_block(F.col("step"), 5), sums={"s": F.col("v")}).collect()
    assert {(r["k"], r["step"]): r["s"] for r in sums} == {
        (k, s): sum(v2 for k2, s2, v2 in rows if k2 == k and s2 <= s) for k, s, _ in rows}
    medians = {r["k"]: r["value"] for r in blocks.exact_quantiles(df, ["k"], "v", [0.5], 2.0).collect()}
    assert medians == {k: float(np.quantile([v for k2, _, v in rows if k2 == k], 0.5)) for k in (None, "a")}


def test_trailing_sums_in_single_passes(spark):
    """No frame slides, and null values, ties and block borders count as in a plain window."""
    draw = random.Random(5)
    rows = [(i, draw.choice(["a", None]), draw.randint(0, 900), draw.choice([None, None, 3, -2])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, s long, v long").withColumn("ts", F.timestamp_seconds("s"))
    for block in (60, 100, 600):
        made = blocks.trailing_range(df, ["k"], "ts", 60, {"n": F.count(F.lit(1)), "total": F.sum("v")}, block)
        assert "specifiedwindowframe(RangeFrame, -" not in made._jdf.queryExecution().executedPlan().toString()
        want = {}
        for i, k, s, _ in rows:
            seen = [r for r in rows if r[1] == k and s - 60 < r[2] <= s]
            some = [r[3] for r in seen if r[3] is not None]
            want[i] = (len(seen), sum(some) if some else None)
        assert {r.id: (r.n, r.total) for r in made.collect()} == want, block
