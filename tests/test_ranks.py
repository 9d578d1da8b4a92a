"""The rank cut against a plain order, and what its plan puts in one task."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import ranks, training


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    made = [(i, draw.choice([None, draw.randint(-50, 50), draw.randint(-2 ** 40, 2 ** 40)]), draw.choice("abc")) for i in range(3000)]
    return spark.createDataFrame(made, "id long, k long, s string").repartition(6).cache()


@pytest.mark.parametrize("n", [0, 1, 40, 900, 1300, 2500, 3000, 4000])
def test_smallest(rows, n):
    want = sorted(rows.collect(), key=lambda r: (r.k is not None, r.k or 0, r.s, r.id))[:n]
    got = ranks.smallest(rows, ["k", "s", "id"], n, in_one_task=7).collect()
    assert sorted(r.id for r in got) == sorted(r.id for r in want)


def test_many_ties_and_dates(spark):
    df = spark.range(2000).selectExpr("id", "DATE '2024-01-01' + CAST(id % 2 AS INT) AS d")
    got = ranks.smallest(df, ["d", "id"], 1200, in_one_task=10).collect()
    assert sorted(r.id for r in got) == sorted([i for i in range(2000) if i % 2 == 0] + [i for i in range(2000) if i % 2][:200])


def test_a_tenth_is_a_filter_and_no_top_n(spark):
    df = spark.range(20_000)
    made = training.seeded_sample(df, 2000, "id", in_one_task=16)
    plan = made._jdf.queryExecution().executedPlan().toString()
    limits = [int(x.split("=")[1].split(",")[0].rstrip(")")) for x in plan.split() if x.startswith("TakeOrderedAndProject(limit=")]
    assert limits and max(limits) <= 16 and "GlobalLimit" not in plan
    want = {r.id for r in df.orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), "id").limit(2000).collect()}
    assert {r.id for r in made.collect()} == want


def test_times_without_zone_are_cut_by_histogram(spark):
    df = spark.range(4000).selectExpr("id", "TIMESTAMP_NTZ'1969-12-31 23:50:00' + make_dt_interval(0, 0, 0, (id * 7919 % 4000) / 3) AS at")
    made = ranks.smallest(df, ["at", "id"], 2500, in_one_task=16)
    plan = made._jdf.queryExecution().executedPlan().toString()
    limits = [int(x.split("=")[1].split(",")[0].rstrip(")")) for x in plan.split() if x.startswith("TakeOrderedAndProject(limit=")]
    assert limits and max(limits) <= 16 and "GlobalLimit" not in plan
    want = sorted((r.at, r.id) for r in df.collect())[:2500]
    assert sorted((r.at, r.id) for r in made.collect()) == want
