"""The sign index: its recall model, its recall on the tables, and what it probes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions.vectors import as_double
from lodestrata.operators import lsh, search


def test_likely_buckets_come_in_order_and_add_up():
    rng = np.random.default_rng(0)
    for _ in range(30):
        bits, angle = int(rng.integers(1, 9)), rng.uniform(0.05, 1.5)
        m = rng.normal(size=bits)
        from math import erfc
        flip = np.array([0.5 * erfc(abs(x) / np.tan(angle) / 2 ** 0.5) for x in m])
        own = lsh._buckets(m)
        chance = {b: np.prod([f if (b ^ own) >> i & 1 else 1 - f for i, f in enumerate(flip)]) for b in range(1 << bits)}
        assert np.isclose(sum(chance.values()), 1)
        every = lsh.likely_buckets(m, angle, 2.0)
        assert sorted(every) == list(range(1 << bits))
        assert all(chance[a] >= chance[b] - 1e-12 for a, b in zip(every[:-1], every[1:]))
        some = lsh.likely_buckets(m, angle, 0.7)
        assert sum(chance[b] for b in some) >= 0.7 - 1e-9 > sum(chance[b] for b in some[:-1]) - 2e-9


def test_model_of_the_chance_holds():
    """Neighbours at a known angle lie in the chosen buckets as often as promised."""
    rng = np.random.default_rng(1)
    hit = []
    for _ in range(400):
        q, g, directions = rng.normal(size=24), rng.normal(size=24), rng.normal(size=(7, 24))
        q /= np.linalg.norm(q)
        g -= g @ q * q
        angle = rng.uniform(0.2, 1.2)
        x = np.cos(angle) * q + np.sin(angle) * g / np.linalg.norm(g)
        hit.append(int(lsh._buckets(directions @ x)) in lsh.likely_buckets(directions @ q, angle, 0.8))
    assert np.mean(hit) > 0.76


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, scale):
    rows = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    queries = rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), as_double(F.col("vector")).alias("vector"))
    found = lsh.search_signs(lsh.build_sign_index(rows), queries, 10)
    exact = search.vector_search_batch(rows, queries, 10)
    recall = [r.recall for r in search.recall_at_k(found, exact, 10).collect()]
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.9


def test_close_neighbours_need_few_buckets():
    rng = np.random.default_rng(2)
    m = rng.normal(size=16) * 2
    assert len(lsh.likely_buckets(m, 0.05, 0.99)) < 40 < len(lsh.likely_buckets(m, 1.0, 0.9))


def test_crowded_buckets_copies_and_few_rows(spark):
    rng = np.random.default_rng(3)
    m = np.vstack([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(60, 8)), np.zeros((1, 8))])
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    ask = spark.createDataFrame([(0, m[0].tolist()), (1, m[310].tolist()), (2, [0.0] * 8), (3, None)], "query_id int, vector array<double>")
    index = lsh.build_sign_index(vec, rows_per_part=50)
    assert index.crowded.count() >= lsh.TABLES and index.rows.agg(F.max("part")).first()[0] >= 5
    exact = {(r.query_id, r.id, r["rank"]) for r in search.vector_search_batch(vec, ask.filter("query_id < 3"), 12).collect()}
    got = {(r.query_id, r.id, r["rank"]) for r in lsh.search_signs(index, ask, 12).collect()}
    assert {x for x in got if x[0] == 0} == {x for x in exact if x[0] == 0}
    assert len({x[:2] for x in got} & {x[:2] for x in exact}) >= 22 and {q for q, *_ in got} == {0, 1}
    # Asked for more than there is, all buckets are probed and every row with a direction comes back.
    assert lsh.search_signs(index, ask.filter("query_id < 2"), 1000).groupBy("query_id").count().collect() == [(0, 360), (1, 360)] or \
        {r["count"] for r in lsh.search_signs(index, ask.filter("query_id < 2"), 1000).groupBy("query_id").count().collect()} == {360}
    assert lsh.search_signs(lsh.build_sign_index(vec.limit(0)), ask, 3).count() == 0


def test_cost_limit_takes_the_likely_buckets():
    rng = np.random.default_rng(4)
    for _ in range(40):
        bits, angle, target = int(rng.integers(1, 10)), rng.uniform(0.05, 1.5), rng.uniform(0.3, 0.99)
        m = rng.normal(size=bits)
        cost, limit = lsh.cost_limit(m, angle, target)
        bit = np.arange(1 << bits)[:, None] >> np.arange(bits) & 1
        total = ((bit != (m > 0)) * cost).sum(axis=1)
        assert set(np.flatnonzero(total <= limit + 1e-9 * (1 + limit))) == set(lsh.likely_buckets(m, angle, target))
    # Nothing reaches this target: all buckets; at a right angle all are alike, so all are at the limit.
    assert lsh.cost_limit(m, 1.0, 2.0)[1] >= lsh.cost_limit(m, 1.0, 2.0)[0].sum() - 1e-6
    assert np.allclose(lsh.cost_limit(m, np.pi / 2, 0.5)[0], 0)


def test_probes_are_one_row_a_query_and_blocks_change_nothing(spark):
    """Wide probes of many buckets were listed with the query's vector on each: batches without a bound."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 6))
    m[350:] = m[:50]
    ids = [i if i < 390 else i - 200 for i in range(400)]  # some keys come twice
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m)], "id long, vector array<double>")
    index = lsh.build_sign_index(vec, bits=8)
    asked = index.rows.filter("table = 0 and id < 20").select(
        F.when(F.col("id") != 7, F.col("id")).alias("query_id"), F.col("_unit").alias("_target"), F.lit(float("-inf")).alias("_least"), F.lit(1.2).alias("_angle"))
    probes = lsh._probes(index, asked, 0.99)
    assert probes.count() == 20
    share, got = 1 - 0.01 ** (1 / lsh.TABLES), {}
    stored = index.rows.collect()
    unit = {tuple(r["_unit"]) for r in stored}
    assert len(unit) == 350
    for r in asked.collect():
        t = np.array(r["_target"])
        probed = [set(lsh.likely_buckets(d @ t, 1.2, share)) for d in index.directions]
        best = {}
        for s in stored:
            if s["bucket"] in probed[s["table"]]:
                best[s["id"]] = max(best.get(s["id"], -2), round(float(t @ np.array(s["_unit"])), 9))
        got[r["query_id"]] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
    for limit_bytes in (1 << 20, 3_000, 1):
        hits = lsh._rank(lsh._hits(index, probes, 5, "query_id", limit_bytes=limit_bytes), 5, "query_id", "id")
        made = {}
        for r in hits.orderBy("query_id", "rank").collect():
            made.setdefault(r["query_id"], []).append((r["id"], pytest.approx(r["score"], abs=2e-9)))
        assert made == got


def test_rows_of_a_bucket_lie_together(spark):
    rng = np.random.default_rng(6)
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)))], "id long, vector array<double>").repartition(5)
    rows = lsh.build_sign_index(vec, bits=3).rows.withColumn("task", F.spark_partition_id())
    assert rows.count() == 300 * lsh.TABLES
    assert rows.groupBy("table", "bucket").agg(F.countDistinct("task").alias("n")).agg(F.max("n")).first()[0] == 1
