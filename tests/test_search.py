import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import vectors
from lodestrata.operators import embedding, records, search


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(4, 12))
    # one crowded cell, exact copies and a zero vector
    m = np.vstack([centres[0] + 0.05 * rng.normal(size=(150, 12)), centres[rng.integers(0, 4, 150)] + 0.6 * rng.normal(size=(150, 12))])
    m = np.vstack([m, np.tile(m[3], (5, 1)), np.zeros((1, 12))])
    q = np.vstack([centres, rng.normal(size=(6, 12))])
    vec = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(m)], "id long, vector array<double>, tag int")
    ask = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, vector array<double>")
    return m, q, vec.repartition(6).cache(), ask


def brute(m, q, k):
    with np.errstate(invalid="ignore"):
        s = np.round((m @ q) / (np.linalg.norm(m, axis=1) * np.linalg.norm(q)), 9)
    order = [i for i in np.lexsort((np.arange(len(m)), -s)) if not np.isnan(s[i])]
    return [int(i) for i in order[:k]]


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_single_query_and_filter(data):
    m, q, vec, _ = data
    got = [r["id"] for r in search.vector_search(vec, q[0].tolist(), 7).collect()]
    assert got == brute(m, q[0], 7)
    got = [r["id"] for r in search.vector_search(vec, q[1].tolist(), 5, "tag = 1").collect()]
    keep = [i for i in brute(m, q[1], len(m)) if i % 3 == 1][:5]
    assert got == keep


def test_plan_is_a_top_k(data):
    _, q, vec, _ = data
    plan = search.vector_search(vec, q[0].tolist(), 7)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_batch(data):
    m, q, vec, ask = data
    want = {i: brute(m, v, 8) for i, v in enumerate(q)}
    assert ranked(search.vector_search_batch(vec, ask, 8)) == want
    assert search.vector_search_batch(vec, ask.limit(0), 8).count() == 0


def test_large_query_set_takes_the_cells(data):
    m, q, vec, ask = data
    want = {i: brute(m, v, 8) for i, v in enumerate(q)}
    assert ranked(search.vector_search_batch(vec, ask, 8, max_broadcast_bytes=0)) == want


def test_rows_without_direction_are_no_hits_on_either_path(spark):
    nan = float("nan")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, None), (5, [0.6, 0.8])], "id long, vector array<double>")
    ask = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [nan, 0.0]), (3, None)], "query_id int, vector array<double>")
    small = search.vector_search_batch(vec, ask.filter("query_id < 3"), 4)
    large = search.vector_search_batch(vec, ask, 4, max_broadcast_bytes=0)
    assert ranked(small) == ranked(large) == {1: [1, 5]}
    assert [r["id"] for r in search.vector_search(vec, [1.0, 0.0], 4).collect()] == [1, 5]


def test_cells_exact_with_split_cells_and_few_rows(data):
    m, q, vec, ask = data
    index = search.build_cells(vec, n_cells=5, rows_per_part=40)
    assert index.cells.groupBy("cell").count().agg(F.max("count")).first()[0] > 1
    for k, nprobe in ((8, 1), (200, 2), (400, 1)):
        got = ranked(search.search_cells(index, ask, k, nprobe=nprobe, exact=True))
        assert got == {i: brute(m, v, k) for i, v in enumerate(q)}
    approx = search.search_cells(index, ask, 8, nprobe=2)
    recall = search.recall_at_k(approx, search.vector_search_batch(vec, ask, 8), 8)
    assert recall.agg(F.avg("recall")).first()[0] > 0.6


def test_vector_arithmetic(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(vectors.l2_normalize(F.col("a")), vectors.cosine_similarity(F.col("a"), F.col("b"))).collect()
    assert [list(r) for r in got] == [[[0.6, 0.8], pytest.approx(0.96)], [[0.0, 0.0], None]]
    pooled = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 0), (2, [5.0, 5.0], 0)], "k int, vector array<double>, m int")
    got = {r["k"]: r["vector"] for r in vectors.mean_pool(pooled, ["k"], mask="m").collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0]}


def test_embedding(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "", None, "a b a", "zz Ä"])], "i int, text string")
    rows = {r["i"]: r for r in embedding.embed_chunks(df, embedding.hashing_model(16)).collect()}
    assert all(len(r["embedding"]) == 16 and r["model"] == "hashing-16" for r in rows.values())
    assert np.linalg.norm(rows[0]["embedding"]) == pytest.approx(1, abs=1e-6)
    assert rows[0]["embedding"] == rows[3]["embedding"] and not any(rows[1]["embedding"]) and not any(rows[2]["embedding"])
    once = {r["i"]: r["embedding"] for r in embedding.embed_distinct(df, embedding.hashing_model(16)).collect()}
    assert once == {i: r["embedding"] for i, r in rows.items()}


def test_own_model_sees_its_batch_size(spark):
    def load():
        calls = []

        def embed(values):
            calls.append(len(values))
            return np.array([[len(calls), len(values)] for _ in values], dtype=float)
        return embed

    model = embedding.EmbeddingModel("own", 2, lambda c: c, load, batch=2)
    df = spark.range(5).select("id", F.col("id").cast("string").alias("text")).coalesce(1)
    got = [tuple(r["embedding"]) for r in embedding.embed_chunks(df, model).orderBy("id").collect()]
    assert got == [(1, 2), (1, 2), (2, 2), (2, 2), (3, 1)]


def test_retrieve_contexts(data, spark):
    m, q, vec, ask = data
    hits = search.vector_search_batch(vec, ask, 3)
    texts = vec.select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = {r["query_id"]: r["contexts"] for r in search.retrieve_contexts(hits, texts).collect()}
    assert got == {i: [f"t{j}" for j in brute(m, v, 3)] for i, v in enumerate(q)}


def test_records(spark):
    docs = spark.createDataFrame([(0, "a", None), (1, None, " "), (2, "x", "y")], "id int, a string, b string")
    got = sorted(r["message"] for r in records.validate_required_fields(docs, "id", ["a", "b"]).collect())
    assert got == ["Document 0: missing 'b'", "Document 1: missing 'a'", "Document 1: missing 'b'"]
    assert [r["id"] for r in records.valid_rows(docs, ["a", "b"]).collect()] == [2]
    merged = spark.range(1).select(records.merge_metadata(F.lit("s"), F.lit(".md"), F.create_map(F.lit("source"), F.lit("own"))))
    assert merged.first()[0] == {"source": "own", "doc_type": ".md"}


@pytest.mark.parametrize("distinct", [False, True])
def test_best_holds_few_candidates(monkeypatch, distinct):
    """Cut again and again: the same hits as from one sort, and never more than the bound and k a query at once."""
    monkeypatch.setattr(search, "WAITING", 50)
    rng = np.random.default_rng(8)
    keys, scores = rng.integers(0, 60, 300), np.round(rng.normal(size=(6, 300)), 1)
    scores[:, 17] = np.nan
    asked, k = np.array([0, 1, 2, 3, 3, 4]), 7  # one query comes twice
    best, most = search.Best(np.full(5, -np.inf), k, distinct), 0
    for i in range(0, 300, 5):
        best.offer(asked, keys[i:i + 5], scores[:, i:i + 5])
        most = max(most, sum(len(p[0]) for p in best.parts))
    got = {}
    for f in best.frames(np.array(list("abcde"), dtype=object), "q", "id", rows=4):
        assert len(f) <= 4
        for r in f.itertuples():
            got.setdefault(r.q, []).append((-r.score, r.id))
    want = {}
    for a, row in zip(asked, scores):
        want.setdefault("abcde"[a], []).extend((-s, i) for i, s in zip(keys, row) if not np.isnan(s))
    for q, found in want.items():
        if distinct:
            found = [(min(s for s, j in found if j == i), i) for i in {i for _, i in found}]
        assert sorted(got[q]) == sorted(found)[:k]
    assert most <= 50 + 30 + 5 * k


def test_batch_with_repeated_and_null_queries_and_copies(spark, monkeypatch):
    """Small tiles and cuts give the hits of one whole sort; a null query id has none."""
    monkeypatch.setattr(search, "SCORE_BLOCK_BYTES", 800)
    monkeypatch.setattr(search, "WAITING", 20)
    rng = np.random.default_rng(9)
    m = rng.normal(size=(120, 4))
    m[40:80] = m[0]
    q = [m[0], m[5], rng.normal(size=4), np.zeros(4), m[7]]
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>").repartition(3)
    ask = spark.createDataFrame([("a", q[0].tolist()), ("b", q[1].tolist()), ("c", q[2].tolist()), ("z", q[3].tolist()), (None, q[4].tolist()), ("b", q[1].tolist())],
                                "query_id string, vector array<double>")
    got = ranked(search.vector_search_batch(vec, ask, 6))
    twice = [i for i in brute(m, q[1], 3) for _ in range(2)]
    assert got == {"a": brute(m, q[0], 6), "b": twice, "c": brute(m, q[2], 6)}
