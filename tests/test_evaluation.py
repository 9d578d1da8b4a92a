import pytest
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.operators import evaluation, judges


@pytest.fixture
def means(spark):
    return spark.createDataFrame(
        [("a", "m1", 0.8, True), ("a", "m2", 0.4, False), ("b", "m1", 0.9, True), ("b", "m2", 0.7, True)],
        "run string, metric string, score double, passed boolean")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_means(spark):
    scores = spark.createDataFrame([("r", "f", "1", "m", 0.5, True), ("r", "f", "2", "m", 1.0, False)], schemas.SCORE)
    assert rows(evaluation.metric_means(scores), "metric", "score", "passed", "cases") == [("m", 0.75, False, 2)]


def test_summaries_and_empty_runs(spark, means):
    runs = spark.createDataFrame([("a",), ("b",), ("none",)], "run string")
    got = rows(evaluation.ragas_summary(means, runs=runs), "run", "average_score", "passed")
    assert got == [("a", pytest.approx(0.6), False), ("b", pytest.approx(0.8), True), ("none", 0.0, True)]
    got = rows(evaluation.deepeval_summary(means, runs=runs), "run", "all_passed", "pass_rate")
    assert got == [("a", False, 0.5), ("b", True, 1.0), ("none", False, 0.0)]


def test_strict_pass_mark(spark):
    edge = spark.createDataFrame([("r", "m", 0.5, True)], "run string, metric string, score double, passed boolean")
    assert not evaluation.ragas_summary(edge).first()["passed"]


def test_overall_and_gate(spark, means):
    tox = spark.createDataFrame([("a", "toxicity", 0.1, True)], "run string, metric string, score double, passed boolean")
    merged = evaluation.merge_scores(means, tox)
    assert ("a", "deepeval_toxicity") in rows(merged, "run", "metric")
    both = means.withColumn("framework", F.lit("ragas")).unionByName(tox.withColumn("framework", F.lit("deepeval")))
    out = evaluation.overall_score(both)
    assert rows(out, "run", "passed") == [("a", False), ("b", True)]  # b never ran the second side
    ran = spark.createDataFrame([("b", "deepeval"), ("c", "ragas"), ("d", "deepeval"), ("e", "ragas"), ("e", "deepeval")], "run string, framework string")
    assert rows(evaluation.overall_score(both, ran=ran), "run", "overall_score", "passed")[1:] == [
        ("b", pytest.approx(0.8), False), ("c", 0.0, True), ("d", 0.0, False), ("e", 0.0, False)]
    only = evaluation.overall_score(both.filter("framework = 'deepeval'"))
    assert rows(only, "run", "passed") == [("a", True)]
    got = {r["run"]: r for r in out.collect()}
    assert got["a"]["overall_score"] == pytest.approx(1.3 / 3)
    assert got["a"]["overall_score_oriented"] == pytest.approx(2.1 / 3)
    assert not got["a"]["passed"] and got["b"]["passed"]  # b has no second side
    reasons = {r["run"]: (r["approved"], r["reason"]) for r in evaluation.quality_gate(out).collect()}
    assert reasons["a"] == (False, "Rejected: score 0.4333 < 0.7, not all metrics passed")
    assert reasons["b"] == (True, "Approved: score=0.8000 >= 0.7")
    assert evaluation.quality_gate(out, 0.4, False).filter("approved").count() == 2


def test_threshold_join(spark):
    values = spark.createDataFrame([("s", "error_rate", 0.15), ("s", "p99", 2500.0), ("t", "error_rate", 0.01), ("u", "other", 9.0)],
                                   "k string, metric string, value double")
    limits = spark.createDataFrame([("error_rate", 0.05), ("p99", 2000.0)], "metric string, upper double")
    got = {r["k"]: (r["breached"], r["reasons"]) for r in evaluation.threshold_join(values, limits, ["k"]).collect()}
    assert got == {"s": (True, "error_rate 0.15 > 0.05; p99 2500.00 > 2000.00"), "t": (False, ""), "u": (False, "")}


def test_ab(spark):
    a = spark.createDataFrame([("1", "m", 0.5), ("2", "m", 0.5), ("3", "m", 0.1)], "case_id string, metric string, score double")
    b = spark.createDataFrame([("1", "m", 0.7), ("2", "m", 0.5), ("4", "m", 0.1)], "case_id string, metric string, score double")
    r = evaluation.ab_summary(evaluation.ab_compare(a, b)).first()
    assert (r["cases"], r["paired"], r["wins_a"], r["wins_b"], r["ties"]) == (4, 2, 0, 1, 1)


def test_rag_scores(spark):
    df = spark.createDataFrame([
        ("1", "where is the cat", "The cat sat. Dogs fly high.", ["the cat sat here", "unrelated"], "the cat sat"),
        ("2", "q", "", [], None)], "case_id string, question string, answer string, contexts array<string>, ground_truth string")
    got = {(r["case_id"], r["metric"]): r["score"] for r in judges.rag_scores(df).collect()}
    assert got["1", "faithfulness"] == 0.5
    assert got["1", "context_precision"] == 1.0 and got["1", "context_recall"] == 1.0
    assert got["1", "context_relevancy"] == 0.5
    assert ("2", "faithfulness") not in got and got["2", "context_precision"] == 0.0
    same = judges.rag_scores(df, truth_from_answer=True).filter("case_id = '2' and metric = 'context_recall'")
    assert same.isEmpty()


def test_context_precision_counts_rank(spark):
    df = spark.createDataFrame([(["x", "a b", "y", "a b c"], "a b")], "c array<string>, t string")
    assert df.select(judges.context_precision(F.col("c"), F.col("t"))).first()[0] == pytest.approx((1 / 2 + 2 / 4) / 2)


def test_judge_hook(spark):
    def score(batches):
        for b in batches:
            yield b.assign(run="r", framework="own", metric="g_eval", score=0.9, success=True)[schemas.SCORE.names]

    cases = spark.createDataFrame([("1",), ("2",)], "case_id string")
    assert rows(evaluation.metric_means(judges.judge(cases, score)), "metric", "score", "cases") == [("g_eval", 0.9, 2)]


def test_vectors_of_a_case_come_from_one_worker_some_at_a_time(spark):
    import pandas as pd

    from lodestrata.operators.embedding import hashing_model, vector_udf, vectors_udf

    df = spark.createDataFrame([("1", "a b", "b c", ["b c"], None)], "case_id string, question string, answer string, contexts array<string>, ground_truth string")
    plan = judges.rag_scores(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    model, slots = hashing_model(8), pd.Series([[1, 2], None, []] * 700)
    pairs = list(vectors_udf(model, ["x", "y"]).func(iter([(slots, slots)])))
    one = list(vector_udf(model).func(iter([slots])))
    assert max(map(len, pairs)) == max(map(len, one)) == model.batch < len(slots)
    assert [v.tolist() for p in pairs for v in p["y"]] == [v.tolist() for p in one for v in p]
    assert sum(map(len, one)) == len(slots)
