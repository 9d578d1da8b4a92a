import pytest

from lodestrata import schemas
from lodestrata.plans.jobs import IngestConfig, evaluate, ingest


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# Title\n\n" + "A sentence here. " * 80 + "\n\n## Next\n\nmore text that is long enough to be kept.")
    (folder / "b.html").write_text("<p>" + "words of a page " * 40 + "</p>")
    (folder / "empty.txt").write_text(" \n ")
    return folder


def test_ingest(spark, corpus, tmp_path):
    config = IngestConfig(str(corpus), str(tmp_path / "table"), strategy="fixed", chunk_size=100, chunk_overlap=20)
    first = ingest(spark, config)
    rows = first.records.collect()
    assert first.metrics["documents_loaded"] == 3 and first.metrics["documents_chunked"] == 2
    assert first.metrics["vectors_stored"] == len(rows) > 10
    assert all(len(r["vector"]) == 384 and r["metadata"]["source"].startswith("file:") for r in rows)
    assert len({r["metadata"]["doc_type"] for r in rows}) == 2
    again = ingest(spark, config)
    assert again.metrics["vectors_stored"] == 0 and again.records.count() == len(rows)
    (corpus / "c.txt").write_text("new text " * 5)
    assert ingest(spark, config).records.count() == len(rows) + 1


def test_dry_run_and_checks(spark, corpus, tmp_path):
    made = ingest(spark, IngestConfig(str(corpus), strategy="semantic", dry_run=True))
    assert made.records.count() > 0 and not (tmp_path / "table").exists()
    plan = made.records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError):
        IngestConfig("x")
    with pytest.raises(ValueError):
        IngestConfig("x", "t", strategy="other")


def test_evaluate(spark):
    scores = spark.createDataFrame([
        ("a", "ragas", "1", "faithfulness", 0.9, True), ("a", "deepeval", "1", "relevance", 0.8, True),
        ("b", "ragas", "1", "faithfulness", 0.4, False)], schemas.SCORE)
    got = {r["run"]: (r["approved"], r["reason"]) for r in evaluate(scores).collect()}
    assert got["a"] == (True, "Approved: score=0.8500 >= 0.7")
    assert got["b"] == (False, "Rejected: score 0.4000 < 0.7, not all metrics passed")
