import json

import pytest
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.sources import artifacts, documents, sinks
from lodestrata.sources.vector_table import VectorTable


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"line\r\ntwo \xff bytes")
    (tmp_path / "sub" / "b.md").write_text("# head")
    (tmp_path / "c.TXT").write_text("upper suffix")
    (tmp_path / "d.csv").write_text("x")
    return tmp_path


def names(df):
    return sorted(r["source"].rsplit("/", 1)[1] for r in df.collect())


def test_directory_scan(spark, tree):
    df = documents.scan_local_documents(spark, str(tree))
    assert df.schema.names == schemas.DOCUMENT.names
    assert names(df) == ["a.txt", "b.md"]
    row = df.filter("doc_type = '.txt'").first()
    assert row["content"] == "line\ntwo  bytes"
    assert row["metadata"]["size"] == "17"


def test_single_file_is_not_filtered(spark, tree):
    assert names(documents.scan_local_documents(spark, str(tree / "d.csv"))) == ["d.csv"]


def test_missing_source(spark, tree):
    with pytest.raises(FileNotFoundError):
        documents.read_documents(spark, str(tree / "none"))


def test_prefix_scan_keeps_bytes_and_all_suffixes(spark, tree):
    assert names(documents.scan_object_store_documents(spark, f"file://{tree}/")) == ["a.txt", "b.md", "c.TXT", "d.csv"]
    df = documents.scan_object_store_documents(spark, f"file://{tree}/a")
    assert [r["content"] for r in df.collect()] == ["line\r\ntwo  bytes"]


def test_listing_reads_no_content(spark, tree):
    df = documents.list_objects(spark, f"file://{tree}/")
    assert df.count() == 4 and df.schema.names == ["key", "size", "last_modified"]
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_chunk_files(spark, tmp_path):
    rows = [{"text": "a", "chunk_index": 0, "start_char": 0, "end_char": 1, "metadata": {"source": "s"}}]
    (tmp_path / "x_chunks.json").write_text(json.dumps(rows * 2))
    (tmp_path / "other.json").write_text("[]")
    assert artifacts.read_chunks_json(spark, str(tmp_path)).count() == 2
    assert artifacts.read_chunks_json(spark, str(tmp_path / "x_chunks.json")).first()["metadata"] == {"source": "s"}


def test_eval_data_formats(spark, tmp_path):
    rows = [{"question": f"q{i}", "answer": "a", "contexts": ["c"], "ground_truth": None} for i in range(20)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schemas.RAG_SAMPLE)
    (tmp_path / "e.json").write_text(json.dumps(rows))
    df.write.parquet(str(tmp_path / "p"))
    df.write.json(str(tmp_path / "l"))
    df.select("question", "answer").write.option("header", True).csv(str(tmp_path / "c"))
    for path, fmt in (("e.json", "json"), ("p", "parquet"), ("l", "jsonl")):
        assert artifacts.load_eval_data(spark, str(tmp_path / path), fmt).count() == 20
    plain = artifacts.load_eval_data(spark, str(tmp_path / "c"), "csv", df.select("question", "answer").schema)
    assert plain.count() == 20
    df.select("question", "answer", F.to_json("contexts").alias("contexts"), "ground_truth").write.option("header", True).option(
        "escape", '"').csv(str(tmp_path / "n"))
    assert sorted(artifacts.load_eval_data(spark, str(tmp_path / "n"), "csv").collect()) == sorted(df.collect())
    pick = lambda parts: {r["question"] for r in artifacts.load_eval_data(
        spark, str(tmp_path / "p"), "parquet", num_samples=5).repartition(parts).collect()}
    assert pick(1) == pick(7) and len(pick(1)) == 5
    assert artifacts.load_eval_data(spark, str(tmp_path / "p"), "parquet", num_samples=50).count() == 20
    with pytest.raises(ValueError):
        artifacts.load_eval_data(spark, "x", "xml")


def test_training_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "i int, text string")
    assert sinks.write_training_jsonl(df, str(tmp_path / "t")) == {"num_samples": 30, "columns": ["i", "text"]}
    got = artifacts.load_training_data(spark, str(tmp_path / "t"), df.schema, "text", ["i"], 3)
    assert [r["i"] for r in got.collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="available"):
        artifacts.load_training_data(spark, str(tmp_path / "t"), df.schema, "body", ["i"])
    train, held = artifacts.load_train_eval_split(df, df, ["i"], 25)
    assert train.count() == 25 and held.count() == 2
    assert artifacts.load_train_eval_split(df, None, ["i"], 25)[1] is None


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, 0, 1, {"s": "x"})], schemas.CHUNK)
    sinks.write_chunks(chunks, str(tmp_path / "c"))
    assert spark.read.schema(schemas.CHUNK).json(str(tmp_path / "c")).collect() == chunks.collect()
    results = spark.createDataFrame([("r", 0.5)], "run string, score double")
    sinks.append_results(results, str(tmp_path / "r"), "2024-01-01 00:00:00")
    sinks.append_results(results, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_vector_table(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "v")).create()
    rows = spark.createDataFrame([("a", [1.0, 0.0], "t", {"c": "x"}, "s", 0), ("b", [0.0, 1.0], "u", None, "s", 1)], schemas.VECTOR_RECORD)
    table.insert(rows)
    table.insert(rows)
    assert table.count() == 4
    assert table.create().count() == 4
    same = ("c", [1.0, 1.0], "w", None, "s", 2)
    more = spark.createDataFrame([("b", [0.0, 1.0], "u", None, "s", 1), same, same, ("c", [1.0, 1.0], "w", None, "other", 2),
                                  ("c", [1.0, 1.0], "another text of the same id", None, "s", 2)], schemas.VECTOR_RECORD)
    table.insert(more, unique=True)
    table.insert(more, unique=True)
    assert sorted(r["id"] for r in table.read().collect()) == ["a", "a", "b", "b", "c", "c", "c"]
    assert table.delete(spark.createDataFrame([("a",), ("zz",)], "id string")) == 2
    assert sorted(r["id"] for r in table.read().collect()) == ["b", "b", "c", "c", "c"]
    table.compact(1)
    assert table.count() == 5
    assert table.read().filter(F.col("metadata").isNotNull()).isEmpty()


def test_embeddings_sink(spark, tmp_path):
    from lodestrata.operators.embedding import embed_chunks

    chunks = spark.createDataFrame([("a b", 0, 0, 3, {"s": "x"})], schemas.CHUNK)
    sinks.write_embeddings(embed_chunks(chunks), str(tmp_path / "e"))
    row = spark.read.schema(schemas.EMBEDDED_CHUNK).parquet(str(tmp_path / "e")).first()
    assert row["dimension"] == 384 and len(row["embedding"]) == 384
