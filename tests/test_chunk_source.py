"""The chunk-file source: equal rows in batch and stream, conditions pushed down, new files once."""

import json

import pytest

from lodestrata.sources import chunk_source
from lodestrata.sources.artifacts import read_chunks_json
from lodestrata.streaming.run import run_available


@pytest.fixture
def folder(tmp_path):
    for k in range(5):
        chunks = [{"text": f"t{k} {i}", "chunk_index": i, "start_char": i * 5, "end_char": i * 5 + 4, "metadata": {"source": f"s{k}"} if i else None} for i in range(k)]
        (tmp_path / f"d{k}_chunks.json").write_text(json.dumps(chunks))
    (tmp_path / "other.json").write_text("[]")
    return tmp_path


def shown(df):
    return sorted(map(str, df.select("text", "chunk_index", "start_char", "end_char", "metadata").collect()))


def test_batch_and_stream_give_the_rows_of_the_reader(spark, folder, tmp_path_factory, monkeypatch):
    chunk_source.register(spark)
    want = shown(read_chunks_json(spark, str(folder)))
    rows = spark.read.format("chunk_files").load(str(folder))
    assert shown(rows) == want and len(want) == 10
    work = str(tmp_path_factory.mktemp("stream"))
    stream = lambda: spark.readStream.format("chunk_files").load(str(folder))
    assert shown(run_available(stream(), work)) == want
    (folder / "late_chunks.json").write_text(json.dumps([{"text": "late", "chunk_index": 0}]))
    again = run_available(stream(), work)
    assert again.count() == 11 and again.filter("text = 'late'").count() == 1


def test_conditions_reach_the_files(spark, folder):
    chunk_source.register(spark)
    (folder / "d9_chunks.json").write_text("no chunks at all")  # would fail if it were read
    rows = spark.read.format("chunk_files").load(str(folder))
    got = rows.filter("file IN ('d3_chunks.json', 'd4_chunks.json') AND chunk_index >= 1 AND text LIKE '%2'")
    assert sorted((r.file, r.text) for r in got.collect()) == [("d3_chunks.json", "t3 2"), ("d4_chunks.json", "t4 2")]
    reader = chunk_source.ChunkReader(str(folder))
    kept = list(reader.pushFilters([chunk_source.EqualTo(("file",), "d1_chunks.json"), chunk_source.GreaterThan(("chunk_index",), 0), chunk_source.EqualTo(("text",), "x")]))
    assert [f.attribute for f in kept] == [("text",)] and [p.paths for p in reader.partitions()] == [[str(folder / "d1_chunks.json")]]


def test_files_are_dealt_by_size(monkeypatch):
    monkeypatch.setattr(chunk_source, "PARTITION_BYTES", 10)
    assert [p.paths for p in chunk_source._dealt([(1, "b", 6), (2, "a", 6), (0, "c", 1), (3, "d", 50)])] == [["a", "b"], ["c", "d"]]
    assert chunk_source._dealt([]) == []
