"""The pipeline on odd tables: nulls, blanks, repeats, clashing columns and nothing at all."""

import random

import pytest

import corpus_pipeline

WORDS = ["the", "of", "and", "to", "in", "water", "stone", "river", "paper", "light", "house", "garden", "winter", "people", "story", "letter"]


def prose(seed, n=80):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 40)) * (draw.random() < 0.5) for _ in range(n)) + "."


@pytest.fixture
def tables(spark, tmp_path):
    def made(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, row int, p double, copies int, text_key int, kind string"
        folder = tmp_path / f"t{len(rows)}"
        spark.createDataFrame([(d, t, "en", "s", None, "x", 1, 0.5, 2, 3, "k") for d, t in rows], schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(d, 1, 0) for d in range(40)] + [(None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, prose(5, 40)), (2, None), (3, "")], "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
        return str(folder)
    return made


def test_odd_rows(spark, tables):
    whole = prose(1)
    rows = [(1, whole), (1, whole), (2, whole), (2, prose(2)), (3, None), (4, ""), (5, " \n\t "), (6, prose(5, 40) + " " + prose(6)), (None, prose(7)),
            (None, prose(8)), (7, prose(9, 20_000)), (8, "Short. Too short.")]
    folder = tables(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, folder)
        assert seen.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text) for r in seen.collect())
    # One of the copies, both texts of 2's id that differ, both rows without an id, and the long one; the leak and the blanks go.
    assert kept == sorted([(1, whole), (2, prose(2)), (0, prose(7)), (0, prose(8)), (7, prose(9, 20_000))])
    last = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id or 0) for r in last) == [0, 0, 1, 2, 7] and last[0].asDict().keys() == {"doc_id", "start", "n_tokens", "ids_crc32"}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_nothing_is_kept(spark, tables, rows):
    made = corpus_pipeline.run(spark, tables(rows))
    assert made.count() == 0 and made.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
