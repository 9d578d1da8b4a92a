"""Chunk columns against brute force written for single strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import chunking


def brute_fixed(text, size, overlap):
    words = text.split(" ")
    pos = [0]
    for w in words:
        pos.append(pos[-1] + len(w) + 1)
    spans, a = [], 0
    for j in range(len(words)):
        if pos[j + 1] - pos[a] > size and j > a:
            spans.append((a, j))
            a = next(b for b in range(a, j + 1) if pos[j] - pos[b] <= overlap)
    spans.append((a, len(words)))
    out = []
    for i, (x, y) in enumerate(spans):
        cut = text[pos[x]:pos[y] - 1]
        out.append((cut, pos[x] - i, pos[x] - i + len(cut), pos[x]))
    return out


def brute_semantic(text, size, minimum, sentences=True):
    out, start, cur = [], 0, ""

    def flush(gap, least):
        nonlocal start
        if len(cur) >= least:
            out.append((cur, start, start + len(cur)))
            start += len(cur) + gap

    for para in filter(None, (p.strip() for p in re.split("\n\n+", text))):
        if len(cur) + 2 + len(para) <= size:
            cur = f"{cur}\n\n{para}" if cur else para
            continue
        flush(2, minimum)
        first, *rest = re.split(r"(?<=[.!?])\s+", para) if sentences and len(para) > size else [para]
        cur = first
        for s in rest:
            if len(cur) + 1 + len(s) > size:
                flush(1, 1)
                cur = s
            else:
                cur += " " + s
    flush(0, minimum)
    return out


def brute_window(text, size, overlap):
    return [(w, i, i + len(w)) for i in range(0, len(text), size - overlap) if (w := text[i:i + size]).strip()]


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(5)
    units = ["a", "bb. ", "Cc! ", " ", "  ", "\n\n", "\n", "word? ", "é😀 ", " "]
    made = ["", " ", "one", "x" * 300, "a " * 200]
    for _ in range(800):
        made.append("".join(
            draw.choice([*units, "x" * draw.randint(1, 60), "y" * draw.randint(1, 9) + " "]) for _ in range(draw.randint(0, 30))))
    return spark.createDataFrame(list(enumerate(made)), "i int, text string").repartition(4).cache()


def same(df, expr, brute):
    for text, got in df.select("text", expr).collect():
        assert [tuple(c) for c in got] == brute(text), repr(text)


@pytest.mark.parametrize("size,overlap", [(40, 10), (25, 0), (60, 59), (512, 50)])
def test_against_brute_force(texts, size, overlap):
    same(texts, chunking.fixed_chunks(F.col("text"), size, overlap), lambda t: brute_fixed(t, size, overlap))
    same(texts, chunking.window_chunks(F.col("text"), size, overlap), lambda t: brute_window(t, size, overlap))
    same(texts, chunking.fixed_chunks_native(F.col("text"), size, overlap), lambda t: brute_fixed(t, size, overlap))
    least = max(overlap, 1)
    for form in (chunking.semantic_chunks, chunking.semantic_chunks_native):
        same(texts, form(F.col("text"), size, least), lambda t: brute_semantic(t, size, least))
        same(texts, form(F.col("text"), size, least, False), lambda t: brute_semantic(t, size, least, False))


def test_fixed_chunks_are_substrings_and_empty_text_gives_one(spark, texts):
    rows = chunking.explode_chunks(texts, chunking.fixed_chunks(F.col("text"), 40, 10), "i")
    joined = rows.withColumnRenamed("text", "chunk").join(texts, "i")
    assert joined.filter(F.expr("substring(text, true_start + 1, length(chunk)) <> chunk")).isEmpty()
    assert rows.filter("i = 0").count() == 1


def test_short_text_gives_no_semantic_chunk(spark):
    df = spark.createDataFrame([("too short",)], "text string")
    assert df.select(F.size(chunking.semantic_chunks(F.col("text"), 512, 100))).first()[0] == 0


def test_dispatch(spark):
    df = spark.createDataFrame([("aa bb cc. " * 20,)], "text string")
    semantic = df.select(chunking.chunker("semantic", 50, 10)(F.col("text"))).first()[0]
    assert [tuple(c) for c in semantic] == brute_semantic("aa bb cc. " * 20, 50, 10)
    with pytest.raises(ValueError):
        chunking.chunker("other")
    with pytest.raises(ValueError):
        chunking.fixed_chunks(F.col("text"), 10, 10)
