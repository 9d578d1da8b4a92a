"""Chunkers as Column expressions: STRING -> ARRAY<STRUCT<text, start_char, end_char, ...>>.

The two greedy chunkers come in two forms with equal results. ``fixed_chunks`` and
``semantic_chunks`` walk each document inside an Arrow batch: measured five to six times
faster than the fold below, since they step from chunk to chunk and not from word to word.
``fixed_chunks_native`` and ``semantic_chunks_native`` are folds inside the JVM for jobs
that want no Python workers; they carry numbers only and cut the text of a chunk from the
bound word list. All forms are linear in the length of a document.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import SPACE, bind, strip


def _grow(spans: Column, span: Column, when: Column) -> Column:
    return F.when(when, F.concat(spans, F.array(span))).otherwise(spans)


def _fixed_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each chunk; ``starts`` holds every word start and one past the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = [0, *(np.flatnonzero(points == 32) + 1).tolist(), len(points) + 1]
    spans, first, fresh, words = [], 0, 0, len(starts) - 1
    while fresh + 1 < words:
        # the first word behind the fresh one that no longer fits
        stop = bisect_right(starts, starts[first] + size, fresh + 2) - 1
        if stop >= words:
            break
        spans.append((starts[first], starts[stop] - 1))
        first, fresh = max(first, bisect_left(starts, starts[stop] - overlap)), stop
    spans.append((starts[first], starts[words] - 1))
    return spans


def _semantic_spans(text: str, size: int, least: int, respect: bool) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    length = start = 0

    def flush(gap: int, minimum: int) -> None:
        nonlocal start
        if length >= minimum:
            out.append(("".join(held), start, start + length))
            start += length + gap

    for block in re.split("\n\n+", text):
        block = block.strip()
        if not block:
            continue
        cut = respect and len(block) > size
        for i, piece in enumerate(re.split(r"(?<=[.!?])\s+", block) if cut else [block]):
            inner = i > 0
            gap = " " if inner else "\n\n"
            if (cut and not inner) or length + len(piece) + len(gap) > size:
                flush(len(gap), 1 if inner else least)
                held, length = [piece], len(piece)
            elif length:
                held += [gap, piece]
                length += len(gap) + len(piece)
            else:
                held, length = [piece], len(piece)
    flush(0, least)
    return out


def _per_document(chunk, kind: str):
    """An Arrow UDF that applies ``chunk`` to each text of a batch; null gives null."""
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else chunk(t) for t in batch], index=batch.index, dtype=object)

    # a chunker in a pushed-down filter must not run twice
    return run.asNondeterministic()


def fixed_chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Greedy word chunks with whole-word overlap.

    ``start_char`` counts one character less per earlier chunk (the running offset skips
    the blank between chunks); ``true_start`` is the real offset.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need 0 <= overlap < size")

    def chunk(t: str) -> list[tuple[str, int, int, int]]:
        return [(t[a:b], a - i, b - i, a) for i, (a, b) in enumerate(_fixed_spans(t, size, overlap))]

    return _per_document(chunk, "array<struct<text:string,start_char:int,end_char:int,true_start:int>>")(text)


def semantic_chunks(
    text: Column, max_size: int = 512, min_size: int = 100, respect_sentences: bool = True
) -> Column:
    """Paragraph chunks; a paragraph above ``max_size`` is cut at sentence ends.

    A pending chunk below ``min_size`` is dropped when a paragraph does not fit behind it
    and at the end of the text; flushes between sentences ignore ``min_size``.
    """
    if min_size < 1:
        raise ValueError("min_size must be at least 1")
    return _per_document(
        lambda t: _semantic_spans(t, max_size, min_size, respect_sentences),
        "array<struct<text:string,start_char:int,end_char:int>>")(text)


def fixed_chunks_native(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """``fixed_chunks`` as one fold over the word lengths."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need 0 <= overlap < size")

    empty = F.array().cast("array<struct<first:int,words:int,start:int,len:int>>")

    def suffix(costs: Column, i: Column) -> Column:
        # (words, characters) of the longest run of whole words before i that fits the overlap
        window = F.reverse(F.slice(costs, F.greatest(i - overlap, F.lit(0)) + 1, F.least(i, F.lit(overlap))))
        return F.aggregate(
            window,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(True).alias("open")),
            lambda a, c: F.when(
                a["open"] & (a["chars"] + c <= overlap),
                F.struct((a["n"] + 1).alias("n"), (a["chars"] + c).alias("chars"), F.lit(True).alias("open")),
            ).otherwise(F.struct(a["n"].alias("n"), a["chars"].alias("chars"), F.lit(False).alias("open"))),
        )

    def step(costs: Column):
        def advance(s: Column, c: Column) -> Column:
            full = (s["pos"] - s["start"] + c > size) & (s["i"] > s["first"])
            keep = F.struct(
                (s["i"] + 1).alias("i"), (s["pos"] + c).alias("pos"),
                s["first"].alias("first"), s["start"].alias("start"), s["out"].alias("out"),
            )
            span = F.struct(
                s["first"].alias("first"), (s["i"] - s["first"]).alias("words"),
                s["start"].alias("start"), (s["pos"] - s["start"] - 1).alias("len"),
            )

            def flush(back: Column) -> Column:
                return F.struct(
                    (s["i"] + 1).alias("i"), (s["pos"] + c).alias("pos"),
                    # the overlap cannot reach behind the chunk it is taken from
                    F.greatest(s["i"] - back["n"], s["first"]).alias("first"),
                    F.greatest(s["pos"] - back["chars"], s["start"]).alias("start"),
                    F.concat(s["out"], F.array(span)).alias("out"),
                )

            return F.when(full, bind(suffix(costs, s["i"]), flush)).otherwise(keep)

        return advance

    def close(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.struct(
            s["first"].alias("first"), (s["i"] - s["first"]).alias("words"),
            s["start"].alias("start"), (s["pos"] - s["start"] - 1).alias("len"),
        )))

    def spans(costs: Column) -> Column:
        zero = F.struct(
            F.lit(0).alias("i"), F.lit(0).alias("pos"), F.lit(0).alias("first"),
            F.lit(0).alias("start"), empty.alias("out"),
        )
        return F.aggregate(costs, zero, step(costs), close)

    def cut(words: Column) -> Column:
        found = bind(F.transform(words, lambda w: F.length(w) + 1), spans)
        return F.transform(found, lambda c, i: F.struct(
            F.array_join(F.slice(words, c["first"] + 1, c["words"]), " ").alias("text"),
            (c["start"] - i).alias("start_char"),
            (c["start"] - i + c["len"]).alias("end_char"),
            c["start"].alias("true_start"),
        ))

    return bind(F.split(text, " ", -1), cut)


def semantic_chunks_native(
    text: Column, max_size: int = 512, min_size: int = 100, respect_sentences: bool = True
) -> Column:
    """``semantic_chunks`` as one fold over the lengths of paragraphs and sentences."""
    if min_size < 1:
        raise ValueError("min_size must be at least 1")

    def piece(value: Column, kind: str | Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), value.alias("text"))

    def pieces_of(para: Column) -> Column:
        whole = F.array(piece(para, "P"))
        if not respect_sentences:
            return whole
        parts = F.transform(
            F.split(para, rf"(?<=[.!?]){SPACE}+", -1),
            lambda s, i: piece(s, F.when(i == 0, "S0").otherwise("S")),
        )
        return F.when(F.length(para) > max_size, parts).otherwise(whole)

    paragraphs = F.filter(F.transform(F.split(text, "\n\n+", -1), strip), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, pieces_of))
    empty = F.array().cast("array<struct<first:int,pieces:int,start:int,len:int>>")

    def state(i, first, cur, start, out) -> Column:
        return F.struct(i.alias("i"), first.alias("first"), cur.alias("cur"), start.alias("start"), out.alias("out"))

    def pending(s: Column) -> Column:
        return F.struct(
            s["first"].alias("first"), (s["i"] - s["first"]).alias("pieces"),
            s["start"].alias("start"), s["cur"].alias("len"),
        )

    def advance(s: Column, p: Column) -> Column:
        inner = p["kind"] == "S"
        gap = F.when(inner, 1).otherwise(2)
        over = (p["kind"] == "S0") | (s["cur"] + p["len"] + gap > max_size)
        emit = over & F.when(inner, s["cur"] > 0).otherwise(s["cur"] >= min_size)
        return state(
            s["i"] + 1,
            F.when(over, s["i"]).otherwise(s["first"]),
            F.when(over | (s["cur"] == 0), p["len"]).otherwise(s["cur"] + gap + p["len"]),
            F.when(emit, s["start"] + s["cur"] + gap).otherwise(s["start"]),
            _grow(s["out"], pending(s), emit),
        )

    def spans(found: Column) -> Column:
        sizes = F.transform(found, lambda p: F.struct(p["kind"].alias("kind"), F.length(p["text"]).alias("len")))
        return F.aggregate(
            sizes,
            state(F.lit(0), F.lit(0), F.lit(0), F.lit(0), empty),
            advance,
            lambda s: _grow(s["out"], pending(s), s["cur"] >= min_size),
        )

    def cut(found: Column) -> Column:
        return F.transform(spans(found), lambda c: F.struct(
            F.array_join(F.transform(
                F.slice(found, c["first"] + 1, c["pieces"]),
                lambda p, j: F.when(j == 0, p["text"])
                .when(p["kind"] == "S", F.concat(F.lit(" "), p["text"]))
                .otherwise(F.concat(F.lit("\n\n"), p["text"])),
            ), "").alias("text"),
            c["start"].alias("start_char"),
            (c["start"] + c["len"]).alias("end_char"),
        ))

    return bind(pieces, cut)


def window_chunks(text: Column, size: int = 100, overlap: int = 20) -> Column:
    """Character windows of ``size`` every ``size - overlap`` characters; blank ones skipped."""
    step = size - overlap
    if size <= 0 or overlap < 0 or step <= 0:
        raise ValueError("need 0 <= overlap < size")
    per_window = -(-size // step)

    def windows(strips: Column) -> Column:
        return F.transform(strips, lambda _, i: F.struct(
            F.substring(F.array_join(F.slice(strips, i + 1, per_window), ""), 1, size).alias("text"),
            (i * step).alias("start_char"),
        ))

    # one pass cuts the text into strips of `step` characters; a window is a few of them
    strips = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    made = F.transform(bind(strips, windows), lambda w: F.struct(
        w["text"].alias("text"),
        w["start_char"].alias("start_char"),
        (w["start_char"] + F.length(w["text"])).alias("end_char"),
    ))
    return F.filter(made, lambda w: strip(w["text"]) != "")


def chunker(strategy: str = "semantic", size: int = 512, overlap: int = 50, **options):
    """The chunker for a strategy name, as a function of a text Column.

    Jobs give one size and one overlap; for the semantic chunker the overlap serves as the
    minimum size.
    """
    if strategy == "fixed":
        return lambda text: fixed_chunks(text, size, overlap)
    if strategy == "semantic":
        minimum = options.get("min_size", overlap)
        respect = options.get("respect_sentences", True)
        return lambda text: semantic_chunks(text, size, minimum, respect)
    if strategy == "window":
        return lambda text: window_chunks(text, size, overlap)
    raise ValueError(f"unknown chunking strategy: {strategy}")


def explode_chunks(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row per chunk with its index, beside the kept columns."""
    return (
        df.select(*keep, F.posexplode(chunks).alias("chunk_index", "chunk"))
        .select(*keep, "chunk_index", "chunk.*")
    )
