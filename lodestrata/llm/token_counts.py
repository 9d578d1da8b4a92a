"""Token counts: the pieces of each distinct pre-token are counted once and joined back.

First pass: pre-tokens of all texts, summed per task and then per pre-token, and the number of
pieces of each. The most frequent of them, a bounded number, go to every task as a table; the
second pass adds those up per document and sends only the others through an equi-join. Ids of
documents are never made.

Defined results: a null text counts as empty: no bytes, no tokens; a special token's string in a
text is one token, as by the library's default; repeated rows are counted one by one; rows keep
their doc_id, null included; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import pretokens
from lodestrata.llm.common import Shared, columns
from lodestrata.llm.components import reliable

# Pre-tokens whose counts every task holds, and the longest of them in bytes: at most 16 MB.
COMMON, COMMON_BYTES = 1 << 18, 64
_HELD = 200_000
_SALTS = 64


def split(text: str, path: str) -> tuple[list[str], int]:
    """Pre-tokens of any text by the library's own steps, and its number of special tokens."""
    tok = pretokens.tokenizer(path)
    parts, special = [text], 0
    for mark in (t.content for t in tok.get_added_tokens_decoder().values()):
        cut = [p.split(mark) for p in parts]
        special += sum(len(c) - 1 for c in cut)
        parts = [p for c in cut for p in c]
    return [part[a:b] for part in parts for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(part)], special


def _tallies(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def add(token: str, n: int):
            held[token] = held.get(token, 0) + n

        def flush():
            batch = pa.RecordBatch.from_pydict({"token": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            for _, texts in pretokens.slices(batch.column("text")):
                cut = pretokens.cut_bytes(texts)
                for piece, n in zip(cut.pieces, np.bincount(cut.numbers, minlength=len(cut.pieces)).tolist()):
                    for token in pretokens.byte_tokens(piece):
                        add(token, n)
                for k in np.flatnonzero(~cut.plain):
                    for token in split(texts[k].as_py(), path)[0]:
                        add(token, 1)
                if len(held) > _HELD:
                    yield flush()
        yield flush()
    return count


def _pieces(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pretokens.tokenizer(path)
        for batch in batches:
            made = tok.encode_batch_fast(batch.column("token").to_pylist(), add_special_tokens=False)
            yield batch.append_column("pieces", pa.array([len(x.ids) for x in made], pa.int64()))
    return count


def _per_text(texts: pa.Array, path: str, known: dict[str, int]):
    """Per text the sum over known pre-tokens; and (row, token, n) of the others."""
    cut = pretokens.cut_bytes(texts)
    sums, others = np.zeros(len(cut.pieces), np.int64), {}
    for k, piece in enumerate(cut.pieces):
        for token in pretokens.byte_tokens(piece):
            pieces = known.get(token)
            if pieces is None:
                others.setdefault(k, []).append(token)
            else:
                sums[k] += pieces
    running = np.concatenate([[0], np.cumsum(sums[cut.numbers])])
    totals = running[cut.ends[1:]] - running[cut.ends[:-1]]
    found: Counter = Counter()
    if others:
        at = np.flatnonzero(np.isin(cut.numbers, np.fromiter(others, np.int64, len(others))))
        rows = np.searchsorted(cut.ends, at, "right") - 1
        for row, number in zip(rows.tolist(), cut.numbers[at].tolist()):
            for token in others[number]:
                found[row, token] += 1
    for k in np.flatnonzero(~cut.plain).tolist():
        tokens, totals[k] = split(texts[k].as_py(), path)
        for token, n in Counter(tokens).items():
            if token in known:
                totals[k] += n * known[token]
            else:
                found[k, token] += n
    return totals.tolist(), found


def _documents(path: str, common: Shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            for start, texts in pretokens.slices(batch.column("text")):
                totals, found = _per_text(texts, path, known)
                # What is already summed travels as so many one-piece marks; no pre-token looks like one.
                rows = [*range(len(totals)), *(row for row, _ in found)]
                tokens = [*(f"\x00{k % _SALTS}" for k in range(len(totals))), *(token for _, token in found)]
                at = pa.array(rows, pa.int64())
                sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()).take(at)
                keys = batch.slice(start, len(texts)).select(["doc_id", "text_key"]).take(at)
                yield pa.RecordBatch.from_arrays(
                    [*keys.columns, sizes, pa.array(tokens, pa.string()), pa.array([*totals, *found.values()], pa.int64())],
                    ["doc_id", "text_key", "n_bytes", "token", "n"])
    return count


def pretoken_pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(token, n, pieces)``: every distinct pre-token, its occurrences and its number of pieces."""
    seen = columns(docs, "text").mapInArrow(_tallies(tokenizer_path), "token string, n bigint")
    return seen.groupBy("token").agg(F.sum("n").alias("n")).mapInArrow(_pieces(tokenizer_path), "token string, n bigint, pieces bigint")


def common_pieces(table: DataFrame) -> dict[str, int]:
    """The most frequent pre-tokens and their pieces, COMMON at most.

    The lowest frequency that still fits is read off a histogram, so that no task sends more
    than it has of them.
    """
    short = table.filter(F.octet_length("token") <= COMMON_BYTES).withColumn("level", F.floor(F.log2("n") * 16).cast("int"))
    sizes = sorted(((r.level, r.c) for r in short.groupBy("level").agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, None
    for level, count in sizes:
        total += count
        if total > COMMON:
            break
        least = level
    if least is None:
        return {}
    found = short.filter(F.col("level") >= least).select("token", "pieces").toArrow()
    return dict(zip(found.column("token").to_pylist(), found.column("pieces").to_pylist()))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens and whether they are over the limit."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    table = reliable(pretoken_pieces(docs, tokenizer_path))
    common = common_pieces(table)
    marks = spark.range(_SALTS).select(F.concat(F.lit("\x00"), F.col("id").cast("string")).alias("token"), F.lit(1).cast("long").alias("pieces"))
    keyed = columns(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    parts = keyed.mapInArrow(_documents(tokenizer_path, Shared(spark, common)),
                             f"doc_id {kind}, text_key bigint, n_bytes bigint, token string, n bigint")
    counted = parts.join(table.select("token", "pieces").unionAll(marks), "token")
    summed = counted.groupBy("doc_id", "text_key", "n_bytes").agg(
        F.sum(F.col("n") * F.col("pieces")).alias("total"), F.count_if(F.col("token").rlike("^\\x00[0-9]+$")).alias("copies"))
    each = summed.select("doc_id", "n_bytes", F.expr("total div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
