"""SimHash near-duplicates: fingerprints, a grid join on segment bit counts, components.

A fingerprint is cut in two halves of sixteen 2-bit segments. The bit counts of its segments
are a point on a grid, and the Manhattan distance of two points is never more than the Hamming
distance of the fingerprints. Fingerprints that differ in at most three bits have a half whose
points are equal or one step apart, so an equi-join on (half, point) meets every such pair: a
point of even parity also visits its neighbours, one of odd parity stays. Candidates are then
verified on the fingerprints inside the join condition.

Defined results: a null text counts as empty; texts without words share fingerprint zero and
link like any others; repeated rows give repeated rows of one class; a class is named by its
smallest doc_id, nulls aside; extra columns are ignored by ``near_duplicates`` and kept by
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import columns, empty_as, let, words
from lodestrata.llm.components import components, reliable

SHINGLE = 3
MAX_BITS = 3
HOT_SHARE = 1000
_CHUNK = 1 << 16
_ODD_BITS = 0x55555555


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is.

    ``lower`` does it where no other character has a lower case; such texts take ``translate``.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(r"[[^\x00-\x7F]&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def shingle_hashes(text: Column) -> Column:
    """XXH64 (seed 42) of each shingle, repeats included; one of the whole text if it is shorter."""
    def of(w: Column) -> Column:
        n = F.size(w)
        full = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(
            F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE)])))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(
            n < SHINGLE, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(full)
    return let(words(ascii_lower(empty_as(text))), of)


def _majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in over half of the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at:at + _CHUNK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("hashes")
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        made = [_majority(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(made, pa.int64())], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, fp)`` per row; text_key is a 64-bit hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = columns(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("text_key"), shingle_hashes(F.col("text")).alias("hashes"))
    return hashed.mapInArrow(_fingerprint_batches, f"doc_id {kind}, text_key bigint, fp bigint")


def _halves(fp: Column) -> Column:
    """The two 32-bit halves, each with its number and the point of its segment bit counts."""
    def half(number: int) -> Column:
        bits = F.shiftrightunsigned(fp, 32 * number).bitwiseAND(F.lit(0xFFFFFFFF))
        point = bits.bitwiseAND(F.lit(_ODD_BITS)) + F.shiftright(bits, 1).bitwiseAND(F.lit(_ODD_BITS))
        return F.struct(F.lit(number).cast("long").alias("number"), point.alias("point"), (F.bit_count(bits) % 2).alias("parity"))
    return F.array(half(0), half(1))


def _neighbours(point: Column) -> Column:
    """All points one step away: a segment count between 0 and 2 goes up or down by one."""
    steps = []
    for s in range(16):
        count = F.shiftright(point, 2 * s).bitwiseAND(F.lit(3))
        steps += [F.when(count < 2, point + F.lit(1 << 2 * s)), F.when(count > 0, point - F.lit(1 << 2 * s))]
    return F.array_compact(F.array(*steps))


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct fingerprints ``fp`` that differ in 1 to max_bits bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves one step apart find up to three differing bits")
    cells = nodes.select("fp", F.explode(_halves(F.col("fp"))).alias("h")).select(
        "fp", (F.col("h.number") * (1 << 32)).alias("base"), F.col("h.point").alias("point"), F.col("h.parity").alias("parity"))
    own = cells.select((F.col("base") + F.col("point")).alias("cell"), F.col("fp").alias("b"))
    visits = cells.select("fp", "base", F.explode(F.when(
        F.col("parity") == 0, F.concat(F.array("point"), _neighbours(F.col("point")))).otherwise(F.array("point"))).alias("to"), "point")
    visits = visits.select((F.col("base") + F.col("to")).alias("cell"), F.col("fp").alias("a"), (F.col("to") != F.col("point")).alias("away"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, max_bits) & (F.col("away") | (F.col("a") < F.col("b")))
    met = visits.alias("v").join(own.alias("o"), (F.col("v.cell") == F.col("o.cell")) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes(docs: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints per row; per distinct fingerprint its class root, its rows and its first row by (doc_id, text hash).

    Rows meet their fingerprint in this aggregate only, which merges map-side; all else is done on distinct fingerprints.
    """
    fps = reliable(fingerprints(docs))
    nodes = reliable(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_key")).alias("best")))
    joined = components(links(nodes.select("fp"), max_bits))
    roots = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "n", "first", "best", F.coalesce("root", "fp").alias("root"))
    return fps, roots


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: doc_id, fingerprint in hex and component_id, the smallest doc_id of its class.

    Fingerprints with at least one in HOT_SHARE of all rows number HOT_SHARE at most; their rows
    take the class from a table in every task, so that no key gathers its rows in one task.
    """
    fps, roots = _classes(docs, max_bits)
    named = reliable(roots.join(roots.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "n", "component_id"))
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first().total
    hot = F.col("n") * HOT_SHARE >= F.lit(max(total, 2 * HOT_SHARE))
    often = F.broadcast(named.filter(hot).select("fp", "component_id"))
    rare = named.filter(~hot).select("fp", "component_id")
    rows = fps.join(often, "fp").unionByName(fps.join(often.select("fp"), "fp", "left_anti").join(rare, "fp"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each class, that of the smallest doc_id (then text hash), with all its columns."""
    _, roots = _classes(docs, max_bits)
    best = roots.groupBy("root").agg(F.min("best").alias("best"))
    chosen = best.select(F.col("best.doc_id").alias("k1"), F.col("best.text_key").alias("k2")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("`doc_id`").alias("k1"), F.xxhash64("`text`").alias("k2"))
    kept = packed.alias("d").join(chosen.alias("c"), F.col("d.k1").eqNullSafe(F.col("c.k1")) & (F.col("d.k2") == F.col("c.k2")), "left_semi")
    # Repeated rows of one key differ in other columns at most; the first by those stays.
    others = [F.col(f"row.`{f.name}`") for f in docs.schema if f.name != "text" and not _nested(f)]
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*others))
    return kept.withColumn("n", first).filter("n = 1").select("row.*")


def _nested(field) -> bool:
    return field.dataType.typeName() in ("array", "map", "struct", "variant")
