"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Texts are cut where both vocabularies always end a token, before a space or line end that follows
a letter or sign, so a text's tokens are those of its pieces end to end. Each distinct piece of a
batch is encoded once by both libraries. Tokens and bytes of all pieces form two incidence
matrices in compressed rows, A (tokens by bytes) and B; Gustavson's row products give A times B
transposed, whose entries are the overlap links with their overlap in bytes, and the product of
the token-group incidences gives the links within a group. Groups end where tokens of both sides end.

Texts are encoded once: their totals, digests and the pairs of their links are written to the shared
folder. From that table come the links that hold each pair of ids, and in a second reading what
those counts say of each document. The most frequent pairs, a bounded number, are a table in
every task; links of all others go through an equi-join.

Defined results: a text that is null, empty or not given back byte by byte by one of the
vocabularies (such as one with U+2581) has no tokens, is all zeros with an empty digest, and its
links are not counted; special tokens' strings are plain text; repeated rows are counted one by
one; rows keep their doc_id, null included; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import pretokens
from lodestrata.llm.common import Shared, columns, per_process
from lodestrata.llm.components import reliable
from lodestrata.session import checkpoint_dir

# Pairs whose counts every task holds: at most 9 MB.
COMMON = 1 << 19
_SLICE, _HELD, _CALL = 3 << 20, 1 << 19, 8192
# White space of any kind; a cut stands before a space or line end after anything else.
_SPACES = r"\s\x0b\x1c-\x1f\x85\pZ"
_SHIFT = 20


@dataclass
class Csr:
    """A sparse matrix in compressed rows: row i has ``indices[indptr[i]:indptr[i + 1]]`` and their values."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def runs(cls, sizes: np.ndarray) -> Csr:
        """Each row a run of ones that begins where the last one ended."""
        indptr = np.concatenate([[0], np.cumsum(sizes)])
        return cls(indptr, np.arange(indptr[-1]), np.ones(indptr[-1], np.int64), int(indptr[-1]))

    @classmethod
    def one_each(cls, column: np.ndarray, width: int) -> Csr:
        """One entry in each row."""
        return cls(np.arange(len(column) + 1), column, np.ones(len(column), np.int64), width)

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.width)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), self.rows[order], self.values[order], len(self.indptr) - 1)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: row i gathers the rows of ``other`` at its entries and adds up equal columns."""
        sizes = np.diff(other.indptr)[self.indices]
        at = spread(other.indptr[self.indices], sizes)
        keys = np.repeat(self.rows, sizes) * other.width + other.indices[at]
        values = np.repeat(self.values, sizes) * other.values[at]
        if np.any(np.diff(keys) < 0):
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        values = np.add.reduceat(values, first) if len(first) else values
        counts = np.bincount(keys[first] // max(other.width, 1), minlength=len(self.indptr) - 1)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), keys[first] % max(other.width, 1), values, other.width)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for each start, as many as its size."""
    after = np.cumsum(sizes)
    return np.repeat(starts - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)


class Vocabularies:
    """Both tokenizers with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        # Tasks are the unit of parallel work; threads of the library's own only take turns on their cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        size = self.a.get_vocab_size()
        # A special token's entry is no byte-level string; it is never made from a text.
        self.a_bytes = [bytes(letters.get(c, 63) for c in self.a.id_to_token(k) or "") for k in range(size)]
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(k)[3:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()
            for k in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (pa.array(list(map(str, range(len(x)))), pa.string()) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        # Pieces may be encoded apart if no entry goes over a cut, and a space alone is an entry.
        over = re.compile(r"[^\s▁][\n▁]|▁\n")
        plain = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size()) if not self.b.is_byte(k)]
        self.cuts = not any(map(over.search, plain)) and self.b_bytes[self.space] == b" " and _splits_like_bytes(a_path)

    def encode_a(self, pieces: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode_b(self, pieces: list[str]) -> list[list[int]]:
        """Tokens of each piece as it stands within a text that begins with a space."""
        made = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        return [ids if p[0] == " " and len(p) > 1 else [self.space] if p == " " else ids[1:] for p, ids in zip(pieces, made)]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + k): b for k, b in enumerate(others)}}


def _splits_like_bytes(path: str) -> bool:
    """Whether the file splits texts by the byte-level pattern and nothing else, which ends every word before a space."""
    with open(path, encoding="utf-8") as source:
        made = json.load(source)
    return made.get("normalizer") is None and (made.get("pre_tokenizer") or {}).get("type") == "ByteLevel"


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return per_process(("vocabularies", a_path, b_path), lambda: Vocabularies(a_path, b_path))


@dataclass
class Aligned:
    """The distinct pieces of some texts, aligned; the pieces of text k are ``numbers[ends[k]:ends[k + 1]]``."""

    numbers: np.ndarray
    ends: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    n_shared: np.ndarray
    pairs: np.ndarray  # of the links of all pieces, in order: a << _SHIFT | b
    groups: pa.Array  # of each piece, written out

    def total(self, per_piece: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(per_piece[self.numbers])])
        return running[self.ends[1:]] - running[self.ends[:-1]]


def _pieces(texts: pa.Array, cuts: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers and ends per text, and the distinct pieces; null and empty texts have none."""
    texts = pc.fill_null(texts, "")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    mark = next(m for m in map(chr, range(0xE000, 0xF8FF)) if not pc.any(pc.match_substring(texts, m)).as_py())
    marked = pc.replace_substring_regex(texts, rf"([^{_SPACES}])([ \n])", rf"\1{mark}\2") if cuts else texts
    lists = pc.split_pattern(marked, mark)
    coded = lists.flatten().dictionary_encode()
    ends = lists.offsets.to_numpy().astype(np.int64)
    return coded.indices.to_numpy(), ends - ends[0], coded.dictionary


def _encoded(pieces: list[str], encode) -> tuple[list[int], np.ndarray]:
    """All ids end to end and the number of each piece; some pieces a call, as the libraries' results are large."""
    ids, sizes = [], []
    for k in range(0, len(pieces), _CALL):
        made = encode(pieces[k:k + _CALL])
        sizes += map(len, made)
        ids += chain.from_iterable(made)
    return ids, np.array(sizes, np.int64)


def _sum_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    running, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(sizes)
    return running[ends] - running[ends - sizes]


def _joined(items: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, items), by)


def align(texts: pa.Array, voc: Vocabularies) -> Aligned:
    """Align all texts of an array."""
    numbers, ends, names = _pieces(texts, voc.cuts)
    known = names.to_pylist()
    filled = [p or " " for p in known]
    a_list, a_count = _encoded(filled, voc.encode_a)
    b_list, b_count = _encoded(filled, voc.encode_b)
    a_ids, b_ids = np.array(a_list, np.int64), np.array(b_list, np.int64)
    size = pc.binary_length(pa.array(filled, pa.string())).to_numpy().astype(np.int64)
    a_size, b_size = voc.a_sizes[a_ids], voc.b_sizes[b_ids]
    whole = "".join(filled).encode()
    good = (_sum_by(a_size, a_count) == size) & (_sum_by(b_size, b_count) == size)
    if not good.all() or b"".join(map(voc.a_bytes.__getitem__, a_list)) != whole or b"".join(map(voc.b_bytes.__getitem__, b_list)) != whole:
        good &= _given_back(filled, a_ids, a_count, voc.a_bytes) & _given_back(filled, b_ids, b_count, voc.b_bytes)
        keep_a, keep_b = np.repeat(good, a_count), np.repeat(good, b_count)
        a_ids, a_size, b_ids, b_size = a_ids[keep_a], a_size[keep_a], b_ids[keep_b], b_size[keep_b]
        a_count, b_count = a_count * good, b_count * good

    a, b = Csr.runs(a_size), Csr.runs(b_size)
    links = a.times(b.transposed())
    common = np.intersect1d(a.indptr[1:], b.indptr[1:], assume_unique=True)
    group_a, group_b = (np.searchsorted(common, x.indptr[1:]) for x in (a, b))
    shared = Csr.one_each(group_a, len(common)).times(Csr.one_each(group_b, len(common)).transposed())
    in_a, in_b = (np.bincount(g, minlength=len(common)) for g in (group_a, group_b))
    written = pc.binary_join_element_wise(_joined(voc.a_names.take(pa.array(a_ids)), in_a, ","), _joined(voc.b_names.take(pa.array(b_ids)), in_b, ","), "|")
    piece_ends = np.cumsum(_sum_by(a_size, a_count))
    in_piece = np.diff(np.searchsorted(common, piece_ends, "right"), prepend=0)

    # Texts with a piece that is not given back have no pieces at all.
    per_text = np.diff(ends)
    bad = np.concatenate([[0], np.cumsum(~good[numbers])])
    whole_text = bad[ends[1:]] == bad[ends[:-1]]
    whole_text &= ~((per_text == 1) & (np.array([p == "" for p in known])[numbers[np.minimum(ends[:-1], max(len(numbers) - 1, 0))]] if len(numbers) else False))
    numbers = numbers[np.repeat(whole_text, per_text)]
    return Aligned(numbers, np.concatenate([[0], np.cumsum(per_text * whole_text)]), a_count, b_count, in_piece,
                   _sum_by(np.diff(links.indptr), a_count), _sum_by(np.diff(shared.indptr), a_count),
                   (a_ids[links.rows] << _SHIFT) | b_ids[links.indices], _joined(written, in_piece, ";"))


def _given_back(pieces: list[str], ids: np.ndarray, counts: np.ndarray, table: list[bytes]) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.array([b"".join(map(table.__getitem__, ids[e - n:e])) == p.encode() for p, e, n in zip(pieces, ends, counts)], bool)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


_TOTALS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def _documents(a_path: str, b_path: str):
    """Per text its totals, its digest, and the pairs of its links in order with how many links hold each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabularies(a_path, b_path)
        for batch in batches:
            for start, texts in pretokens.slices(batch.column("text"), _SLICE):
                made = align(texts, voc)
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in _joined(
                    made.groups.take(pa.array(made.numbers)), np.diff(made.ends), ";").cast(pa.binary()).to_pylist()]
                pairs, links = _pairs_of(made)
                numbers = [pa.array(made.total(getattr(made, c)), pa.int64()) for c in _TOTALS]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(texts)), *numbers, pa.array(digests, pa.string()), pairs, links],
                    ["doc_id", *_TOTALS, "groups_sha256", "pairs", "links"])
    return run


def _pairs_of(made: Aligned) -> tuple[pa.Array, pa.Array]:
    each = made.n_links[made.numbers]
    rows = np.repeat(np.repeat(np.arange(len(made.ends) - 1), np.diff(made.ends)), each)
    starts = np.cumsum(made.n_links) - made.n_links
    keys = np.sort((rows << 2 * _SHIFT) | made.pairs[spread(starts[made.numbers], each)])
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(keys[first] >> 2 * _SHIFT, minlength=len(made.ends) - 1))])
    lists = [pa.array(keys[first] & ((1 << 2 * _SHIFT) - 1), pa.int64()), pa.array(np.diff(first, append=len(keys)), pa.int32())]
    return tuple(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in lists)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().astype(np.int64)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task, sent on whenever they are many."""
    held, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        held.append(_flat(batch, "pairs"))
        n.append(_flat(batch, "links"))
        if sum(map(len, held)) > _HELD:
            pairs, counts = _summed(np.concatenate(held), np.concatenate(n))
            held, n = [pairs], [counts]
            if len(pairs) > _HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                held, n = [pairs[:0]], [counts[:0]]
    pairs, counts = _summed(np.concatenate(held), np.concatenate(n))
    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)``: for each pair of ids the links that hold it, and whether no other pair of its B id has more."""
    seen = aligned.select("pairs", "links").mapInArrow(_pair_counts, "pair bigint, n bigint")
    pairs = reliable(seen.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def common_pairs(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs in order, COMMON at most, with their counts and whether they are best.

    The lowest count that still fits is read off a histogram, so no task sends more than it has of them.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r.level, r.c) for r in pairs.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, None
    for at, count in sizes:
        total += count
        if total > COMMON:
            break
        least = at
    found = (pairs.filter(level >= least) if least is not None else pairs.limit(0)).toArrow().sort_by("pair")
    return tuple(found.column(c).to_numpy() for c in ("pair", "n", "best"))


def _counted(common: Shared):
    """What the common pairs say of each text's links, and its other pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = common.value
        for batch in batches:
            pairs, links = _flat(batch, "pairs"), _flat(batch, "links")
            offsets = batch.column("pairs").offsets.to_numpy().astype(np.int64)
            sizes = np.diff(offsets)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                hit = keys[at] == pairs
                sums = [_sum_by(np.where(hit, links * best[at], 0), sizes), _sum_by(np.where(hit, links * counts[at], 0), sizes)]
            else:
                hit, sums = np.zeros(len(pairs), bool), [np.zeros(len(sizes), np.int64)] * 2
            lost = np.concatenate([[0], np.cumsum(_sum_by(~hit, sizes))])
            items = pa.StructArray.from_arrays([pa.array(pairs[~hit]), pa.array(links[~hit])], ["pair", "links"])
            others = pa.ListArray.from_arrays(pa.array(lost, pa.int32()), items)
            kept = batch.select(["doc_id", *_TOTALS, "groups_sha256"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(x, pa.int64()) for x in sums), others], [*kept.schema.names, "n_best", "count_sum", "others"])
    return run


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, tokens of both sides, groups, links, links within groups, links whose pair is its B id's
    most frequent one, the sum of the links' counts and the digest of the groups."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    totals = ", ".join([f"doc_id {kind}", *(f"{c} bigint" for c in _TOTALS), "groups_sha256 string"])
    folder = f"{checkpoint_dir(spark).rstrip('/')}/aligned-{uuid.uuid4().hex}"
    schema = f"{totals}, pairs array<bigint>, links array<int>"
    columns(docs, "doc_id", "text").mapInArrow(_documents(a_path, b_path), schema).write.option("compression", "zstd").parquet(folder)
    aligned = spark.read.schema(schema).parquet(folder)
    pairs = reliable(pair_counts(aligned))
    rows = aligned.mapInArrow(_counted(Shared(spark, common_pairs(pairs))),
                              f"{totals}, n_best bigint, count_sum bigint, others array<struct<pair: bigint, links: bigint>>")
    rows = reliable(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.inline("others")).join(pairs, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    plain = rows.filter(F.size("others") == 0)
    mended = rows.filter(F.size("others") > 0).join(rare, "row").withColumns(
        {"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
    out = ["doc_id", *_TOTALS, "n_best", "count_sum", "groups_sha256"]
    return plain.select(*out).unionAll(mended.select(*out))
