"""Mixing to target weights by soft membership in domains.

A classifier fitted on a bounded sample of the labelled table gives each document a posterior over
the domains ``clean``, ``low`` (poor quality) and ``toxic``. With t tokens and posterior p, a
document at rate r adds r * t * p[k] expected tokens to domain k. Rates between 0 and a maximum
are fitted by projected gradient descent on the squared misses of the domain totals, each
relative to what the domain has. In the metric weighted by tokens the step size 1 always descends,
and a document's rate is then a function of its posterior and the past misses alone: a round is
one sum over all documents, and a few numbers reach the driver.

A rate becomes a whole number of copies by a hash of the document, so that repeated runs agree.

Defined results: a null text counts as empty and has no tokens; rows are rated one by one,
repeated rows alike; labels with nulls are left out; without any usable label all documents
belong to the anchor domain; a domain without tokens has no miss; an empty table gives an empty
table; extra columns are ignored by ``rates`` and kept by ``mixed``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import pretokens, sparse_model
from lodestrata.llm.common import Shared, columns
from lodestrata.llm.components import reliable
from lodestrata.llm.samples import labelled_texts
from lodestrata.session import checkpoint_dir

DOMAINS = ("clean", "low", "toxic")
FEATURES = 1 << 16
PER_DOMAIN = 1500
ROUNDS, KEEP_EVERY = 40, 6
BEGINNING = 5
_STEPS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8])
_PART = r"([\pL\pN]+|_+|[^\pL\pN_\s\pZ]+)"
_SHARES = ("capitals", "symbols", "different", "lines")


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "clean").when(quality == 0, "low")


def _hashed(names: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, names.cast(pa.binary()).to_pylist()), np.int64, len(names)) % FEATURES


def _different(keys: np.ndarray) -> np.ndarray:
    """The keys in order, each once."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) > 0]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for each start, as many as its size."""
    after = np.cumsum(sizes)
    return np.repeat(starts - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(values)])
    return running[ends[1:]] - running[ends[:-1]]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its tokens, and the end of its features among all; the features.

    Features are hashed words and word beginnings that occur, and coarse shares of capitals,
    symbols, different words and different lines. A text is cut at white space; Arrow numbers the
    distinct pieces, and each of them is taken apart once.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded, ends = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
    numbers, ends = coded.indices.to_numpy(), ends - ends[0]
    cut = pc.split_pattern(pc.replace_substring_regex(coded.dictionary, _PART, "\\1\x00"), "\x00")
    parts, bounds = pc.utf8_trim_whitespace(cut.flatten()), cut.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(parts, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
    parts = parts.filter(pa.array(real))
    kinds = pc.utf8_lower(parts).dictionary_encode()
    kind, names = kinds.indices.to_numpy().astype(np.int64), kinds.dictionary
    long_name = pc.greater_equal(pc.utf8_length(names), BEGINNING)
    word = _hashed(names)
    beginning = np.where(long_name, _hashed(pc.binary_join_element_wise(pc.utf8_slice_codeunits(names, 0, BEGINNING), "\x00", "")), word)

    def total(values) -> np.ndarray:
        """Sums per text of a number per part."""
        return _sums(_sums(np.asarray(values, np.int64), bounds)[numbers], ends)

    length = pc.utf8_length(parts).to_numpy()
    upper = pc.utf8_is_upper(parts).to_numpy(zero_copy_only=False) & (length > 1)
    symbol = ~pc.utf8_is_alnum(pc.utf8_slice_codeunits(parts, 0, 1)).to_numpy(zero_copy_only=False)
    n = total(np.ones(len(parts)))
    each = np.diff(bounds)[numbers]
    rows = np.repeat(np.repeat(np.arange(len(texts)), np.diff(ends)), each)
    pairs = _different((rows << 32) | kind[_ranges(bounds[:-1][numbers], each)])
    at, of = pairs >> 32, pairs & 0xFFFFFFFF
    some, n1 = np.flatnonzero(n), np.maximum(n, 1)
    lines = np.ones(len(texts))
    for k in some.tolist():
        text = texts[k].as_py()
        lines[k] = len(set(text.split("\n"))) / (text.count("\n") + 1)
    shares = [total(np.where(upper, length, 0)) / np.maximum(total(length), 1), total(symbol) / n1, np.bincount(at, minlength=len(texts)) / n1, lines]
    steps = [_hashed(pa.array([f"{name}\x00{k}" for k in range(len(_STEPS) + 1)]))[np.searchsorted(_STEPS, share, "right")][some]
             for name, share in zip(_SHARES, shares)]
    keys = _different(np.concatenate([(at << 16) | word[of], (at << 16) | beginning[of], *((some << 16) | x for x in steps)]))
    tokens = _sums(pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False).astype(np.int64)[numbers], ends)
    return tokens, np.cumsum(np.bincount(keys >> 16, minlength=len(texts))), keys & 0xFFFF


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in pretokens.slices(batch.column("text")):
            _, ends, found = features(texts)
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("kind").slice(start, len(texts)), made], ["domain", "at"])


def fit_domains(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN) -> sparse_model.Model | None:
    """The domain classifier, from about ``per_domain`` labelled documents of each domain.

    Documents are counted where they are, not in the labels: earlier stages may have dropped most of a domain.
    """
    named = columns(labels, "doc_id", "quality", "toxic").select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("kind"))
    named = named.filter(F.col("kind").isNotNull() & F.col("doc_id").isNotNull()).distinct()
    present = columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_key")).join(named, "doc_id")
    sample, sizes = labelled_texts(docs, present, per_domain)
    if not sizes:
        return None
    rows = sample.mapInArrow(_feature_rows, "domain string, at array<int>").collect()
    rows = sorted((r for r in rows if r["at"]), key=lambda r: (r.domain, r["at"]))
    if not rows:
        return None
    vectors = [(np.array(r["at"]), np.ones(len(r["at"]))) for r in rows]
    return sparse_model.fit(vectors, [r.domain for r in rows], FEATURES, epochs=10, alpha=1.0, l1=3.0, l2=0.02)


def _scores(model: sparse_model.Model | None, texts: pa.Array, anchor: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and posterior over DOMAINS of each text."""
    tokens, ends, found = features(texts)
    p = np.zeros((len(texts), len(DOMAINS)))
    if model is None:
        p[:, DOMAINS.index(anchor)] = 1.0
        return tokens, p
    sums = np.zeros((len(texts), len(model.classes)))
    starts = np.concatenate([[0], ends[:-1]])
    some = np.flatnonzero(ends > starts)
    if len(some):
        sums[some] = np.add.reduceat(model.weights[found].astype(float), starts[some])
    made = sparse_model.softmax((sums + model.bias) / model.temperature)
    for k, d in enumerate(model.classes):
        p[:, DOMAINS.index(d)] = made[:, k]
    return tokens, p


def _scored(rows: DataFrame, model: Shared, anchor: str) -> DataFrame:
    """The rows with tokens (words) and the posterior ``p`` over DOMAINS of their text, a column or in the struct ``row``."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            whole = batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")
            for start, texts in pretokens.slices(whole):
                tokens, p = _scores(fitted, texts, anchor)
                ends = pa.array(np.arange(len(texts) + 1) * len(DOMAINS), pa.int32())
                made = [pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(p.ravel(), pa.float64()))]
                part = batch.slice(start, len(texts)).select(kept)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*kept, "tokens", "p"])

    kept = [n for n in rows.columns if n != "text"]
    schema = [*(rows.schema[n] for n in kept), T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]
    return rows.mapInArrow(score, T.StructType(schema))


def posteriors(docs: DataFrame, model: Shared, anchor: str) -> DataFrame:
    """Per row: doc_id, a hash of the text, tokens (words) and the posterior over DOMAINS."""
    keyed = columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return _scored(keyed, model, anchor)


def rate(p: Column, misses: list[list[float]], most: float, start: Column | None = None) -> Column:
    """The rate of a posterior after the steps against the past misses, from 1 or another start."""
    start = F.lit(min(1.0, most)) if start is None else start
    if not misses:
        return start
    past = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in misses])
    return F.aggregate(past, start, lambda r, m: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), r - sum(
        (F.get(m, F.lit(k)) * F.get(p, F.lit(k)) for k in range(1, len(DOMAINS))), F.get(m, F.lit(0)) * F.get(p, F.lit(0))))))


def fit_rates(scored: DataFrame, weights: dict[str, float], anchor: str = "clean", reach: float = 1.1, most: float = 1.0,
              rounds: int = ROUNDS) -> list[list[float]]:
    """Misses of each round, relative to what each domain has.

    Targets are ``weights`` of a total at which the anchor domain would need ``reach`` times its
    tokens; a reach over 1 holds its documents at the maximum.
    """
    def totals(rows: DataFrame, r: Column) -> list[float]:
        row = rows.agg(*[F.coalesce(F.sum(F.col("tokens") * r * F.get("p", F.lit(k))), F.lit(0.0)) for k in range(len(DOMAINS))]).first()
        return [float(x) for x in row]

    has = totals(scored, F.lit(1.0))
    whole = reach * has[DOMAINS.index(anchor)] / weights[anchor]
    target = [weights.get(d, 0.0) * whole for d in DOMAINS]
    misses: list[list[float]] = []
    before, kept = None, 0
    moved = scored.select("tokens", "p", rate(F.col("p"), [], most).alias("r"))
    for _ in range(rounds):
        if len(misses) - kept == KEEP_EVERY:  # else each round would take all steps since the first again
            moved = reliable(moved.withColumn("r", rate(F.col("p"), misses[kept:], most, F.col("r"))))
            kept = len(misses)
        now = totals(moved, rate(F.col("p"), misses[kept:], most, F.col("r")))
        if before is not None and max(abs(a - b) for a, b in zip(now, before)) <= 1e-6 * max(1.0, sum(has)):
            break
        misses.append([(n - t) / h if h else 0.0 for n, t, h in zip(now, target, has)])
        before = now
    return misses


def _copies(r: Column, doc_id: Column, text_key: Column) -> Column:
    """The rate rounded up or down with its fraction as the chance, by a hash of the document."""
    dither = F.pmod(F.xxhash64(F.lit("copies"), doc_id, text_key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(r + dither).cast("long")


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], anchor: str = "clean", reach: float = 1.1,
          most: float = 1.0) -> DataFrame:
    """Per row: doc_id, tokens, the posterior of each domain, the fitted rate and the copies."""
    model = Shared(docs.sparkSession, fit_domains(docs, labels))
    scored = reliable(posteriors(docs, model, anchor))
    misses = fit_rates(scored, weights, anchor, reach, most)
    rated = scored.withColumn("rate", rate(F.col("p"), misses, most))
    return rated.select("doc_id", "tokens", *[F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate",
                        _copies(F.col("rate"), F.col("doc_id"), F.col("text_key")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], anchor: str = "clean", reach: float = 1.1,
          most: float = 1.0) -> DataFrame:
    """The documents, each as often as its rate says, with all their columns; no shuffle of texts.

    Texts are scored once: the rows are written with their posteriors to the shared folder, the fit
    reads the posteriors of that table alone and the result its rows.
    """
    spark = docs.sparkSession
    model = Shared(spark, fit_domains(docs, labels))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/mixed-{uuid.uuid4().hex}"
    _scored(docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("text_key")), model, anchor).write.parquet(folder)
    scored = spark.read.parquet(folder)
    copies = _copies(rate(F.col("p"), fit_rates(scored, weights, anchor, reach, most), most), F.col("row.doc_id"), F.col("text_key"))
    times = scored.select("row", copies.alias("copies")).filter("copies > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
