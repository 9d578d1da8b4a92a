"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A document is a bag of sentences. A sentence's score is the logistic of its words' weights; the
document's is their noisy-or, the chance that at least one sentence is toxic. Weights are learned
from document labels alone, so the sentences that carry the label are found on the way.

The fit takes a bounded sample of labelled documents, ``PER_LABEL`` expected of each label,
weighted back to the shares that the labels have; features are hashed words and word beginnings
that at least ``LEAST_DOCUMENTS`` of the sample hold. It is a full-batch proximal gradient, so
neither order nor partitions change it. Scores cover every whole text and need no shuffle.

Defined results: a null text counts as empty; a text without words has no sentence and score 0;
labels with nulls are not learned from, nor are rows without doc_id, which count as not held out;
with one label only, or none, every text scores 0, or 1 if all labels are 1 and it has words;
contradicting labels of a doc_id each count; repeated rows are scored one by one; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import pretokens
from lodestrata.llm.common import Shared, columns
from lodestrata.llm.samples import labelled_texts

FEATURES = 1 << 18
BEGINNINGS = (3, 4, 5, 6, 7)
PER_LABEL = 2000
LEAST_DOCUMENTS = 3
ROUNDS, RATE, PENALTY = 160, 0.5, 2e-4
_ENDS = "([.!?。！？]+|\n+)"


@dataclass
class Sentences:
    """Sentences of some texts, those of text k at ``of == k``, and the numbers of their words."""

    of: np.ndarray
    lengths: np.ndarray  # code points, all of a text's add up to its length
    starts: np.ndarray  # of each sentence's words in ``words``, and the end
    words: np.ndarray
    names: pa.Array

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)


def sentences(texts: pa.Array) -> Sentences:
    """Cut at sentence marks and line ends; words are runs of letters and digits in lower case."""
    texts = pc.fill_null(texts, "")
    mark = next(m for m in map(chr, range(0xE000, 0xF8FF)) if not pc.any(pc.match_substring(texts, m)).as_py())
    lists = pc.split_pattern(pc.replace_substring_regex(texts, _ENDS, rf"\1{mark}"), mark)
    of = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    each = lists.flatten()
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(each), r"[^\pL\pN]+", " "))
    words = pc.ascii_split_whitespace(plain)
    coded, starts = words.flatten().dictionary_encode(), words.offsets.to_numpy().astype(np.int64)
    numbers, starts = coded.indices.to_numpy(), starts - starts[0]
    # A sentence without words is one empty string, which is no word.
    real = (pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False))[numbers]
    starts = np.concatenate([[0], np.cumsum(real)])[starts]
    return Sentences(of, pc.utf8_length(each).to_numpy().astype(np.int64), starts, numbers[real], coded.dictionary)


def _hashed(names: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, names.cast(pa.binary()).to_pylist()), np.int64, len(names)) % FEATURES


def word_features(names: pa.Array) -> np.ndarray:
    """Per word its features: itself and its beginnings; FEATURES where it is no longer than a beginning."""
    length = pc.utf8_length(names).to_numpy()
    made = [_hashed(names)]
    for k in BEGINNINGS:
        begun = _hashed(pc.binary_join_element_wise(pc.utf8_slice_codeunits(names, 0, k), "\x00", ""))
        made.append(np.where(length > k, begun, FEATURES))
    return np.stack(made, 1)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0.0], np.cumsum(values)])
    return running[starts[1:]] - running[starts[:-1]]


def _logistic(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -x))


@dataclass
class Model:
    weights: np.ndarray  # one more than FEATURES, the last is zero
    bias: float

    def sentence_scores(self, made: Sentences) -> np.ndarray:
        """The score of each sentence; 0 without words."""
        value = self.weights[word_features(made.names)].sum(1)
        scores = _logistic(_sums(value[made.words], made.starts) + self.bias)
        return np.where(made.sizes > 0, scores, 0.0)


def noisy_or(scores: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """Per text the chance that at least one of its sentences is toxic."""
    with np.errstate(divide="ignore"):
        clean = np.bincount(of, np.log1p(-scores), minlength=texts)
    return -np.expm1(clean)


def loss(logits: np.ndarray, of: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log loss of the noisy-or of sentence logits, and its slope by each logit."""
    clean = np.bincount(of, np.logaddexp(0.0, logits), minlength=len(toxic))  # minus the log chance that all are clean
    clean = np.maximum(clean, 1e-12)
    value = np.where(toxic, -np.log(-np.expm1(-clean)), clean)
    pull = np.where(toxic, -1.0 / np.expm1(np.minimum(clean, 700.0)), 1.0) * weight
    return float((value * weight).sum()), pull[of] * _logistic(logits)


def learn(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Weights of least penalised loss by proximal steps with a pace per weight; weights of the documents sum to one."""
    made = sentences(texts)
    table = word_features(made.names)
    place = np.repeat(np.arange(len(made.of)), made.sizes)
    # Documents that hold a word, then those that hold a feature.
    pairs = np.unique(made.of[place] * len(table) + made.words) if len(table) else np.zeros(0, np.int64)
    holds = np.unique((pairs // max(len(table), 1))[:, None] * (FEATURES + 1) + table[pairs % max(len(table), 1)]) % (FEATURES + 1)
    frequent = np.bincount(holds, minlength=FEATURES + 1) >= LEAST_DOCUMENTS
    frequent[FEATURES] = False
    names = np.flatnonzero(frequent)
    number = np.full(FEATURES + 1, len(names))
    number[names] = np.arange(len(names))
    table = number[table]
    used = np.flatnonzero(made.sizes > 0)
    row, of = (np.cumsum(made.sizes > 0) - 1)[place], made.of[used]
    w, bias = np.zeros(len(names) + 1), -5.0  # the last stands for rare features and stays zero
    pace, pace_bias = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        logits = np.bincount(row, w[table].sum(1)[made.words], minlength=len(used)) + bias
        _, slope = loss(logits, of, toxic, weight)
        by_word = np.bincount(made.words, slope[row], minlength=len(table))
        g, g_bias = np.bincount(table.ravel(), np.repeat(by_word, table.shape[1]), minlength=len(w)), float(slope.sum())
        pace, pace_bias = pace + g * g, pace_bias + g_bias * g_bias
        step = rate / np.sqrt(pace)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0.0)
        w[-1] = 0.0
        bias -= rate / np.sqrt(pace_bias) * g_bias
    whole = np.zeros(FEATURES + 1)
    whole[names] = w[:-1]
    return Model(whole, bias)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 on division by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """The model of a bounded sample of the labelled documents that are not held out."""
    marked = columns(labels, "doc_id", "toxic").filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("kind")).distinct()
    present = columns(docs, "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_key")).join(marked, "doc_id")
    sample, sizes = labelled_texts(docs, present, per_label)
    if len(sizes) < 2:
        return Model(np.zeros(FEATURES + 1), np.inf if 1 in sizes else -np.inf)
    rows = sample.toArrow().sort_by([("kind", "ascending"), ("text", "ascending")])
    toxic = rows.column("kind").to_numpy() == 1
    weight = np.zeros(len(toxic))
    for kind, size in sizes.items():
        of_kind = toxic == (kind == 1)
        weight[of_kind] = size / max(1, of_kind.sum())
    return learn(rows.column("text").combine_chunks(), toxic, weight / weight.sum())


def score(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the offending sentences with start, end (code points) and score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = Shared(docs.sparkSession, fit(docs, labels, per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start, texts in pretokens.slices(batch.column("text")):
                made = sentences(texts)
                scores = model.sentence_scores(made)
                whole = noisy_or(scores, made.of, len(texts))
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(whole), pa.array((whole >= 0.5).astype(np.int32)), _spans(made, scores, len(texts))],
                    ["doc_id", "held_out", "score", "predicted", "offending"])

    rows = columns(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, "
                                "offending array<struct<start: bigint, end: bigint, score: double>>")


def _spans(made: Sentences, scores: np.ndarray, texts: int) -> pa.Array:
    """The sentences with a score of at least a half, per text."""
    ends = np.cumsum(made.lengths)
    first = np.concatenate([[0], np.cumsum(np.bincount(made.of, made.lengths, minlength=texts))]).astype(np.int64)
    ends = ends - first[made.of]
    at = np.flatnonzero(scores >= 0.5)
    items = pa.StructArray.from_arrays([pa.array((ends - made.lengths)[at]), pa.array(ends[at]), pa.array(scores[at])], ["start", "end", "score"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(made.of[at], minlength=texts))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
