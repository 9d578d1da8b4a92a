"""Language ID: a sparse multinomial model on TF-IDF character n-grams, calibrated.

Document frequencies of the hashed n-grams come from all documents that may be learned from; the
model is fitted on a bounded sample of them, ``per_language`` expected documents of each language and
twice as many at most, and sent to the tasks, which score every whole text.

Defined results: a null text or one without a letter is ``und`` with score 0; rows without a
language are scored, not learned from; a row without doc_id is not held out and not learned from;
with nothing to learn from every row is ``und``; repeated rows are scored one by one and learned from
once; more than MAX_LANGUAGES languages raise ValueError, as the model would not fit a task; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import sparse_model
from lodestrata.llm.common import Shared, columns, per_process
from lodestrata.llm.samples import labelled_texts

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 800
MAX_LANGUAGES = 1000
_PART = 1 << 20


def _letters() -> np.ndarray:
    return per_process(("letters",), lambda: np.array([chr(c).isalpha() for c in range(0x30000)]))


def _is_letter(codes: np.ndarray) -> np.ndarray:
    table = _letters()
    made = table[np.minimum(codes, len(table) - 1)]
    beyond = np.flatnonzero(codes >= len(table))
    made[beyond] = [chr(c).isalpha() for c in codes[beyond]]
    return made


def _codes(part: str) -> np.ndarray:
    """Code points in lower case, each run of other characters as one space."""
    codes = np.frombuffer(part.lower().encode("utf-32-le"), np.uint32)
    codes = np.where(_is_letter(codes), codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep].astype(np.uint64)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text with their counts; none if it has no letter."""
    total = np.zeros(BUCKETS, np.int64)
    some = False
    for at in range(0, len(text or ""), _PART):
        before = _codes(text[max(0, at - 2):at])  # n-grams may begin in the part before
        codes = np.concatenate([before, _codes(text[at:at + _PART])])
        some |= bool((codes != 32).any())
        hashed, found = np.zeros(len(codes), np.uint64), []
        for order in ORDERS:
            n = len(codes) - order + 1
            if n <= 0:
                break
            hashed = (hashed[:n] * np.uint64(0x9E3779B97F4A7C15)) + codes[order - 1:] + np.uint64(1)
            fresh = hashed[max(0, len(before) - order + 1):]
            found.append(((fresh * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64))
        total += np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(total) if some else np.zeros(0, np.int64)
    return at, total[at]


def _tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[at]
    return values / max(np.sqrt((values * values).sum()), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            seen[ngram_counts(text.as_py())[0]] += 1
            docs += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(seen[at], docs), pa.int64())})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [ngram_counts(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([
            batch.column("lang"), pa.array([a.tolist() for a, _ in made], pa.list_(pa.int32())),
            pa.array([c.tolist() for _, c in made], pa.list_(pa.int64()))], ["lang", "at", "counts"])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[sparse_model.Model, np.ndarray] | None:
    """The model and the inverse document frequencies, or None with nothing to learn from."""
    usable = columns(docs, "doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    if usable.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sample, sizes = labelled_texts(docs, usable.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("lang").alias("kind")), per_language)
    if not sizes:
        return None
    counted = usable.select("text").mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    frequency = {r.bucket: r.n for r in counted}
    seen = np.array([frequency.get(b, 0) for b in range(BUCKETS)])
    idf = np.log((1 + frequency[-1]) / (1 + seen)) + 1
    rows = sample.select(F.col("kind").alias("lang"), "text").mapInArrow(_features, "lang string, at array<int>, counts array<bigint>").collect()
    rows = sorted((r for r in rows if r["at"]), key=lambda r: (r.lang, r["at"], r["counts"]))
    if not rows:
        return None
    vectors = [(np.array(r["at"]), _tfidf(np.array(r["at"]), np.array(r["counts"]), idf)) for r in rows]
    return sparse_model.fit(vectors, [r.lang for r in rows], BUCKETS), idf


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and its calibrated probability as score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = Shared(docs.sparkSession, fit(docs, per_language))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text"):
                at, counts = ngram_counts(text.as_py())
                if model is None or not len(at):
                    names.append("und")
                    scores.append(0.0)
                    continue
                p = model[0].posterior(at, _tfidf(at, counts, model[1]))
                best = int(p.argmax())
                names.append(model[0].classes[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = columns(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
