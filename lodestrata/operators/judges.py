"""Lexical and vector stand-ins for judged metrics, and the hook for a real judge.

Every scorer works on arrays inside the row of its case, so cases never meet and nothing
shuffles. Overlap is the share of a sentence's distinct words found in the other text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions.text import bind, sentences, word_tokens
from lodestrata.functions.vectors import cosine_similarity
from lodestrata.operators.embedding import EmbeddingModel, hashing_model, vectors_udf
from lodestrata.operators.evaluation import CASE_PASS, LOW_IS_GOOD

SUPPORT = 0.5


def distinct_words(text: Column) -> Column:
    return F.array_distinct(word_tokens(text))


def overlap(part: Column, whole: Column) -> Column:
    """Share of the distinct words in ``part`` that ``whole`` holds; both are word sets."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(F.lit(0.0))


def _share(units: Column, test: Callable[[Column], Column]) -> Column:
    """Share of the units that pass; null if there are none."""
    return bind(units, lambda u: F.when(F.size(u) > 0, F.size(F.filter(u, test)) / F.size(u)))


def _word_sets(texts: Column) -> Column:
    return F.transform(texts, distinct_words)


def supported_share(claims: Column, evidence: Column, support: float = SUPPORT) -> Column:
    """Share of sentences that some evidence text covers."""
    def against(sets: Column) -> Column:
        return _share(
            F.filter(_word_sets(sentences(claims)), lambda w: F.size(w) > 0),
            lambda s: F.exists(sets, lambda c: overlap(s, c) >= support),
        )
    return bind(_word_sets(evidence), against)


def context_precision(contexts: Column, truth: Column, support: float = SUPPORT) -> Column:
    """Sum of precision@i over the relevant ranks, divided by their number; 0 if none is relevant.

    A context is relevant if it covers enough of the truth's words.
    """
    def score(flags: Column) -> Column:
        done = F.aggregate(
            flags,
            F.struct(F.lit(0).alias("i"), F.lit(0).alias("hits"), F.lit(0.0).alias("total")),
            lambda s, r: F.struct(
                (s["i"] + 1).alias("i"),
                (s["hits"] + r).alias("hits"),
                (s["total"] + F.when(r == 1, (s["hits"] + 1) / (s["i"] + 1)).otherwise(0.0)).alias("total"),
            ),
            lambda s: F.when(s["hits"] > 0, s["total"] / s["hits"]).otherwise(F.lit(0.0)),
        )
        return done

    flags = bind(distinct_words(truth), lambda t: F.transform(
        _word_sets(contexts), lambda c: (overlap(t, c) >= support).cast("int")))
    return bind(flags, score)


def context_relevancy(contexts: Column, question: Column) -> Column:
    """Share of context sentences that share a word with the question."""
    every = F.flatten(F.transform(contexts, sentences))
    return bind(distinct_words(question), lambda q: _share(
        _word_sets(every), lambda s: F.arrays_overlap(s, q)))


def _similarity(a: str, b: str) -> Column:
    """Cosine of two vector columns, 0 if a text has no words."""
    return F.coalesce(cosine_similarity(F.col(a), F.col(b)), F.lit(0.0))


def _with_vectors(df: DataFrame, model: EmbeddingModel | None, **texts: Column) -> DataFrame:
    model = model or hashing_model()
    made = vectors_udf(model, list(texts))(*[model.prepare(t) for t in texts.values()])
    return df.select("*", made.alias("_vectors")).select("*", "_vectors.*").drop("_vectors")


def token_f1(a: Column, b: Column) -> Column:
    """F1 over distinct words."""
    def score(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["a"], pair["b"]))
        total = F.size(pair["a"]) + F.size(pair["b"])
        return F.when(total > 0, 2.0 * both / total).otherwise(F.lit(0.0))
    return bind(F.struct(distinct_words(a).alias("a"), distinct_words(b).alias("b")), score)


def rag_scores(samples: DataFrame, key: str = "case_id", truth_from_answer: bool = False,
               model: EmbeddingModel | None = None) -> DataFrame:
    """The retrieval metrics per case, long form.

    A missing ground truth counts as empty text, or as the answer with ``truth_from_answer``.
    """
    truth = F.coalesce(F.col("ground_truth"), F.col("answer") if truth_from_answer else F.lit(""))
    question, answer, contexts = F.col("question"), F.col("answer"), F.col("contexts")
    similar = _similarity("_answer", "_truth")
    rows = _with_vectors(samples, model, _question=question, _answer=answer, _truth=truth)
    wide = rows.select(
        F.col(key),
        supported_share(answer, contexts).alias("faithfulness"),
        _similarity("_question", "_answer").alias("answer_relevancy"),
        context_precision(contexts, truth).alias("context_precision"),
        supported_share(truth, contexts).alias("context_recall"),
        context_relevancy(contexts, question).alias("context_relevancy"),
        similar.alias("answer_similarity"),
        (0.75 * token_f1(answer, truth) + 0.25 * similar).alias("answer_correctness"),
    )
    return long_scores(wide, key)


def case_scores(cases: DataFrame, key: str = "case_id", model: EmbeddingModel | None = None) -> DataFrame:
    """Hallucination, relevance and groundedness per test case, long form."""
    faithful = supported_share(F.col("actual_output"), F.col("context"))
    rows = _with_vectors(cases, model, _input=F.col("input"), _output=F.col("actual_output"))
    wide = rows.select(
        F.col(key),
        (1 - faithful).alias("hallucination"),
        _similarity("_input", "_output").alias("relevance"),
        supported_share(F.col("actual_output"), F.col("retrieval_context")).alias("groundedness"),
    )
    return long_scores(wide, key)


def long_scores(wide: DataFrame, key: str, threshold: float = CASE_PASS) -> DataFrame:
    """Metric columns to rows with success by threshold; metrics without a score are left out."""
    metrics = [c for c in wide.columns if c != key]
    rows = wide.unpivot([key], metrics, "metric", "score").filter(F.col("score").isNotNull())
    low = F.col("metric").isin(*LOW_IS_GOOD)
    ok = F.when(low, F.col("score") <= threshold).otherwise(F.col("score") >= threshold)
    return rows.withColumn("success", ok)


def judge(cases: DataFrame, score: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Run an outside judge over Arrow batches; it yields rows of the score table."""
    return cases.mapInPandas(score, schemas.SCORE)


@dataclass(frozen=True)
class WordModel:
    """A logistic model of hashed words as plain numbers: a weight per bucket and the intercept."""

    weights: np.ndarray
    intercept: float


def _word_buckets(text: str, features: int) -> Column:
    return F.array_distinct(F.transform(word_tokens(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int")))


def toxicity_model(labelled: DataFrame, text: str = "text", label: str = "toxic", features: int = 4096) -> WordModel:
    """Hashed words and logistic regression, fitted on labelled text."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    names = F.transform(_word_buckets(text, features), lambda b: b.cast("string"))
    rows = labelled.filter(F.col(label).isNotNull()).select(names.alias("_buckets"), F.col(label).cast("double").alias("label"))
    hashing = HashingTF(numFeatures=4 * features, binary=True, inputCol="_buckets", outputCol="features")
    fitted = LogisticRegression(maxIter=20, regParam=0.01).fit(hashing.transform(rows))
    # Scores need the numbers alone; the fitted object with its summary stays on the driver.
    coefficients = fitted.coefficients.toArray()
    return WordModel(np.array([coefficients[hashing.indexOf(str(b))] for b in range(features)]), float(fitted.intercept))


def toxicity_scores(docs: DataFrame, model: WordModel, key: str, text: str = "text") -> DataFrame:
    weights, intercept = model.weights, model.intercept

    @F.pandas_udf("double")
    def chance(buckets: pd.Series) -> pd.Series:
        found = [np.asarray(b, dtype=np.int64) if b is not None else np.zeros(0, np.int64) for b in buckets]
        return pd.Series([1.0 / (1.0 + np.exp(-(weights[b].sum() + intercept))) for b in found], dtype=float)

    score = chance(_word_buckets(text, len(weights)))
    return docs.select(key, score.alias("score")).select(
        key, F.lit("toxicity").alias("metric"), "score", (F.col("score") <= CASE_PASS).alias("success"))
