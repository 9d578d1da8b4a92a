"""Bounded samples of labelled rows for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import columns
from lodestrata.llm.components import reliable

_SPACE = 1 << 52


def labelled_texts(docs: DataFrame, kinds: DataFrame, per_kind: int) -> tuple[DataFrame, dict]:
    """``(kind, text)`` of about ``per_kind`` different documents of each kind, and how many there are of each.

    ``kinds`` has doc_id, text_key (the text's xxhash64) and kind. Rows that repeat count once, so
    that neither a repeated document nor a repeated doc_id swells the sample; documents are drawn
    by a hash of both, and twice ``per_kind`` for each kind is the most that is taken.
    """
    different = reliable(kinds.distinct())
    sizes = {r.kind: r.n for r in different.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return docs.select(F.lit("").alias("kind"), "text").limit(0), {}
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(_SPACE, -(-per_kind * _SPACE // n)))])
    drawn = different.withColumn("draw", F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text_key"), F.lit(_SPACE)))
    drawn = drawn.filter(F.col("draw") < share[F.col("kind")]).orderBy("draw", "doc_id", "text_key").limit(2 * per_kind * len(sizes))
    keyed = columns(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    # The sample is bounded by its parameter, so it may be sent to every task.
    met = keyed.join(F.broadcast(drawn.drop("draw")), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key", "kind"])
    return met.select("kind", "text"), sizes
