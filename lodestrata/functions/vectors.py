"""Vector arithmetic on ARRAY columns, summed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    from lodestrata.functions.text import bind

    return bind(norm(a), lambda n: F.transform(as_double(a), lambda x: F.when(n > 0, x / n).otherwise(x)))


def mean_pool(df: DataFrame, keys: list[str], vector: str = "vector", mask: str | None = None) -> DataFrame:
    """Mask-weighted mean vector per key; the weight sum is at least 1e-9.

    Sums run per (key, position), so a key that owns most rows is merged map-side and the
    collected list is as long as the vector, never as long as the group.
    """
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    parts = (
        df.select(*keys, weight.alias("_w"), F.posexplode(as_double(F.col(vector))).alias("_pos", "_x"))
        .groupBy(*keys, "_pos")
        .agg((F.sum(F.col("_x") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-9))).alias("_x"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("_pos", "_x")))
    return parts.groupBy(*keys).agg(F.transform(ordered, lambda p: p["_x"]).alias(vector))
