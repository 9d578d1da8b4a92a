"""Small helpers shared by the text operators."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six white-space characters between words, as a regular-expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    The optimizer may inline a projected column into a lambda that reads it for each
    element; a lambda variable is never inlined.
    """
    return F.transform(F.array(value), body)[0]


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns of any name are left behind."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def pieces(text: Column) -> Column:
    """The text cut at each single white-space character; runs leave empty strings."""
    return F.split(F.regexp_replace(empty_as(text), r"[\x09-\x0D]", " "), " ")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null or blank text."""
    return F.filter(pieces(text), lambda w: w != "")


def running_total(numbers: Column, block: int = 256) -> Column:
    """Sums of the elements before each element, in two levels, so that long arrays stay cheap."""
    def inside(values: Column, base: Column) -> Column:
        return F.transform(values, lambda x, i: base + total(F.slice(values, F.lit(1), i)))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    def blocks(values: Column) -> Column:
        n = F.ceil(F.size(values) / block).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda b: F.slice(values, b * block + 1, F.lit(block)))
        return let(parts, lambda p: let(F.transform(p, total), lambda sums: F.flatten(F.transform(
            p, lambda part, b: inside(part, total(F.slice(sums, F.lit(1), b)))))))

    return let(numbers, blocks)


def empty_as(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


class Shared:
    """A value sent to every executor once; the caller answers for its size.

    It travels with the classes it is made of, so executors need no copy of this package.
    """

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self.sent.value)


def per_process(key: tuple, make: Callable):
    """A value made once in each Python process.

    Functions reach the workers by value, with fresh globals in each task; this outlives tasks.
    """
    held = sys.__dict__.setdefault("_held_per_process", {})
    if key not in held:
        held[key] = make()
    return held[key]
