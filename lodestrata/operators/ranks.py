"""The first n rows in an order without a task that holds n rows.

A histogram of the first order column finds the value at which the n-th row stands: equal-width bins,
counted, then finer ones within the bin that holds it, until few rows are left or one value is.
Rows below it pass a filter; only rows at it are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
# So many rows may be put in order by a plain top-n.
IN_ONE_TASK = 100_000
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _wall_micros(c: Column) -> Column:
    """Microseconds of a time without zone, from its parts: a cast would put it through the session's zone, where clocks are set back."""
    second = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return second * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


_TIMES = {"date": lambda c: F.unix_date(c).cast("long"), "timestamp": F.unix_micros, "timestamp_ntz": _wall_micros}


def _whole(df: DataFrame, name: str) -> Column | None:
    """The column as a whole number in the same order, where it has one."""
    kind = df.schema[name].dataType.simpleString()
    if kind in _WHOLE:
        return F.col(f"`{name}`").cast("long")
    return _TIMES[kind](F.col(f"`{name}`")) if kind in _TIMES else None


def smallest(df: DataFrame, order: list[str], n: int, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """The first ``n`` rows by the order columns, nulls first, in no particular order.

    The first column decides by its histogram if it is a whole number, a date or a timestamp; rows
    that tie on it are cut by the columns after it. Other columns take a plain top-n.
    """
    key = _whole(df, order[0]) if order else None
    if n <= in_one_task or key is None:
        return df.orderBy(*[F.col(f"`{c}`") for c in order]).limit(n) if order else df.limit(n)
    name = "_rank_key"
    keyed = df.withColumn(name, key)
    size = keyed.agg(F.count("*").alias("n"), F.count(name).alias("some"), F.min(name).alias("low"), F.max(name).alias("high")).first()
    nulls = size.n - size.some
    if n >= size.n:
        return df
    if n <= nulls:
        return smallest(df.filter(F.col(f"`{order[0]}`").isNull()), order[1:], n, in_one_task)
    low, high, below, held = size.low, size.high, nulls, size.some
    while held > in_one_task and low < high:
        width = -(-(high - low + 1) // BINS)
        bins = keyed.filter(F.col(name).between(low, high)).groupBy(F.expr(f"({name} - ({low}L)) div {width}L").alias("b"))
        for row in sorted(bins.agg(F.count("*").alias("c")).collect()):
            if below + row.c >= n:
                low, high, held = low + row.b * width, min(high, low + (row.b + 1) * width - 1), row.c
                break
            below += row.c
    passed = keyed.filter((F.col(name) < F.lit(low)) | F.col(name).isNull()).drop(name)
    edge = keyed.filter(F.col(name).between(low, high)).drop(name)
    rest = smallest(edge, order[1:], n - below, in_one_task) if low == high else smallest(edge, order, n - below, max(in_one_task, held))
    return passed.unionByName(rest)
