"""Ordered operators that survive a key holding a large share of all rows.

A plain window keeps every row of a key in one task. Here a key is cut into blocks by its
order column (a time bucket, a step range), the window runs per (key, block), and a small
table with one row per block carries the state from one block to the next. Blocks depend
on the data alone, so a lost executor changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_block(ts: Column, seconds: int = 3600) -> Column:
    """Block number of a timestamp."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def step_block(step: Column, width: int = 100_000) -> Column:
    """Block number of an integer position."""
    return F.floor(step / width).cast("long")


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, as it does in a window's partitions."""
    named = right.select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"_key_{k}" for k in keys])


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], block: Column, prefix: str = "prev_"
) -> DataFrame:
    """``lag`` of the value columns per key; null for the first row of a key."""
    rows = df.withColumn("_block", block)
    fields = F.struct(*values)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    last = rows.groupBy(*keys, "_block").agg(F.max_by(fields, F.struct(*order)).alias("_tail"))
    carry = last.select(
        *keys, "_block", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry")
    )
    out = match(rows.withColumn("_lag", F.lag(fields).over(inside)), carry, [*keys, "_block"], "left")
    found = F.coalesce("_lag", "_carry")
    for v in values:
        out = out.withColumn(prefix + v, found[v])
    return out.drop("_block", "_lag", "_carry")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    *,
    sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum, minimum, maximum and last non-null value per key, in order.

    ``inclusive=False`` looks at earlier rows only. The order columns must be unique per key.
    """
    specs = [(n, c, kind) for kind, d in (("sum", sums), ("min", mins), ("max", maxs), ("last", lasts))
             for n, c in (d or {}).items()]
    rows = df.withColumn("_block", block)
    for name, value, _ in specs:
        rows = rows.withColumn(f"_v_{name}", value)
    by = F.struct(*order)

    def total(name: str, kind: str) -> Column:
        v = F.col(f"_v_{name}")
        if kind == "last":
            return F.max_by(v, F.when(v.isNotNull(), by))
        return {"sum": F.sum, "min": F.min, "max": F.max}[kind](v)

    def over(name: str, kind: str, source: str, window) -> Column:
        v = F.col(source)
        if kind == "last":
            return F.last(v, ignorenulls=True).over(window)
        return {"sum": F.sum, "min": F.min, "max": F.max}[kind](v).over(window)

    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(*[total(n, k).alias(f"_t_{n}") for n, _, k in specs])
    carry = totals.select(
        *keys, "_block", *[over(n, k, f"_t_{n}", earlier).alias(f"_c_{n}") for n, _, k in specs]
    )
    out = rows.select("*", *[over(n, k, f"_v_{n}", inside).alias(f"_w_{n}") for n, _, k in specs])
    out = match(out, carry, [*keys, "_block"], "left")
    for name, _, kind in specs:
        here, before = F.col(f"_w_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            value = F.when(here.isNull() & before.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)))
        elif kind == "min":
            value = F.least(here, before)
        elif kind == "max":
            value = F.greatest(here, before)
        else:
            value = F.coalesce(here, before)
        out = out.withColumn(name, value).drop(f"_v_{name}", f"_w_{name}", f"_c_{name}")
    return out.drop("_block")


def trailing_range(
    df: DataFrame, keys: list[str], ts: str, seconds: int, aggs: dict[str, Column], block_seconds: int = 3600
) -> DataFrame:
    """Counts and sums over the half-open range ``(ts - seconds, ts]`` per key.

    Rows near the start of a block look back into the one before it, so each row is also
    handed to the next block if it lies within ``seconds`` of its start. That halo is a
    share ``seconds / block_seconds`` of the rows and is dropped at the end.

    A frame that slides is added up anew at each row. Here a block is cut into cells as long as the
    range, so a range is the rows of its own cell up to the row and those of the cell before that lie
    further on in their cell than the row does in its own: two running aggregates, each a single pass.
    """
    if block_seconds < seconds:
        raise ValueError("a block must be at least as long as the range")
    span, reach = block_seconds * 1_000_000, seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_us", micros).withColumn("_home", F.floor(F.col("_us") / span).cast("long"))
    near_end = (F.col("_home") + 1) * span - F.col("_us") < reach
    rows = rows.withColumn(
        "_block",
        F.explode(F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))),
    )
    since = F.col("_us") - F.col("_block") * span
    rows = rows.filter("_block IS NOT NULL").repartition(*keys, "_block").withColumn(
        "_cell", F.floor(since / reach).cast("long")).withColumn("_x", since - F.col("_cell") * reach)
    inside = Window.partitionBy(*keys, "_block", "_cell")
    upto = inside.orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = inside.orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "*", *[agg.over(upto).alias(f"_upto_{name}") for name, agg in aggs.items()],
        F.struct(*[agg.over(onward).alias(name) for name, agg in aggs.items()]).alias("_onward"))
    # each row asks the cell before, from its place on, and answers in its own
    rows = rows.withColumn("_asks", F.explode(F.array(F.lit(True), F.lit(False)))).filter(
        ~F.col("_asks") | (F.col("_block") == F.col("_home"))).withColumn(
        "_cell", F.col("_cell") - F.col("_asks").cast("long")).withColumn("_onward", F.when(~F.col("_asks"), F.col("_onward")))
    further = inside.orderBy(F.desc("_x"), F.desc("_asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_before", F.last("_onward", ignorenulls=True).over(further)).filter("_asks")
    for name in aggs:
        here, before = F.col(f"_upto_{name}"), F.col("_before")[name]
        rows = rows.withColumn(name, F.when(before.isNull(), here).when(here.isNull(), before).otherwise(here + before)).drop(f"_upto_{name}")
    return rows.drop("_us", "_home", "_block", "_cell", "_x", "_asks", "_onward", "_before")


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], bucket_width: float, levels: int = 2,
    fan: int = 1024,
) -> DataFrame:
    """Interpolated quantiles per key without gathering a key's values in one task.

    A first pass counts values per bucket and finds the buckets holding the wanted ranks.
    Each further level cuts those buckets, and only those, ``fan`` times finer. Distinct
    values are counted inside the last buckets alone. One row per key and prob.
    """
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull()).select(*keys, v.alias("_v"))
    path: list[str] = []
    wanted = None
    for level in range(levels + 1):
        name = f"_b{level}"
        # below the last bucket level the values themselves are the cells
        cell = F.col("_v") if level == levels else F.floor(F.col("_v") / (bucket_width / fan ** level))
        rows = rows.withColumn(name, cell)
        inside = rows if wanted is None else match(rows, wanted.select(*keys, *path).distinct(), [*keys, *path], "left_semi")
        every = Window.partitionBy(*keys, *path)
        before = every.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        counts = inside.groupBy(*keys, *path, name).agg(F.count("*").alias("_n")).withColumn(
            "_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        if wanted is None:
            points = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
            hits = counts.withColumn("_total", F.sum("_n").over(every)).withColumn("prob", points)
            hits = hits.withColumn("_r", F.col("prob") * (F.col("_total") - 1)).withColumn(
                "_rank", F.explode(F.array_distinct(F.array(F.floor("_r"), F.ceil("_r")))))
        else:
            hits = match(wanted, counts, [*keys, *path])
        path = [*path, name]
        wanted = hits.filter(
            (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
        ).select(*keys, *path, "prob", "_r", (F.col("_rank") - F.col("_before")).alias("_rank"))
    low, high = F.min(name), F.max(name)
    return wanted.groupBy(*keys, "prob").agg(
        (low + (high - low) * (F.first("_r") - F.floor(F.first("_r")))).alias("value"))
