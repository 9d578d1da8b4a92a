"""Connected components of a link table by alternating star contraction.

Each round replaces links by links to the smallest neighbour, first on the larger side of a
node and then on the smaller one, until nothing changes. A round is two grouped minima and two
equi-joins; it is cut off by ``checkpoint()``. Nothing is collected but two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import checkpoint_dir


def reliable(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and cut from their lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x


def _star(links: DataFrame, keep) -> DataFrame:
    """Give every node ``a`` the smallest of its neighbours ``b`` and itself, then link by ``keep``."""
    least = links.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    return keep(links.join(least, "a"), least).filter("a <> b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the pairs ``(a, b)``; the root is the least node reachable.

    Self-links and repeated pairs do no harm; an empty table gives an empty table.
    """
    # A star has its centre in b: a > b always.
    links = reliable(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state, before = _state(links), None
    while state != before:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, lambda j, _: j.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))
        links = reliable(_star(large, lambda j, least: j.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(
            least.select("a", F.col("least").alias("b")))))
        before, state = state, _state(links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
