"""Model versions, stages, rollback targets and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.blocks import running, step_block
from lodestrata.session import checkpoint_dir


def latest_model_version(versions: DataFrame, by_stage: bool = False) -> DataFrame:
    """Newest version per model, or per model and stage."""
    keys = ["name", "stage"] if by_stage else ["name"]
    extra = [] if by_stage else [F.max_by("stage", "version").alias("stage")]
    return versions.groupBy(*keys).agg(F.max("version").alias("version"), *extra)


def current_stages(moves: DataFrame, archive_others: bool = True, order: str = "seq") -> DataFrame:
    """Stage of each (name, version) after a log of stage moves.

    A version stands where its last move put it. With ``archive_others`` a later move of
    another version into the same stage archives it, so only the newest occupant of a stage
    stays. Both facts are aggregates, so no model's history is sorted in one task.
    """
    last = moves.groupBy("name", "version").agg(
        F.max_by("stage", order).alias("stage"), F.max(order).alias("since"))
    if not archive_others:
        return last
    newest = moves.groupBy("name", "stage").agg(F.max(order).alias("_newest"))
    kept = (F.col("since") == F.col("_newest")) | (F.col("stage") == "Archived")
    return last.join(newest, ["name", "stage"]).select(
        "name", "version", F.when(kept, F.col("stage")).otherwise(F.lit("Archived")).alias("stage"), "since")


def rollback_target(deployments: DataFrame, good: Column, keys: list[str] = ["name"], order: str = "seq",
                    version: str = "version", block_width: int = 100_000) -> DataFrame:
    """For each deployment the last good version deployed before it."""
    return running(deployments, keys, [order], step_block(F.col(order), block_width),
                   lasts={"rollback_to": F.when(good, F.col(version))}, inclusive=False)


def lineage_gaps(stages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Stage inputs that no artifact carries; a stage without input starts a chain."""
    return stages.filter(F.col("input").isNotNull()).join(
        artifacts.select(F.col("artifact").alias("input")), "input", "left_anti")


def ancestors(edges: DataFrame) -> DataFrame:
    """Every (artifact, ancestor, distance) over ``edges(child, parent)``.

    Distances double: pairs exactly as far apart as reached so far are joined with all pairs found,
    which gives every pair up to twice as far, each at its shortest. A chain of n takes log n rounds; each is
    checkpointed. A cycle ends when no pair is as far apart as the reach.
    """
    checkpoint_dir(edges.sparkSession)
    found = edges.select(F.col("child").alias("artifact"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct().checkpoint()
    reach = 1
    while True:
        far = found.filter(F.col("distance") == reach).select("artifact", F.col("ancestor").alias("_via"))
        if far.isEmpty():
            return found
        onward = found.select(F.col("artifact").alias("_via"), "ancestor", "distance")
        longer = (
            far.join(onward, "_via").groupBy("artifact", "ancestor").agg((F.min("distance") + reach).alias("distance"))
            .join(found, ["artifact", "ancestor"], "left_anti").checkpoint()
        )
        found = found.unionByName(longer)
        reach *= 2


def stage_throughput(stages: DataFrame, keys: list[str]) -> DataFrame:
    """Items, seconds and items per second of each stage."""
    return stages.groupBy(*keys).agg(
        F.sum("items").cast("long").alias("items"),
        F.sum("seconds").alias("seconds"),
        (F.sum("items") / F.nullif(F.sum("seconds"), F.lit(0.0))).alias("items_per_second"),
    )
