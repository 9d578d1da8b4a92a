"""Training rows, metric logs, perplexity, checkpoints, early stopping and trials."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.blocks import match, running, step_block
from lodestrata.functions.text import word_tokens
from lodestrata.operators.ranks import IN_ONE_TASK, smallest
from lodestrata.session import checkpoint_dir

# Fixed values.
MAX_LENGTH = 2048
PERPLEXITY_LIMIT = 50.0
TRAIN_NAMES = ("loss", "learning_rate", "epoch")
HEALTH_LOSS, HEALTH_GAP, HEALTH_RATE = 1.0, 0.5, 5.0
# Records of whole blocks that one call shortens.
RECORDS_A_CALL = 20_000


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer behind the batch hook: ``load()`` runs once per worker and returns a function from texts to lists of ids."""

    name: str
    load: Callable[[], Callable[[list[str]], list[list[int]]]]
    batch: int = 1024


def tokenizer_udf(tokenizer: Tokenizer, max_length: int):
    """Ids cut at ``max_length`` with the length before the cut, some texts a call."""
    load, size = tokenizer.load, tokenizer.batch

    @F.pandas_udf("ids array<int>, size long")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = load()
        for batch in batches:
            texts = batch.fillna("").tolist()
            made = [ids for k in range(0, len(texts), size) for ids in run(texts[k:k + size])]
            yield pd.DataFrame({"ids": [np.asarray(ids[:max_length], np.int32) for ids in made], "size": [len(ids) for ids in made]})

    # keeps the optimizer from encoding a second time inside a pushed-down filter
    return encode.asNondeterministic()


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail with the list of available columns if one is missing; runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def first_n(df: DataFrame, n: int, order: list[str], in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """The first n rows by key; files have no row order in Spark, so a key is needed."""
    return smallest(df, order, n, in_one_task)


def eval_first_n(df: DataFrame, max_samples: int, order: list[str]) -> DataFrame:
    return first_n(df, max_samples // 10, order)


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """n rows chosen by a seeded hash of the key: the same rows however the data is split."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    # The digest's first digits as a number stand before the digest itself: the order is the same.
    drawn = df.withColumns({"_number": F.conv(F.substring(draw, 1, 15), 16, 10).cast("long"), "_draw": draw})
    return smallest(drawn, ["_number", "_draw", key], n, in_one_task).drop("_number", "_draw")


def project_text_column(df: DataFrame, text: str, key: str) -> DataFrame:
    """Tokenise one column and drop all the others."""
    return df.select(key, word_tokens(F.col(text)).alias("tokens"))


def tokenize_truncate(df: DataFrame, text: str, keep: list[str], max_length: int = MAX_LENGTH, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Tokens cut at ``max_length``, unpadded, with the length and a flag: words, or the ids of a tokenizer."""
    if tokenizer is not None:
        made = df.select(*keep, tokenizer_udf(tokenizer, max_length)(F.col(text)).alias("_made"))
        return made.select(*keep, F.col("_made.ids").alias("tokens"), F.least(F.col("_made.size"), F.lit(max_length)).cast("int").alias("n_tokens"),
                           (F.col("_made.size") > max_length).alias("truncated"))
    full = df.select(*keep, word_tokens(F.col(text)).alias("_all"))
    return full.select(
        *keep,
        F.slice("_all", 1, max_length).alias("tokens"),
        F.least(F.size("_all"), F.lit(max_length)).alias("n_tokens"),
        (F.size("_all") > max_length).alias("truncated"),
    )


def _numeric_logs(logs: DataFrame, keep: list[str]) -> DataFrame:
    return logs.select(*keep, F.explode("logs").alias("name", "value")).filter(F.col("value").isNotNull())


def rename_training_metrics(logs: DataFrame, keep: list[str] = ["run_id", "step"]) -> DataFrame:
    """``eval_x`` to ``eval/x``; loss, learning rate and epoch under ``train/``; names with ``_`` in front go."""
    name = F.col("name")
    renamed = (
        F.when(name.startswith("eval_"), F.concat(F.lit("eval/"), F.expr("substring(name, 6)")))
        .when(name.isin(*TRAIN_NAMES), F.concat(F.lit("train/"), name))
        .otherwise(name)
    )
    rows = _numeric_logs(logs, keep).filter(~name.startswith("_"))
    return rows.select(*keep, renamed.alias("metric"), "value")


def rename_eval_metrics(logs: DataFrame, keep: list[str] = ["run_id", "step"]) -> DataFrame:
    """Every ``eval_`` removed and ``eval/`` put in front."""
    renamed = F.concat(F.lit("eval/"), F.replace(F.col("name"), F.lit("eval_"), F.lit("")))
    return _numeric_logs(logs, keep).select(*keep, renamed.alias("metric"), "value")


def perplexity(batches: DataFrame, keys: list[str], loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    """exp of the token-weighted mean loss."""
    weighted = F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)
    return batches.groupBy(*keys).agg(weighted.alias("avg_loss"), F.exp(weighted).alias("perplexity"))


def register_gate(results: DataFrame, limit: float = PERPLEXITY_LIMIT) -> DataFrame:
    """Register unless perplexity is above the limit; a missing value counts as 0."""
    return results.withColumn("register", F.coalesce("perplexity", F.lit(0.0)) <= limit)


def training_health(logs: DataFrame, keys: list[str] = ["run_id"], order: str = "step") -> DataFrame:
    """Verdicts on the last logged loss, eval loss and sample rate of each run."""
    def last(name: str) -> Column:
        value = F.col("logs")[name]
        return F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(name)

    return logs.groupBy(*keys).agg(last("loss"), last("eval_loss"), last("samples_per_second")).select(
        *keys, "loss", "eval_loss", "samples_per_second",
        (F.col("loss") < HEALTH_LOSS).alias("converged"),
        (F.col("eval_loss") - F.col("loss") < HEALTH_GAP).alias("no_overfit"),
        (F.col("samples_per_second") > HEALTH_RATE).alias("fast_enough"),
    )


# -- checkpoints ---------------------------------------------------------------------


def _metric_order(greater_is_better: bool) -> list[Column]:
    metric = F.col("metric").desc_nulls_last() if greater_is_better else F.col("metric").asc_nulls_last()
    return [metric, F.col("step").asc()]


def keep_best_checkpoints(checkpoints: DataFrame, n: int = 3, greater_is_better: bool = False,
                          keys: list[str] = ["run_id"], block_width: int = 100_000) -> DataFrame:
    """The best n per run; ties keep the earlier one, a missing metric ranks last.

    Ranked twice: first inside step ranges, which splits a run with very many checkpoints,
    then over the few survivors.
    """
    order = _metric_order(greater_is_better)
    parts = checkpoints.withColumn("_block", step_block(F.col("step"), block_width))
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    few = parts.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= n).drop("_r", "_block")
    return few.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n)


def latest_checkpoint(checkpoints: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    return checkpoints.groupBy(*keys).agg(F.max("step").alias("step"), F.max_by("path", "step").alias("path"))


def best_checkpoint(checkpoints: DataFrame, greater_is_better: bool = False, keys: list[str] = ["run_id"]) -> DataFrame:
    """Best by metric, the earliest on a tie; the latest if no checkpoint has a metric.

    Plain aggregates with map-side merging, no sort of a run's rows.
    """
    known = F.col("metric").isNotNull()
    signed = -F.col("metric") if greater_is_better else F.col("metric")
    row = F.struct("step", "path", "metric")
    best = F.min_by(row, F.when(known, F.struct(signed.alias("m"), F.col("step"))))
    picked = checkpoints.groupBy(*keys).agg(F.coalesce(best, F.max_by(row, "step")).alias("_b"))
    return picked.select(*keys, "_b.*")


def last_metric_before_save(logs: DataFrame, metric: str, keys: list[str] = ["run_id"],
                            block_width: int = 100_000) -> DataFrame:
    """Each log row with the newest value of the metric at or before it."""
    rows = logs.withColumn("_value", F.col("logs")[metric])
    return running(rows, keys, ["step"], step_block(F.col("step"), block_width),
                   lasts={"metric_at_save": F.col("_value")}).drop("_value")


def resume_checkpoint(checkpoints: DataFrame, failures: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    """The last checkpoint before each run's failed step (by number); one failure per run."""
    joined = match(checkpoints, failures, keys).filter(F.col("step") < F.col("failed_step"))
    return joined.groupBy(*keys, "failed_step").agg(
        F.max("step").alias("resume_step"), F.max_by("path", "step").alias("resume_path"))


# -- early stopping ------------------------------------------------------------------


def early_stopping(evals: DataFrame, patience: int = 3, threshold: float = 0.0, greater_is_better: bool = False,
                   keys: list[str] = ["run_id"], order: str = "step", metric: str = "metric",
                   block_width: int = 100_000) -> DataFrame:
    """Stop step (null if training runs on), best value and number of evaluations per run."""
    made = early_stopping_state(evals, None, patience, threshold, greater_is_better, keys, order, metric, block_width)
    return made.select(*keys, "evaluations", "best", "stop_step", "stopped")


def early_stopping_state(evals: DataFrame, state: DataFrame | None, patience: int = 3, threshold: float = 0.0,
                         greater_is_better: bool = False, keys: list[str] = ["run_id"], order: str = "step",
                         metric: str = "metric", block_width: int = 100_000) -> DataFrame:
    """Move the stopping state of every run on by a batch of evaluations.

    The first value is the baseline; an improvement beats the best by more than the
    threshold; ``patience`` misses in a row stop the run. Only a new record can be an
    improvement, so records are found first, in parallel over step ranges (blocks) of each
    run. With threshold 0 every record is an improvement, and the first gap between records
    that is too long decides; blocks are summed up before runs are. With a threshold the
    records point at the next one that is low enough, and pointers are doubled over blocks.

    A run of an earlier batch enters as a baseline row numbered by its misses so far;
    steps of a batch must lie behind those of earlier ones.
    """
    sign = -1.0 if greater_is_better else 1.0
    rows = evals.filter(F.col(metric).isNotNull()).select(
        *keys, F.col(order).cast("long").alias("_at"), (F.col(metric).cast("double") * sign).alias("_m"),
        F.lit(None).cast("long").alias("_misses"))
    if state is not None:
        late = rows.groupBy(*keys).agg(F.count("*").alias("_late"))
        rows = match(rows, state.filter("stopped").select(*keys), keys, "left_anti").unionByName(
            state.filter("not stopped").select(
                *keys, F.col("last_step").alias("_at"), (F.col("best") * sign).alias("_m"),
                F.col("misses").alias("_misses")))
    rows = rows.withColumn("_block", step_block(F.col("_at"), block_width))
    base = F.col("_misses").isNotNull()
    block_keys = [*keys, "_block"]

    # one row per block: what came before it, and the totals of its run
    run = Window.partitionBy(*keys)
    earlier = run.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*block_keys).agg(
        F.count_if(~base).alias("_c"), F.min("_m").alias("_low"), F.max("_at").alias("_last_at")
    ).select(
        *block_keys, "_c",
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
        F.min("_low").over(earlier).alias("_before_low"),
        F.sum("_c").over(run).alias("evaluations"), F.max("_last_at").over(run).alias("last_step"))

    inside = Window.partitionBy(*block_keys).orderBy("_at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    low = F.least("_before_low", F.min("_m").over(above))
    number = F.when(base, -F.col("_misses")).otherwise(
        F.col("_before") + F.sum((~base).cast("long")).over(so_far))
    records = (
        match(rows, blocks, block_keys).withColumn("_n", number).withColumn("_best", low)
        .filter(F.col("_best").isNull() | (F.col("_m") < F.col("_best"))))
    if threshold == 0.0:
        found = _first_long_gap(records, keys, inside, patience)
    else:
        found = _linked_records(records, keys, patience, threshold)

    # the step of evaluation number _stop_n: only its block is read again
    at = (F.col("_stop_n") > F.col("_before")) & (F.col("_stop_n") <= F.col("_before") + F.col("_c"))
    target = match(blocks.select(*block_keys, "_before", "_c"),
                   found.filter(F.col("_stop_n").isNotNull()).select(*keys, "_stop_n"), keys).filter(at)
    stops = (
        match(rows.filter(~base).select(*block_keys, "_at"), target, block_keys)
        .withColumn("_i", F.row_number().over(inside))
        .filter(F.col("_before") + F.col("_i") == F.col("_stop_n"))
        .select(*keys, F.col("_at").alias("stop_step")))
    out = match(found, stops, keys, "left").select(
        *keys, "evaluations", (F.col("_b") * sign).alias("best"),
        (F.col("evaluations") - F.col("_last_n")).alias("misses"), "last_step", "stop_step",
        F.col("_stop_n").isNotNull().alias("stopped"))
    if state is None:
        return out
    before = state.select(*keys, F.col("evaluations").alias("_before"))
    moved = match(out, before, keys, "left").withColumn(
        "evaluations", F.col("evaluations") + F.coalesce("_before", F.lit(0))).drop("_before")
    # a stopped run is not judged again, but its evaluations are counted on as in one batch
    ended = match(state.filter("stopped"), late, keys, "left").withColumn(
        "evaluations", F.col("evaluations") + F.coalesce("_late", F.lit(0))).drop("_late")
    return moved.unionByName(ended)


def _first_long_gap(records: DataFrame, keys: list[str], inside, patience: int) -> DataFrame:
    """Per run the first record that nothing improves on for ``patience`` evaluations."""
    this = F.struct("_n", "_m")
    gap = F.lead("_n").over(inside) - F.col("_n")
    per_block = records.withColumn("_gap", gap).groupBy(*keys, "_block").agg(
        F.first("evaluations").alias("evaluations"), F.first("last_step").alias("last_step"),
        F.min("_n").alias("_first"), F.max_by(this, "_n").alias("_last"),
        F.min_by(this, F.when(F.col("_gap") > patience, F.col("_n"))).alias("_hit"))
    following = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block"))
    closing = F.coalesce(following, F.col("evaluations") + 1) - F.col("_last._n")
    per_block = per_block.withColumn("_hit", F.coalesce("_hit", F.when(closing > patience, F.col("_last"))))
    per_run = per_block.groupBy(*keys).agg(
        F.first("evaluations").alias("evaluations"), F.first("last_step").alias("last_step"),
        F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("_block"))).alias("_hit"),
        F.max_by("_last", "_block").alias("_last"))
    best = F.coalesce("_hit", "_last")
    return per_run.select(
        *keys, "evaluations", "last_step", (F.col("_hit._n") + patience).alias("_stop_n"),
        best["_m"].alias("_b"), best["_n"].alias("_last_n"))


def _linked_records(records: DataFrame, keys: list[str], patience: int, threshold: float) -> DataFrame:
    """Per run the record at which its improvements end, by pointer doubling.

    Every record points to the next one that is lower by more than the threshold; a record ends the
    run if there is none or it is more than ``patience`` evaluations away. Records fall along a
    run, so the records of a block point into a staircase of later blocks: the pairs of blocks that
    meet are at most twice the blocks. Paths are then shortened within each block, and the records
    at which paths enter a block are joined with themselves until the first record of each run points
    at its end, in as many rounds as the logarithm of the blocks. No task holds a run.
    """
    block = [*keys, "_block"]
    rows = records.select(*block, "_n", "_m", "evaluations", "last_step")
    checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint()
    run = Window.partitionBy(*keys)
    blocks = rows.groupBy(*block).agg(F.min("_m").alias("_low"), F.max("_m").alias("_high")).withColumns({
        "_k": F.row_number().over(run.orderBy("_block")), "_above": F.lag("_low").over(run.orderBy("_block")),
        "_last_k": F.count("*").over(run)})

    # which blocks the first and the last record of each block point into: the highest block low under their aim
    lows = blocks.select(*keys, F.col("_low").alias("_v"), F.lit(1).alias("_kind"), F.col("_k").alias("_at"), F.lit(None).cast("long").alias("_of"))
    aims = [blocks.select(*keys, (F.col(c) - threshold).alias("_v"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("_at"),
                          F.col("_block").alias("_of")) for c in ("_high", "_low")]
    below = run.orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = lows.unionByName(aims[0]).unionByName(aims[1]).withColumn("_to", F.last("_at", True).over(below))
    reach = met.filter("_kind = 0").groupBy(*keys, F.col("_of").alias("_block")).agg(
        F.min("_to").alias("_first"), F.max("_to").alias("_most"), F.count("_to").alias("_found"))
    ranged = match(reach.filter("_found > 0"), blocks.select(*block, "_last_k"), block)
    pairs = ranged.select(*block, F.explode(F.sequence("_first", F.when(F.col("_found") == 2, F.col("_most")).otherwise(F.col("_last_k")))).alias("_k"))
    named = blocks.select(*keys, "_k", F.col("_block").alias("_target"), F.col("_low"), F.col("_above"))
    pairs = match(pairs, named, [*keys, "_k"]).drop("_k").checkpoint()

    aim = F.col("_m") - threshold
    asking = match(rows.select(*block, "_n", "_m"), pairs, block).filter(
        (aim > F.col("_low")) & (F.col("_above").isNull() | (aim <= F.col("_above")))).select(
        *block, "_target", aim.alias("_v"), F.lit(0).alias("_kind"), "_n", F.lit(None).cast("long").alias("_hit"))
    told = match(rows.select(*keys, F.col("_block").alias("_target"), "_n", "_m"), pairs.select(*block, "_target"), [*keys, "_target"]).select(
        *block, "_target", F.col("_m").alias("_v"), F.lit(1).alias("_kind"), "_n", F.col("_n").alias("_hit"))
    under = Window.partitionBy(*block, "_target").orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    next_of = asking.unionByName(told).withColumn("_next", F.last("_hit", True).over(under)).filter("_kind = 0").select(
        *block, "_n", "_next", "_target")
    linked = match(rows.select(*block, "_n"), next_of, [*block, "_n"], "left")

    # many blocks a call: most hold few records, and a call costs more than they do
    buckets = 1 + rows.count() // RECORDS_A_CALL
    paths = linked.groupBy(F.pmod(F.xxhash64(*block), F.lit(buckets)).alias("_bucket")).applyInPandas(
        lambda part: _shortened(part, block, patience),
        T.StructType([*(linked.schema[c] for c in [*block, "_n"]), T.StructField("_to", T.LongType()), T.StructField("_to_block", T.LongType())])).checkpoint()
    starts = rows.groupBy(*keys).agg(F.min(F.struct("_n", "_block")).alias("_s")).select(*keys, F.col("_s._block").alias("_block"), F.col("_s._n").alias("_n"))
    at_start = match(paths, starts, [*block, "_n"])
    if at_start.filter("_to_block IS NOT NULL").isEmpty():
        ends = at_start
    else:
        entries = paths.filter("_to_block IS NOT NULL").select(*keys, F.col("_to_block").alias("_block"), F.col("_to").alias("_n")).unionByName(
            starts.select(*block, "_n")).distinct()
        jumps = match(paths, entries, [*block, "_n"]).checkpoint()
        while not match(jumps, starts, [*block, "_n"]).filter("_to_block IS NOT NULL").isEmpty():
            further = jumps.select(*keys, F.col("_block").alias("_to_block"), F.col("_n").alias("_to"), F.col("_to").alias("_then"), F.col("_to_block").alias("_then_block"))
            moving = match(jumps.filter("_to_block IS NOT NULL"), further, [*keys, "_to_block", "_to"]).select(
                *block, "_n", F.col("_then").alias("_to"), F.col("_then_block").alias("_to_block"))
            jumps = moving.unionByName(jumps.filter("_to_block IS NULL")).checkpoint()
        ends = match(jumps, starts, [*block, "_n"])
    last = match(rows, ends.select(*keys, F.col("_to").alias("_n")), [*keys, "_n"])
    # one row per run: what stopped it is the next improvement too far away, or too many misses at its end
    stop = match(last, linked.select(*block, "_n", "_next"), [*block, "_n"], "left")
    far = F.coalesce(F.col("_next") - F.col("_n") > patience, F.col("evaluations") - F.col("_n") >= patience)
    return stop.select(*keys, "evaluations", "last_step", F.when(far, F.col("_n") + patience).alias("_stop_n"), F.col("_m").alias("_b"), F.col("_n").alias("_last_n"))


def _shortened(part: pd.DataFrame, block: list[str], patience: int) -> pd.DataFrame:
    """Each record with the end of its path in its block, or the record of another block that it leaves for; ``part`` holds whole blocks."""
    part = part.assign(_g=part.groupby(block, dropna=False, sort=False).ngroup()).sort_values(["_g", "_n"], ignore_index=True)
    n, own = part["_n"].to_numpy(np.int64), part["_block"].to_numpy(np.int64)
    # places of records as numbers that ascend over all blocks of the part
    base = part["_g"].to_numpy(np.int64) * (n.max() - n.min() + 1) - n.min()
    following, target = part["_next"].fillna(-1).to_numpy(np.int64), part["_target"].fillna(-1).to_numpy(np.int64)
    goes = part["_next"].notna().to_numpy() & (following - n <= patience)
    inside = goes & (target == own)
    to = np.where(inside, np.searchsorted(base + n, base + np.where(inside, following, n)), np.arange(len(n)))
    while True:
        further = to[to]
        if (further == to).all():
            break
        to = further
    leaves = goes[to]
    made = part[[*block, "_n"]].copy()
    made["_to"] = np.where(leaves, following[to], n[to])
    made["_to_block"] = pd.array(np.where(leaves, target[to], 0), dtype="Int64")
    made.loc[~leaves, "_to_block"] = pd.NA
    return made


# -- trials --------------------------------------------------------------------------


def best_trial(trials: DataFrame, keys: list[str], metric: str = "metric", mode: str = "min",
               status: str = "COMPLETED") -> DataFrame:
    """Best completed trial per study; the lowest trial id wins a tie."""
    signed = F.col(metric) if mode == "min" else -F.col(metric)
    ok = trials.filter((F.col("status") == status) & F.col(metric).isNotNull())
    pick = F.min_by(F.struct("trial_id", metric), F.struct(signed.alias("m"), F.col("trial_id")))
    return ok.groupBy(*keys).agg(pick.alias("_t")).select(*keys, "_t.*")


def sample_search_space(trials: DataFrame, space: dict[str, tuple], seed: int = 42, key: str = "trial_id") -> DataFrame:
    """One draw per trial from ``("choice", [..])``, ``("uniform", a, b)`` and ``("loguniform", a, b)`` entries.

    Each draw is a hash of (seed, trial, name), so it does not depend on the partitioning.
    """
    def unit(name: str) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(name)))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2 ** 32)

    columns = []
    for name, (kind, *args) in space.items():
        u = unit(name)
        if kind == "choice":
            options = F.array(*[F.lit(o) for o in args[0]])
            value = F.element_at(options, (F.floor(u * len(args[0])) + 1).cast("int"))
        elif kind == "uniform":
            value = args[0] + u * (args[1] - args[0])
        elif kind == "loguniform":
            value = F.exp(F.log(F.lit(float(args[0]))) + u * F.log(F.lit(args[1] / args[0])))
        else:
            raise ValueError(f"unknown distribution: {kind}")
        columns.append(value.alias(name))
    return trials.select(key, *columns)
