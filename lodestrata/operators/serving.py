"""Routing, fallback, traffic split, replicas and rate limits over request rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.blocks import trailing_range

# Fixed values.
RATE_LIMIT_SECONDS = 60
REQUESTS_PER_MINUTE = 60
TOKENS_PER_MINUTE = 100_000


def route_by_rule(prompts: DataFrame, rules: list[tuple[str, str]], default: str, text: str = "text") -> DataFrame:
    """Model of the first rule whose pattern is part of the lower-cased prompt, else the default.

    Rules are configuration, so they become one CASE expression and no join.
    """
    lowered = F.lower(F.col(text))
    model: Column = F.lit(default)
    for pattern, target in reversed(rules):
        model = F.when(lowered.contains(pattern.lower()), F.lit(target)).otherwise(model)
    return prompts.withColumn("model", model)


def fallback_first_healthy(chains: DataFrame, health: DataFrame, keys: list[str] = ["chain"]) -> DataFrame:
    """First healthy model of each chain; null if none is. Unknown models count as unhealthy."""
    state = chains.join(health, "model", "left")
    up = F.coalesce("healthy", F.lit(False))
    return state.groupBy(*keys).agg(F.min_by("model", F.when(up, F.col("position"))).alias("model"))


def canary_bucket(key: Column) -> Column:
    """A stable bucket 0..99 for a request key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100


def canary_split(requests: DataFrame, percent: int, key: str = "request_id") -> DataFrame:
    """Mark the requests that go to the canary."""
    return requests.withColumn("canary", canary_bucket(F.col(key)) < percent)


def canary_counts(split: DataFrame, percent: int) -> DataFrame:
    """Planned and real request numbers; the plan rounds the canary share down."""
    return split.agg(
        F.count("*").alias("total"),
        F.floor(F.count("*") * percent / 100).cast("long").alias("planned_canary"),
        F.count_if("canary").alias("canary"),
        F.count_if(~F.col("canary")).alias("stable"),
    ).withColumn("planned_stable", F.col("total") - F.col("planned_canary"))


def desired_replicas(load: DataFrame, target: float = 70.0, low: int = 1, high: int = 10) -> DataFrame:
    """Replicas in proportion to load over target, cut down to an integer and clipped."""
    wanted = (F.col("replicas") * F.col("utilization") / target).cast("int")
    return load.withColumn("desired", F.greatest(F.lit(low), F.least(F.lit(high), wanted)))


def rate_limit_check(
    requests: DataFrame, keys: list[str], max_requests: int = REQUESTS_PER_MINUTE,
    max_tokens: int = TOKENS_PER_MINUTE, seconds: int = RATE_LIMIT_SECONDS, block_seconds: int = 3600,
) -> DataFrame:
    """Requests and tokens of the last minute at each request, and whether a limit is reached."""
    rows = trailing_range(requests, keys, "ts", seconds, {
        "requests_in_window": F.count(F.lit(1)),
        "tokens_in_window": F.sum(F.col("prompt_tokens") + F.col("completion_tokens")),
    }, block_seconds)
    return rows.withColumn(
        "limited", (F.col("requests_in_window") >= max_requests) | (F.col("tokens_in_window") >= max_tokens))


def token_count_check(replies: DataFrame, text: str, minimum: int) -> DataFrame:
    """Word count of each reply and whether it reaches the minimum."""
    from lodestrata.functions.text import whitespace_tokens

    n = F.size(whitespace_tokens(F.col(text)))
    return replies.withColumn("n_tokens", n).withColumn("enough", n >= minimum)


def chain_table(spark: SparkSession, chains: dict[str, list[str]]) -> DataFrame:
    """Configured fallback chains as rows."""
    rows = [(c, m, i) for c, models in chains.items() for i, m in enumerate(models)]
    return spark.createDataFrame(rows, "chain string, model string, position int")
