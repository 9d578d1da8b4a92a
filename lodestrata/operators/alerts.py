"""Alert rules as data, their evaluation on a time grid, and the ``for`` clause."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``signal op limit`` must hold for ``for_seconds`` without a break."""

    name: str
    signal: str
    op: str
    limit: float
    for_seconds: int
    severity: str
    component: str


# Rule name, signal, comparison, limit, seconds to hold, severity, component.
RULES = [
    Rule("InferenceHighLatency", "latency_p99_5m", ">", 2, 300, "warning", "serving"),
    Rule("InferenceCriticalLatency", "latency_p99_5m", ">", 5, 300, "critical", "serving"),
    Rule("InferenceHighErrorRate", "error_ratio_5m", ">", 0.01, 300, "warning", "serving"),
    Rule("InferenceCriticalErrorRate", "error_ratio_5m", ">", 0.05, 300, "critical", "serving"),
    Rule("InferenceServiceDown", "inference_up", "==", 0, 120, "critical", "serving"),
    Rule("ModelLoadFailure", "model_load_failures_10m", ">", 0, 60, "critical", "serving"),
    Rule("GPUHighUtilization", "gpu_utilization", ">", 0.95, 600, "warning", "gpu"),
    Rule("GPUMemoryNearCapacity", "gpu_memory_share", ">", 0.9, 300, "warning", "gpu"),
    Rule("GPUMemoryCritical", "gpu_memory_share", ">", 0.95, 120, "critical", "gpu"),
    Rule("GPUTemperatureHigh", "gpu_temperature", ">", 80, 300, "warning", "gpu"),
    Rule("TrainingJobFailed", "training_failures_5m", ">", 0, 60, "critical", "training"),
    Rule("TrainingJobStuck", "training_unchanged_1h", "==", 1, 7200, "warning", "training"),
    Rule("TrainingLossNotDecreasing", "training_loss_increase_1h", ">", 0, 7200, "warning", "training"),
    Rule("CheckpointMissing", "seconds_since_checkpoint", ">", 3600, 600, "warning", "training"),
    Rule("MLflowDown", "mlflow_up", "==", 0, 300, "critical", "mlflow"),
    Rule("KubeflowPipelinesDown", "workflow_up", "==", 0, 300, "critical", "kubeflow"),
    Rule("MilvusDown", "milvus_up", "==", 0, 300, "critical", "milvus"),
    Rule("RayClusterUnhealthy", "ray_missing_nodes", ">", 0, 600, "warning", "ray"),
    Rule("LiteLLMDown", "litellm_up", "==", 0, 300, "critical", "litellm"),
    Rule("PipelineRunFailed", "run_failures_10m", ">", 0, 60, "critical", "pipelines"),
    Rule("PipelineRunTooLong", "run_seconds", ">", 14400, 1800, "warning", "pipelines"),
    Rule("PVCNearCapacity", "volume_share", ">", 0.85, 600, "warning", "storage"),
    Rule("S3AccessErrors", "s3_errors_5m", ">", 10, 300, "warning", "storage"),
]


def rule_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.signal, r.op, float(r.limit), r.for_seconds, r.severity, r.component) for r in rules],
        "rule string, signal string, op string, limit double, for_seconds int, severity string, component string")


def holds(value: Column, op: Column, limit: Column) -> Column:
    return (
        F.when(op == ">", value > limit).when(op == "<", value < limit)
        .when(op == ">=", value >= limit).when(op == "<=", value <= limit)
        .when(op == "==", value == limit).when(op == "!=", value != limit)
    )


def true_steps(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """Grid steps on which a rule holds. ``signals(signal, series, at, value)``, ``at`` in seconds."""
    return signals.join(rules, "signal").filter(holds(F.col("value"), F.col("op"), F.col("limit")))


def alert_intervals(signals: DataFrame, rules: DataFrame, step: int) -> DataFrame:
    """Unbroken runs of true steps that last at least the rule's time.

    Signals are one row per series and grid step, so a series has a bounded number of rows
    however many events it had. A missing step breaks the run. ``fired_at`` is the first
    step at which the run had lasted long enough.
    """
    order = Window.partitionBy("rule", "series").orderBy("at")
    islands = true_steps(signals, rules).withColumn("_island", F.col("at") - F.row_number().over(order) * step)
    runs = islands.groupBy("rule", "series", "severity", "component", "for_seconds", "_island").agg(
        F.min("at").alias("started_at"), F.max("at").alias("last_true_at"))
    fired = F.col("started_at") + F.ceil(F.col("for_seconds") / step).cast("long") * step
    return (
        runs.withColumn("fired_at", fired).filter(F.col("last_true_at") >= F.col("fired_at"))
        .select("rule", "series", "severity", "component", "started_at", "fired_at", "last_true_at")
    )


def staleness(samples: DataFrame, keys: list[str], grid: DataFrame, value_ts: str = "at") -> DataFrame:
    """Seconds since the newest sample at each grid step of a series.

    ``grid(keys, at)`` names the steps; samples and steps are merged in time order, one
    pre-aggregated row per step, so the order runs over the grid and not the raw rows.
    """
    marks = samples.select(*keys, F.col(value_ts).alias("at"), F.col(value_ts).alias("_seen"), F.lit(False).alias("_g"))
    steps = grid.select(*keys, "at", F.lit(None).cast("long").alias("_seen"), F.lit(True).alias("_g"))
    merged = marks.unionByName(steps).groupBy(*keys, "at").agg(F.max("_seen").alias("_seen"), F.bool_or("_g").alias("_g"))
    order = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("value", F.col("at") - F.max("_seen").over(order)).filter("_g").select(*keys, "at", "value")
