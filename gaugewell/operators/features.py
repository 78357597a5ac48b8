"""Behavioural features of jobs, their audit, eligibility and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, safe_log1p, safe_ratio
from .profile import bias_corrected_skewness

CORE = (
    "plan_cpu_mean plan_mem_mean gpu_demand_scale gpu_utilization_intensity gpu_memory_intensity memory_intensity "
    "cpu_usage_transformed resource_efficiency_score cpu_gpu_imbalance io_intensity runtime_log task_fanout"
).split()
ENGINEERED = [*CORE[2:], "gpu_active_flag", "gpu_idle_ratio"]
NON_NEGATIVE = ["gpu_demand_scale", "gpu_utilization_intensity", "gpu_memory_intensity", "memory_intensity", "io_intensity", "runtime_log"]


def engineer(master: DataFrame) -> DataFrame:
    """Twelve features beside the master's columns; missing input makes a missing feature, never 0."""
    c = F.col
    util = c("gpu_utilization_mean")
    seen = (c("has_telemetry") == 1) & util.between(0, 100)
    efficiency = safe_ratio(util / 100.0, c("plan_gpu_mean") / 100.0)
    moved = c("total_read") + c("total_write")
    rate = F.try_divide(moved, c("instance_runtime_hours_sum") * 3600.0)
    return master.withColumns(
        {
            "gpu_demand_scale": safe_log1p(c("plan_gpu_mean")),
            "gpu_active_flag": F.when(seen, (util > 0).cast("int")),
            "gpu_idle_ratio": F.when(seen, 1 - util / 100.0),
            "gpu_utilization_intensity": F.when(seen, F.log1p(util)),
            "gpu_memory_intensity": safe_log1p(c("avg_gpu_mem_mean")),
            "memory_intensity": safe_log1p(c("avg_mem_mean")),
            "cpu_usage_transformed": safe_log1p(c("cpu_usage_mean")),
            "resource_efficiency_score": efficiency,
            "cpu_gpu_imbalance": safe_ratio(c("cpu_usage_mean"), c("plan_cpu_mean")) - efficiency,
            "io_intensity": F.when((c("instance_runtime_hours_sum") > 0) & (moved >= 0), F.log1p(F.greatest(rate, F.lit(0.0)))),
            "runtime_log": safe_log1p(c("instance_runtime_hours_sum")),
            "task_fanout": safe_log1p(c("task_count")),
            "machine_count": c("machine_count").cast("double"),
        }
    )


#: Features whose absence the eligibility report counts (fixed list).
REPORTED = [
    "gpu_idle_ratio", "gpu_utilization_intensity", "gpu_memory_intensity", "memory_intensity", "cpu_usage_transformed", "resource_efficiency_score",
    "cpu_gpu_imbalance", "io_intensity", "runtime_log", "task_fanout", "machine_count", "plan_cpu_mean", "plan_mem_mean", "gpu_demand_scale",
]


def eligibility(features: DataFrame) -> DataFrame:
    """One row: jobs, those with and without each availability, those that lack each of the 14 reported features."""
    flags = {"telemetry": "has_telemetry", "gpu_request": "has_gpu_request", "execution_timing": "has_execution_timing"}
    both = [(f"jobs_{word}_{name}", F.count_if(F.col(f) == v)) for name, f in flags.items() for word, v in (("with", 1), ("without", 0))]
    lacking = [(f"missing_{n}", F.count_if(F.col(n).isNull())) for n in REPORTED]
    return features.agg(F.count("*").alias("total_jobs"), *[v.alias(k) for k, v in [*both, *lacking]])


def audit(features: DataFrame, columns: list[str] = ENGINEERED) -> DataFrame:
    """A row for each feature: counts of values, missing, infinite, zero and negative ones, and its moments."""
    parts = []
    for name in columns:
        x = F.col(name).cast("double")
        parts += [
            F.struct(
                F.lit(name).alias("feature"),
                F.count(x).alias("valid_count"),
                F.count_if(x.isNull()).alias("missing_count"),
                F.count_if(F.abs(x) == float("inf")).alias("infinite_count"),
                F.count_if(x == 0).alias("zero_count"),
                F.count_if(x < 0).alias("negative_count"),
                F.round(F.avg(x), 4).alias("mean"),
                F.round(F.stddev_samp(x), 4).alias("std"),
                F.round(F.min(x), 4).alias("min"),
                F.round(F.median(x), 4).alias("median"),
                F.round(F.max(x), 4).alias("max"),
                F.round(bias_corrected_skewness(x), 3).alias("skewness"),
            )
        ]
    return features.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def violations(features: DataFrame) -> DataFrame:
    """One row with a count for each rule that features must keep."""
    checks = {f"infinite_{n}": F.abs(F.col(n)) == float("inf") for n in ENGINEERED}
    checks |= {f"negative_{n}": F.col(n) < 0 for n in NON_NEGATIVE}
    checks |= {"idle_out_of_range": ~F.col("gpu_idle_ratio").between(0, 1), "flag_not_binary": ~F.col("gpu_active_flag").isin(0, 1)}
    return features.agg(*[F.count_if(v).alias(k) for k, v in checks.items()])


def validate(features: DataFrame) -> DataFrame:
    if missing := set(ENGINEERED) - set(features.columns):
        raise ValueError(f"missing features: {sorted(missing)}")
    found = violations(features).first().asDict()
    if bad := {k: v for k, v in found.items() if v}:
        raise ValueError(f"features break rules: {bad}")
    return features
