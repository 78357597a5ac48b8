"""The job master: three left joins on one key, coverage and availability flags, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import coverage_ratio, flag
from . import clean, summaries


def job_master(job: DataFrame, task: DataFrame, instance: DataFrame, sensor: DataFrame, group: DataFrame, spec: DataFrame) -> DataFrame:
    """One row per job. All right sides are unique by construction, so the row count is that of ``job``."""
    base = job.select("job_name", "user", F.col("status").alias("job_status"), F.col("start_time").alias("job_start_time"), F.col("end_time").alias("job_end_time"))
    out = base
    for side in (summaries.task_summary(task), summaries.instance_rollup(instance, group, spec), summaries.sensor_summary(sensor)):
        out = out.join(side, "job_name", "left")
    zero = F.lit(0)
    return out.withColumns(
        {
            "tagged_instance_count": F.coalesce("tagged_instance_count", zero),
            "distinct_workload_tags": F.coalesce("distinct_workload_tags", zero),
            "machine_spec_coverage": F.coalesce("machine_spec_coverage", F.lit(0.0)),
            "instances_with_machine_reference": F.coalesce("instances_with_machine_reference", zero),
            "telemetry_coverage": coverage_ratio(F.col("telemetry_instance_count"), F.col("instance_count")),
            "has_telemetry": flag(F.col("telemetry_instance_count")),
            "has_gpu_request": flag(F.col("plan_gpu_mean")),
            "has_execution_timing": flag(F.col("executable_instance_count")),
        }
    )


def from_raw(tables: dict[str, DataFrame], keys: dict[str, list[str]], ties: dict[str, list[str]]) -> DataFrame:
    """The job master of raw tables: cleaned, deduplicated, rolled up, joined."""
    instance_keys = keys["instance"]
    job = clean.dedup_latest(clean.with_keys(tables["job"], keys["job"]), keys["job"], ties["job"])
    task = clean.dedup_latest(clean.with_keys(clean.clean_tasks(tables["task"]), keys["task"]), keys["task"], ties["task"])
    instance = clean.instance_rows(clean.clean_instances(tables["instance"]), instance_keys)
    sensor = clean.sensor_rows(clean.clean_sensors(tables["sensor"]), keys["sensor"])
    return job_master(job, task, instance, sensor, clean.group_rows(tables["group_tag"]), clean.spec_rows(tables["machine_spec"]))


def validate(master: DataFrame) -> DataFrame:
    """``master``, or an error if a job occurs twice or a runtime is negative. One pass over the data."""
    hours = [c for c in master.columns if "runtime" in c]
    found = master.agg(F.count("*").alias("rows"), F.count_distinct("job_name").alias("jobs"), *[F.count_if(F.col(c) < 0).alias(c) for c in hours]).first()
    if found.rows != found.jobs:
        raise ValueError(f"{found.rows - found.jobs} rows repeat a job_name or have none")
    if bad := {c: found[c] for c in hours if found[c]}:
        raise ValueError(f"negative runtimes: {bad}")
    return master
