"""One row per job from every layer. Each layer is aggregated before it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exact_mean, safe_ratio, span

STATUSES = ["Terminated", "Failed", "Running", "Waiting"]


def task_summary(tasks: DataFrame) -> DataFrame:
    """19 aggregates of a job's tasks. Runtime counts where both times are known and in order. Jobs with equal plans have
    equal means to the last bit."""
    hours = span(F.col("start_time"), F.col("end_time"), 3600.0)
    return tasks.groupBy("job_name").agg(
        F.count("*").alias("task_count"),
        F.count("task_name").alias("distinct_task_count"),  # each task is there once
        *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_task_count") for s in STATUSES],
        F.sum("inst_num").alias("planned_instances"),
        *[f(F.col(c)).alias(f"{c}_{n}") for c in ("plan_cpu", "plan_mem", "plan_gpu") for n, f in (("mean", exact_mean), ("max", F.max))],
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in ("plan_cpu", "plan_mem", "plan_gpu")],
        F.count_distinct("gpu_type").alias("distinct_gpu_types"),
        F.avg(hours).alias("task_runtime_hours_mean"),
        F.max(hours).alias("task_runtime_hours_max"),
    )


def instance_summary(instances: DataFrame) -> DataFrame:
    """7 aggregates of a job's instances; the sum of hours is 0 where no instance has valid times."""
    hours = span(F.col("start_time"), F.col("end_time"), 3600.0)
    return instances.groupBy("job_name").agg(
        F.count("*").alias("instance_count"),
        F.count(hours).alias("executable_instance_count"),
        F.coalesce(F.sum(hours), F.lit(0.0)).alias("instance_runtime_hours_sum"),
        F.avg(hours).alias("instance_runtime_hours_mean"),
        F.max(hours).alias("instance_runtime_hours_max"),
        F.count_distinct("machine").alias("machine_count"),
        F.count_distinct("worker_name").alias("worker_count"),
    )


def sensor_summary(sensors: DataFrame) -> DataFrame:
    """16 aggregates of a job's sensor keys; means of usage weigh every record, means of memory every key."""
    return sensors.groupBy("job_name").agg(
        F.count("*").alias("telemetry_instance_count"),
        F.sum("sensor_rows").alias("sensor_record_count"),
        safe_ratio(F.sum("cpu_sum"), F.sum("cpu_count")).alias("cpu_usage_mean"),
        safe_ratio(F.sum("util_sum"), F.sum("util_count")).alias("gpu_utilization_mean"),
        F.max("util_max").alias("gpu_utilization_max"),
        F.avg("avg_mem").alias("avg_mem_mean"),
        F.max("max_mem").alias("max_mem_max"),
        F.avg("avg_gpu_mem").alias("avg_gpu_mem_mean"),
        F.max("max_gpu_mem").alias("max_gpu_mem_max"),
        F.sum("read_sum").alias("total_read"),
        F.sum("write_sum").alias("total_write"),
        F.sum("read_ops").alias("total_read_count"),
        F.sum("write_ops").alias("total_write_count"),
        F.sum("util_outliers").alias("gpu_util_outlier_count"),
        F.count_distinct("gpu_name").alias("distinct_gpu_names"),
        F.max("gpu_name").alias("gpu_name"),
    )


def instance_rollup(instances: DataFrame, groups: DataFrame, spec: DataFrame) -> DataFrame:
    """``instance_summary``, ``group_summary`` and ``spec_summary`` in one pass over the instances. Each group and machine
    is there once, so the joins keep the rows. Instances without a machine are dealt over keys that no machine has."""
    none = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("job_name", "inst_id"), F.lit(256)).cast("string"))
    tags = groups.select("inst_id", "workload")
    known = spec.select(F.col("machine").alias("__machine"), F.lit(1.0).alias("__hit"))
    rows = instances.join(tags, "inst_id", "left").withColumn("__machine", F.coalesce("machine", none)).join(known, "__machine", "left")
    hours = span(F.col("start_time"), F.col("end_time"), 3600.0)
    return rows.groupBy("job_name").agg(
        F.count("*").alias("instance_count"),
        F.count(hours).alias("executable_instance_count"),
        F.coalesce(F.sum(hours), F.lit(0.0)).alias("instance_runtime_hours_sum"),
        F.avg(hours).alias("instance_runtime_hours_mean"),
        F.max(hours).alias("instance_runtime_hours_max"),
        F.count_distinct("machine").alias("machine_count"),
        F.count_distinct("worker_name").alias("worker_count"),
        F.count_distinct(F.when(F.col("workload").isNotNull(), F.col("inst_id"))).alias("tagged_instance_count"),
        F.count_distinct("workload").alias("distinct_workload_tags"),
        F.avg(F.coalesce("__hit", F.lit(0.0))).alias("machine_spec_coverage"),
        F.count("*").alias("instances_with_machine_reference"),
    )


def group_summary(instances: DataFrame, groups: DataFrame) -> DataFrame:
    """Instances of a job whose group has a workload tag, and its different tags."""
    joined = instances.select("job_name", "inst_id").join(groups.select("inst_id", "workload"), "inst_id", "left")
    tagged = F.when(F.col("workload").isNotNull(), F.col("inst_id"))
    return joined.groupBy("job_name").agg(F.count_distinct(tagged).alias("tagged_instance_count"), F.count_distinct("workload").alias("distinct_workload_tags"))


def spec_summary(instances: DataFrame, spec: DataFrame) -> DataFrame:
    """Share of a job's instances whose machine has a specification. ``spec`` has each machine once."""
    joined = instances.select("job_name", "machine").join(spec.select("machine", F.lit(1.0).alias("hit")), "machine", "left")
    return joined.groupBy("job_name").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("machine_spec_coverage"), F.count("*").alias("instances_with_machine_reference"))
