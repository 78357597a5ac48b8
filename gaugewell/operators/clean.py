"""Cleaning: latest row of each key, required keys, range rules, one row per instance or sensor key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import non_negative, outside, span, within

#: Sensor quantities that can't be negative (utilisation has its own rule), and task resources (fixed values).
SENSOR_QUANTITIES = "cpu_usage avg_mem max_mem avg_gpu_wrk_mem max_gpu_wrk_mem read write read_count write_count".split()
TASK_RESOURCES = ["inst_num", "plan_cpu", "plan_mem", "plan_gpu"]


def with_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def dedup_latest(df: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """The row of each key with the latest end (else start) time; equal ones by ``ties``, largest first, nulls last."""
    when = F.coalesce("end_time", "start_time", F.lit(-1.0))
    order = W.partitionBy(*keys).orderBy(when.desc(), *[F.desc_nulls_last(t) for t in ties])
    return df.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")


def clean_tasks(df: DataFrame) -> DataFrame:
    return df.withColumns({c: non_negative(F.col(c)) for c in TASK_RESOURCES if c in df.columns})


def clean_instances(df: DataFrame) -> DataFrame:
    return df.withColumn("runtime_seconds", span(F.col("start_time"), F.col("end_time")))


def clean_sensors(df: DataFrame) -> DataFrame:
    bad = outside(F.col("gpu_wrk_util"))
    rules = {c: non_negative(F.col(c)) for c in SENSOR_QUANTITIES if c in df.columns}
    return df.withColumns({"util_outlier": bad.cast("int"), **rules}).withColumn("gpu_wrk_util", within(F.col("gpu_wrk_util")))


def instance_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each instance key: rows, first start, last end, sum of row runtimes (0 if none is known)."""
    return with_keys(df, keys).groupBy(*keys).agg(
        F.count("*").alias("instance_rows"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.coalesce(F.sum("runtime_seconds"), F.lit(0.0)).alias("runtime_seconds"),
        F.max("machine").alias("machine"),
        F.max("worker_name").alias("worker_name"),
    )


def sensor_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each sensor key. Sums of reads and writes are 0 if none is known, by intent; means stay missing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return with_keys(df, keys).groupBy(*keys).agg(
        F.count("*").alias("sensor_rows"),
        F.sum("cpu_usage").alias("cpu_sum"),
        F.count("cpu_usage").alias("cpu_count"),
        F.sum("gpu_wrk_util").alias("util_sum"),
        F.count("gpu_wrk_util").alias("util_count"),
        F.max("gpu_wrk_util").alias("util_max"),
        F.avg("avg_mem").alias("avg_mem"),
        F.max("max_mem").alias("max_mem"),
        F.avg("avg_gpu_wrk_mem").alias("avg_gpu_mem"),
        F.max("max_gpu_wrk_mem").alias("max_gpu_mem"),
        total("read").alias("read_sum"),
        total("write").alias("write_sum"),
        total("read_count").alias("read_ops"),
        total("write_count").alias("write_ops"),
        F.sum("util_outlier").alias("util_outliers"),
        F.max("gpu_name").alias("gpu_name"),
    )


def group_rows(df: DataFrame) -> DataFrame:
    return with_keys(df, ["inst_id"]).groupBy("inst_id").agg(*[F.max(c).alias(c) for c in ("user", "gpu_type_spec", "group", "workload") if c in df.columns])


def spec_rows(df: DataFrame) -> DataFrame:
    """One row for each machine, so that joins can't multiply rows."""
    return with_keys(df, ["machine"]).groupBy("machine").agg(*[F.max(c).alias(c) for c in df.columns if c != "machine"])


def dropped_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One row: rows in, rows without a key."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.agg(F.count("*").alias("rows_in"), F.count_if(missing).alias("rows_dropped"))


def rule_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """metric, value: negative values that a rule makes null, and utilisation out of range."""
    columns = list(columns)
    one = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in columns], *([F.count_if(outside(F.col("gpu_wrk_util"))).alias("gpu_wrk_util")] if "gpu_wrk_util" in df.columns else []))
    return one.unpivot([], one.columns, "metric", "value")
