"""The trace's layers played by the star-schema tables, as DataFrames and as SQL of the same content.

job = customer, task = orders, instance = lineitem of a task, sensor = events, group_tag = part, machine_spec = two
thirds of supplier, machine_metric = most of lineitem. Negative plans, times out of order, values over 100 and missing machines exercise the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, features, master, prepare

KEYS = {"job": ["job_name"], "task": ["job_name", "task_name"], "instance": ["job_name", "task_name", "inst_id"], "sensor": ["job_name", "task_name", "inst_id"]}
SHIFT = 1e-7
TIES = {"job": ["job_name"], "task": ["task_name"]}


def _day(c: str):
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")) * F.lit(86400.0)


def tables(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> dict[str, DataFrame]:
    """The raw layers; tasks and instances of ``orders`` only, if they are given."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = lambda c: F.col(c).cast("string")
    number = lambda c: F.expr(c).cast("double")
    start = F.col("c_nationkey") * F.lit(3600.0)
    job = read("customer").select(text("c_custkey").alias("job_name"), text("c_nationkey").alias("user"), F.col("c_mktsegment").alias("status"), start.alias("start_time"), (start + F.floor("c_acctbal")).alias("end_time"))
    orders = read("orders") if orders is None else orders
    status = F.when(F.col("o_orderstatus") == "F", "Terminated").when(F.col("o_orderstatus") == "O", "Running").otherwise("Failed")
    task = orders.select(text("o_custkey").alias("job_name"), text("o_orderkey").alias("task_name"), number("o_orderkey % 6 - 1").alias("inst_num"), status.alias("status"), _day("o_orderdate").alias("start_time"), (_day("o_orderdate") + F.floor("o_totalprice") - 20000).alias("end_time"), (F.col("o_totalprice") / 100).alias("plan_cpu"), number("o_orderkey % 64").alias("plan_mem"), number("(o_orderkey % 5 - 1) * 25").alias("plan_gpu"), F.col("o_orderpriority").alias("gpu_type"))
    line = read("lineitem").join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    instance = line.select(text("o_custkey").alias("job_name"), text("l_orderkey").alias("task_name"), text("l_partkey").alias("inst_id"), F.col("l_linestatus").alias("status"), _day("o_orderdate").alias("start_time"), _day("l_shipdate").alias("end_time"), text("l_suppkey").alias("machine"), text("l_linenumber").alias("worker_name"))
    sensor = read("events").select(text("user_id").alias("job_name"), F.expr("cast(event_id % 7 as string)").alias("task_name"), F.expr("cast(event_id % 3 as string)").alias("inst_id"), F.expr("case when event_id % 13 > 0 then cast(event_id % 4 as string) end").alias("worker_name"), F.col("event_type").alias("gpu_name"), (F.col("value") * 2 - 20).alias("cpu_usage"), F.col("value").alias("gpu_wrk_util"), (F.col("value") / 10).alias("avg_mem"), (F.col("value") / 5).alias("max_mem"), number("event_id % 32").alias("avg_gpu_wrk_mem"), number("event_id % 48").alias("max_gpu_wrk_mem"), number("event_id % 1000").alias("read"), number("event_id % 500").alias("write"), number("event_id % 10").alias("read_count"), number("event_id % 5").alias("write_count"))
    group = read("part").select(text("p_partkey").alias("inst_id"), F.col("p_brand").alias("user"), F.when(F.expr("p_partkey % 4 = 0"), "unknown").otherwise(F.col("p_type")).alias("workload"))
    spec = read("supplier").filter("s_suppkey % 3 <> 0").select(text("s_suppkey").alias("machine"), F.col("s_acctbal").alias("cap_cpu"))
    metric = line.filter("l_linenumber <> 3").select(text("l_linenumber").alias("worker_name"), text("l_suppkey").alias("machine"), F.when(F.expr("l_orderkey % 7 > 0"), _day("o_orderdate")).alias("start_time"), (_day("l_shipdate") - 30 * 86400).alias("end_time"))
    return {"machine_metric": metric, "job": job, "task": task, "instance": instance, "sensor": sensor, "group_tag": group, "machine_spec": spec}


def cleaned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = tables(spark, sf_dir)
    return {
        "job": clean.dedup_latest(t["job"], KEYS["job"], TIES["job"]),
        "task": clean.dedup_latest(clean.clean_tasks(t["task"]), KEYS["task"], TIES["task"]),
        "instance": clean.instance_rows(clean.clean_instances(t["instance"]), KEYS["instance"]),
        "sensor": clean.sensor_rows(clean.clean_sensors(t["sensor"]), KEYS["sensor"]),
        "group_tag": clean.group_rows(t["group_tag"]),
        "machine_spec": clean.spec_rows(t["machine_spec"]),
    }


def job_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.from_raw(tables(spark, sf_dir), KEYS, TIES)


def job_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.engineer(job_master(spark, sf_dir))


def complete_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``job_features`` that are complete cases. A complete case has telemetry, so jobs without a sensor key are
    dropped before their tasks and instances are joined and rolled up; every row that stays is the same."""
    seen = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id is not null and event_id is not null").select(F.col("user_id").alias("__job")).distinct()
    t = tables(spark, sf_dir, spark.read.parquet(f"{sf_dir}/orders.parquet").join(seen, F.col("o_custkey") == F.col("__job"), "left_semi"))
    t["job"] = t["job"].join(seen.select(F.col("__job").cast("string").alias("job_name")), "job_name", "left_semi")
    return prepare.complete_cases(features.engineer(master.from_raw(t, KEYS, TIES)))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show; a tiny shift first, as engines differ on exact halves."""
    return df.withColumns({c: F.round(F.col(c) + SHIFT, digits) for c, t in df.dtypes if t == "double"}) if any(t == "double" for _, t in df.dtypes) else df


_H = "CASE WHEN end_time >= start_time THEN (end_time - start_time) / 3600.0 END"
_MEANS = ", ".join(f"avg({c}) AS {c}_mean, max({c}) AS {c}_max" for c in ("plan_cpu", "plan_mem", "plan_gpu"))
_NULLS = ", ".join(f"CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS {c}_missing" for c in ("plan_cpu", "plan_mem", "plan_gpu"))
_STATES = ", ".join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS {s.lower()}_task_count" for s in ("Terminated", "Failed", "Running", "Waiting"))
_D = "CAST(datediff('day', DATE '1970-01-01', CAST({} AS DATE)) AS DOUBLE) * 86400.0"
_NN = lambda c: f"CASE WHEN {c} >= 0 THEN {c} END AS {c}"
_QUANTITIES = ", ".join(_NN(c) for c in ("cpu_usage", "avg_mem", "max_mem", "avg_gpu_wrk_mem", "max_gpu_wrk_mem", "read", "write", "read_count", "write_count"))

#: Common table expressions: raw layers, cleaned layers, summaries, master, features, complete cases.
CTES = f"""WITH job AS (SELECT CAST(c_custkey AS VARCHAR) AS job_name, CAST(c_nationkey AS VARCHAR) AS "user", c_mktsegment AS status,
  c_nationkey * CAST(3600 AS DOUBLE) AS start_time, c_nationkey * CAST(3600 AS DOUBLE) + floor(c_acctbal) AS end_time FROM customer),
task AS (SELECT CAST(o_custkey AS VARCHAR) AS job_name, CAST(o_orderkey AS VARCHAR) AS task_name, CAST(o_orderkey % 6 - 1 AS DOUBLE) AS inst_num,
  CASE WHEN o_orderstatus = 'F' THEN 'Terminated' WHEN o_orderstatus = 'O' THEN 'Running' ELSE 'Failed' END AS status,
  {_D.format("o_orderdate")} AS start_time, {_D.format("o_orderdate")} + floor(o_totalprice) - 20000 AS end_time, o_totalprice / 100 AS plan_cpu,
  CAST(o_orderkey % 64 AS DOUBLE) AS plan_mem, CAST((o_orderkey % 5 - 1) * 25 AS DOUBLE) AS plan_gpu, o_orderpriority AS gpu_type FROM orders),
instance AS (SELECT CAST(o_custkey AS VARCHAR) AS job_name, CAST(l_orderkey AS VARCHAR) AS task_name, CAST(l_partkey AS VARCHAR) AS inst_id, l_linestatus AS status,
  {_D.format("o_orderdate")} AS start_time, {_D.format("l_shipdate")} AS end_time, CAST(l_suppkey AS VARCHAR) AS machine, CAST(l_linenumber AS VARCHAR) AS worker_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sensor AS (SELECT CAST(user_id AS VARCHAR) AS job_name, CAST(event_id % 7 AS VARCHAR) AS task_name, CAST(event_id % 3 AS VARCHAR) AS inst_id, CASE WHEN event_id % 13 > 0 THEN CAST(event_id % 4 AS VARCHAR) END AS worker_name, event_type AS gpu_name,
  value * 2 - 20 AS cpu_usage, value AS gpu_wrk_util, value / 10 AS avg_mem, value / 5 AS max_mem, CAST(event_id % 32 AS DOUBLE) AS avg_gpu_wrk_mem,
  CAST(event_id % 48 AS DOUBLE) AS max_gpu_wrk_mem, CAST(event_id % 1000 AS DOUBLE) AS read, CAST(event_id % 500 AS DOUBLE) AS write,
  CAST(event_id % 10 AS DOUBLE) AS read_count, CAST(event_id % 5 AS DOUBLE) AS write_count FROM events),
metric AS (SELECT CAST(l_linenumber AS VARCHAR) AS worker_name, CAST(l_suppkey AS VARCHAR) AS machine, CASE WHEN l_orderkey % 7 > 0 THEN {_D.format("o_orderdate")} END AS start_time,
  {_D.format("l_shipdate")} - 30 * 86400 AS end_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 3),
grp AS (SELECT CAST(p_partkey AS VARCHAR) AS inst_id, p_brand AS "user", CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE p_type END AS workload FROM part),
spec AS (SELECT CAST(s_suppkey AS VARCHAR) AS machine, s_acctbal AS cap_cpu FROM supplier WHERE s_suppkey % 3 <> 0),
task_c AS (SELECT job_name, task_name, CASE WHEN inst_num >= 0 THEN inst_num END AS inst_num, status, start_time, end_time, plan_cpu, plan_mem,
  CASE WHEN plan_gpu >= 0 THEN plan_gpu END AS plan_gpu, gpu_type FROM (SELECT *, row_number() OVER (PARTITION BY job_name, task_name
  ORDER BY coalesce(end_time, start_time, -1) DESC, task_name DESC) AS rn FROM task) WHERE rn = 1),
inst_c AS (SELECT job_name, task_name, inst_id, CAST(count(*) AS BIGINT) AS instance_rows, min(start_time) AS start_time, max(end_time) AS end_time,
  coalesce(sum(CASE WHEN end_time >= start_time THEN end_time - start_time END), 0.0) AS runtime_seconds, max(machine) AS machine, max(worker_name) AS worker_name
  FROM instance GROUP BY job_name, task_name, inst_id),
sens_r AS (SELECT job_name, task_name, inst_id, gpu_name, {_QUANTITIES}, CASE WHEN gpu_wrk_util BETWEEN 0 AND 100 THEN gpu_wrk_util END AS gpu_wrk_util,
  CASE WHEN gpu_wrk_util < 0 OR gpu_wrk_util > 100 THEN 1 ELSE 0 END AS util_outlier FROM sensor),
sens_c AS (SELECT job_name, task_name, inst_id, CAST(count(*) AS BIGINT) AS sensor_rows, sum(cpu_usage) AS cpu_sum, CAST(count(cpu_usage) AS BIGINT) AS cpu_count,
  sum(gpu_wrk_util) AS util_sum, CAST(count(gpu_wrk_util) AS BIGINT) AS util_count, max(gpu_wrk_util) AS util_max, avg(avg_mem) AS avg_mem, max(max_mem) AS max_mem,
  avg(avg_gpu_wrk_mem) AS avg_gpu_mem, max(max_gpu_wrk_mem) AS max_gpu_mem, coalesce(sum(read), 0.0) AS read_sum, coalesce(sum(write), 0.0) AS write_sum,
  coalesce(sum(read_count), 0.0) AS read_ops, coalesce(sum(write_count), 0.0) AS write_ops, CAST(sum(util_outlier) AS BIGINT) AS util_outliers, max(gpu_name) AS gpu_name
  FROM sens_r GROUP BY job_name, task_name, inst_id),
task_s AS (SELECT job_name, CAST(count(*) AS BIGINT) AS task_count, CAST(count(DISTINCT task_name) AS BIGINT) AS distinct_task_count, {_STATES}, sum(inst_num) AS planned_instances,
  {_MEANS}, {_NULLS}, CAST(count(DISTINCT gpu_type) AS BIGINT) AS distinct_gpu_types, avg({_H}) AS task_runtime_hours_mean, max({_H}) AS task_runtime_hours_max FROM task_c GROUP BY job_name),
inst_s AS (SELECT job_name, CAST(count(*) AS BIGINT) AS instance_count, CAST(count({_H}) AS BIGINT) AS executable_instance_count, coalesce(sum({_H}), 0.0) AS instance_runtime_hours_sum,
  avg({_H}) AS instance_runtime_hours_mean, max({_H}) AS instance_runtime_hours_max, CAST(count(DISTINCT machine) AS BIGINT) AS machine_count,
  CAST(count(DISTINCT worker_name) AS BIGINT) AS worker_count FROM inst_c GROUP BY job_name),
sens_s AS (SELECT job_name, CAST(count(*) AS BIGINT) AS telemetry_instance_count, CAST(sum(sensor_rows) AS BIGINT) AS sensor_record_count, sum(cpu_sum) / nullif(sum(cpu_count), 0) AS cpu_usage_mean,
  sum(util_sum) / nullif(sum(util_count), 0) AS gpu_utilization_mean, max(util_max) AS gpu_utilization_max, avg(avg_mem) AS avg_mem_mean, max(max_mem) AS max_mem_max,
  avg(avg_gpu_mem) AS avg_gpu_mem_mean, max(max_gpu_mem) AS max_gpu_mem_max, sum(read_sum) AS total_read, sum(write_sum) AS total_write, sum(read_ops) AS total_read_count,
  sum(write_ops) AS total_write_count, CAST(sum(util_outliers) AS BIGINT) AS gpu_util_outlier_count, CAST(count(DISTINCT gpu_name) AS BIGINT) AS distinct_gpu_names,
  max(gpu_name) AS gpu_name FROM sens_c GROUP BY job_name),
grp_s AS (SELECT i.job_name, CAST(count(DISTINCT CASE WHEN g.workload IS NOT NULL THEN i.inst_id END) AS BIGINT) AS tagged_instance_count,
  CAST(count(DISTINCT g.workload) AS BIGINT) AS distinct_workload_tags FROM inst_c i LEFT JOIN grp g ON i.inst_id = g.inst_id GROUP BY i.job_name),
spec_s AS (SELECT i.job_name, avg(CASE WHEN s.machine IS NULL THEN 0.0 ELSE 1.0 END) AS machine_spec_coverage, CAST(count(*) AS BIGINT) AS instances_with_machine_reference
  FROM inst_c i LEFT JOIN spec s ON i.machine = s.machine GROUP BY i.job_name),
master AS (SELECT j.job_name, j."user", j.status AS job_status, j.start_time AS job_start_time, j.end_time AS job_end_time, t.* EXCLUDE (job_name), i.* EXCLUDE (job_name), s.* EXCLUDE (job_name),
  coalesce(g.tagged_instance_count, 0) AS tagged_instance_count, coalesce(g.distinct_workload_tags, 0) AS distinct_workload_tags, coalesce(p.machine_spec_coverage, 0.0) AS machine_spec_coverage,
  coalesce(p.instances_with_machine_reference, 0) AS instances_with_machine_reference,
  CASE WHEN instance_count > 0 AND telemetry_instance_count IS NOT NULL THEN least(1.0, telemetry_instance_count / CAST(instance_count AS DOUBLE)) ELSE 0.0 END AS telemetry_coverage,
  CASE WHEN coalesce(telemetry_instance_count, 0) > 0 THEN 1 ELSE 0 END AS has_telemetry, CASE WHEN coalesce(plan_gpu_mean, 0) > 0 THEN 1 ELSE 0 END AS has_gpu_request,
  CASE WHEN coalesce(executable_instance_count, 0) > 0 THEN 1 ELSE 0 END AS has_execution_timing
  FROM job j LEFT JOIN task_s t ON j.job_name = t.job_name LEFT JOIN inst_s i ON j.job_name = i.job_name LEFT JOIN sens_s s ON j.job_name = s.job_name
  LEFT JOIN grp_s g ON j.job_name = g.job_name LEFT JOIN spec_s p ON j.job_name = p.job_name),
feat AS (SELECT * EXCLUDE (machine_count), CAST(machine_count AS DOUBLE) AS machine_count, CASE WHEN plan_gpu_mean >= 0 THEN ln(1 + plan_gpu_mean) END AS gpu_demand_scale,
  CASE WHEN has_telemetry = 1 AND gpu_utilization_mean BETWEEN 0 AND 100 THEN CASE WHEN gpu_utilization_mean > 0 THEN 1 ELSE 0 END END AS gpu_active_flag,
  CASE WHEN has_telemetry = 1 AND gpu_utilization_mean BETWEEN 0 AND 100 THEN 1 - gpu_utilization_mean / 100 END AS gpu_idle_ratio,
  CASE WHEN has_telemetry = 1 AND gpu_utilization_mean BETWEEN 0 AND 100 THEN ln(1 + gpu_utilization_mean) END AS gpu_utilization_intensity,
  CASE WHEN avg_gpu_mem_mean >= 0 THEN ln(1 + avg_gpu_mem_mean) END AS gpu_memory_intensity, CASE WHEN avg_mem_mean >= 0 THEN ln(1 + avg_mem_mean) END AS memory_intensity,
  CASE WHEN cpu_usage_mean >= 0 THEN ln(1 + cpu_usage_mean) END AS cpu_usage_transformed, (gpu_utilization_mean / 100) / nullif(plan_gpu_mean / 100, 0) AS resource_efficiency_score,
  cpu_usage_mean / nullif(plan_cpu_mean, 0) - (gpu_utilization_mean / 100) / nullif(plan_gpu_mean / 100, 0) AS cpu_gpu_imbalance,
  CASE WHEN instance_runtime_hours_sum > 0 AND total_read + total_write >= 0 THEN ln(1 + greatest((total_read + total_write) / nullif(instance_runtime_hours_sum * 3600, 0), 0)) END AS io_intensity,
  CASE WHEN instance_runtime_hours_sum >= 0 THEN ln(1 + instance_runtime_hours_sum) END AS runtime_log, CASE WHEN task_count >= 0 THEN ln(1 + task_count) END AS task_fanout FROM master),
core AS (SELECT * FROM feat WHERE {" AND ".join(f"{c} IS NOT NULL" for c in features.CORE)})
"""

