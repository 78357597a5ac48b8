"""Every named query of the library over the star-schema tables, and the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, cluster, evaluate, features, integrity, prepare, profile, sampling, semantic, summaries
from ..operators.features import CORE
from ..streaming import events
from .catalog import ORACLES, QUERIES, query
from .trace import cleaned, job_features, job_master, rounded, tables

def _round(columns: list[str]) -> str:
    return ", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in columns)  # as trace.rounded does


# -- cleaning and integrity ----------------------------------------------------------------------------------------

_LINE = 'SELECT job_name, task_name, inst_id, start_time, end_time, machine, worker_name, row_number() OVER (PARTITION BY job_name, task_name ORDER BY coalesce(end_time, start_time, -1) DESC, CAST(inst_id AS BIGINT) DESC, CAST(worker_name AS BIGINT) DESC, CAST(machine AS BIGINT) DESC) AS rn FROM instance'


@query("dedup_latest", f"SELECT job_name, task_name, inst_id, start_time, end_time, machine, worker_name FROM ({_LINE}) WHERE rn = 1")
def _(spark, d):
    rows = tables(spark, d)["instance"].drop("status").withColumns({f"n_{c}": F.col(c).cast("long") for c in ("inst_id", "worker_name", "machine")})
    return clean.dedup_latest(rows, ["job_name", "task_name"], ["n_inst_id", "n_worker_name", "n_machine"]).drop("n_inst_id", "n_worker_name", "n_machine")


@query("task_clean", "SELECT * REPLACE (round(plan_cpu + 1e-7, 4) AS plan_cpu) FROM task_c")
def _(spark, d):
    return rounded(cleaned(spark, d)["task"])


@query("instance_rows", "SELECT * FROM inst_c")
def _(spark, d):
    return cleaned(spark, d)["instance"]


@query("sensor_rows", f"SELECT job_name, task_name, inst_id, sensor_rows, cpu_count, util_count, util_outliers, gpu_name, {_round('cpu_sum util_sum util_max avg_mem max_mem avg_gpu_mem max_gpu_mem read_sum write_sum read_ops write_ops'.split())} FROM sens_c")
def _(spark, d):
    return rounded(cleaned(spark, d)["sensor"])


@query("rule_counts", "SELECT 'cpu_usage' AS metric, CAST(count(*) FILTER (cpu_usage < 0) AS BIGINT) AS value FROM sensor UNION ALL SELECT 'gpu_wrk_util', CAST(count(*) FILTER (gpu_wrk_util < 0 OR gpu_wrk_util > 100) AS BIGINT) FROM sensor")
def _(spark, d):
    return clean.rule_counts(tables(spark, d)["sensor"], ["cpu_usage"])


@query("quality", "SELECT 'job_status' AS column_name, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (job_status IS NULL) AS BIGINT) AS null_count, CAST(count(*) FILTER (trim(coalesce(job_status, '')) = '') AS BIGINT) AS blank_count FROM master UNION ALL SELECT 'gpu_name', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (gpu_name IS NULL) AS BIGINT), CAST(count(*) FILTER (trim(coalesce(gpu_name, '')) = '') AS BIGINT) FROM master UNION ALL SELECT 'cpu_usage_mean', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (cpu_usage_mean IS NULL) AS BIGINT), CAST(NULL AS BIGINT) FROM master")
def _(spark, d):
    return profile.quality(job_master(spark, d).select("job_status", "gpu_name", "cpu_usage_mean"))


@query("status_distribution", "SELECT status, CAST(count(*) AS BIGINT) AS n FROM task GROUP BY status")
def _(spark, d):
    return profile.status_distribution(tables(spark, d)["task"])


@query("null_by_status", "SELECT status, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (inst_num IS NULL) AS BIGINT) AS null_inst_num, CAST(count(*) FILTER (plan_gpu IS NULL) AS BIGINT) AS null_plan_gpu FROM task_c GROUP BY status")
def _(spark, d):
    return profile.nulls_by_status(cleaned(spark, d)["task"], ["inst_num", "plan_gpu"])


@query("null_by_status_missing", "SELECT coalesce(gpu_name, '<MISSING>') AS status, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (cpu_usage_mean IS NULL) AS BIGINT) AS null_cpu_usage_mean FROM master GROUP BY 1")
def _(spark, d):
    return profile.nulls_by_status(job_master(spark, d).withColumnRenamed("gpu_name", "status"), ["cpu_usage_mean"], keep_missing=True)


@query("dropped_keys", "SELECT CAST(count(*) AS BIGINT) AS rows_in, CAST(count(*) FILTER (gpu_name IS NULL) AS BIGINT) AS rows_dropped FROM master")
def _(spark, d):
    return clean.dropped_keys(job_master(spark, d), ["gpu_name"])


def _cov(child: str, parent: str, keys: list[str]) -> str:
    on = " AND ".join(f"c.{k} = p.{k}" for k in keys)
    ks, null = ", ".join(keys), " OR ".join(f"c.{k} IS NULL" for k in keys)
    return f"""SELECT total_rows, matched_rows, total_rows - matched_rows AS unmatched_rows, null_key_rows, round(100.0 * matched_rows / nullif(total_rows, 0), 4) AS matched_percent,
CASE WHEN matched_rows = total_rows THEN 'OK' ELSE 'WARNING' END AS status FROM (SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(p.hit) AS BIGINT) AS matched_rows,
CAST(count(*) FILTER ({null}) AS BIGINT) AS null_key_rows FROM {child} c LEFT JOIN (SELECT DISTINCT {ks}, 1 AS hit FROM {parent}) p ON {on})"""


@query("cov_child_parent", _cov("task", "(SELECT job_name FROM job WHERE status = 'BUILDING')", ["job_name"]))
def _(spark, d):
    t = tables(spark, d)
    return integrity.coverage(t["task"], t["job"].filter("status = 'BUILDING'"), ["job_name"])


@query("cov_composite", _cov("instance", "(SELECT * FROM task WHERE status = 'Terminated')", ["job_name", "task_name"]))
def _(spark, d):
    t = tables(spark, d)
    return integrity.coverage(t["instance"], t["task"].filter("status = 'Terminated'"), ["job_name", "task_name"])


@query("cov_job_sensor", _cov("job", "sensor", ["job_name"]))
def _(spark, d):
    t = tables(spark, d)
    return integrity.coverage(t["job"], t["sensor"], ["job_name"])


@query("cov_group_tag", _cov("instance", "(SELECT * FROM grp WHERE workload <> 'unknown')", ["inst_id"]))
def _(spark, d):
    t = tables(spark, d)
    return integrity.coverage(t["instance"], t["group_tag"].filter("workload <> 'unknown'"), ["inst_id"])


@query("cov_machine_spec", _cov("instance", "spec", ["machine"]))
def _(spark, d):
    t = tables(spark, d)
    return integrity.coverage(t["instance"], t["machine_spec"], ["machine"])


@query("cov_distinct_keys", """SELECT (SELECT CAST(count(DISTINCT job_name) AS BIGINT) FROM job) AS left_keys, (SELECT CAST(count(DISTINCT job_name) AS BIGINT) FROM sensor) AS right_keys,
(SELECT CAST(count(DISTINCT job_name) AS BIGINT) FROM job WHERE job_name IN (SELECT job_name FROM sensor)) AS common_keys, (SELECT CAST(count(DISTINCT job_name) AS BIGINT) FROM job WHERE job_name NOT IN (SELECT job_name FROM sensor)) AS left_only,
(SELECT CAST(count(DISTINCT job_name) AS BIGINT) FROM sensor WHERE job_name NOT IN (SELECT job_name FROM job)) AS right_only""")
def _(spark, d):
    t = tables(spark, d)
    return integrity.distinct_coverage(t["job"], t["sensor"], ["job_name"])


@query("common_keys", "SELECT job_name FROM job INTERSECT SELECT job_name FROM sensor")
def _(spark, d):
    t = tables(spark, d)
    return integrity.common_keys(t["job"], t["sensor"], ["job_name"])


@query("key_containment", """SELECT CAST(count(*) AS BIGINT) AS shared_keys, CAST(count(*) FILTER (bad > 0) AS BIGINT) AS keys_not_contained FROM (SELECT a.job_name, count(*) FILTER (b.machine IS NULL) AS bad
FROM (SELECT DISTINCT job_name, machine FROM instance) a LEFT JOIN (SELECT DISTINCT job_name, machine FROM instance WHERE status = 'F') b ON a.job_name = b.job_name AND a.machine = b.machine
WHERE a.job_name IN (SELECT job_name FROM instance WHERE status = 'F') GROUP BY a.job_name)""")
def _(spark, d):
    i = tables(spark, d)["instance"]
    return integrity.containment(i, i.filter("status = 'F'"), ["job_name"], "machine")


@query("key_conflicts", "SELECT inst_id, CAST(count(DISTINCT job_name) AS BIGINT) AS n_values FROM instance GROUP BY inst_id HAVING count(DISTINCT job_name) > 1")
def _(spark, d):
    return integrity.conflicts(tables(spark, d)["instance"], "inst_id", "job_name")


# -- summaries, master, features -------------------------------------------------------------------------------------


_TASK_S = "job_name task_count distinct_task_count terminated_task_count failed_task_count running_task_count waiting_task_count plan_cpu_missing plan_mem_missing plan_gpu_missing distinct_gpu_types".split()
_TASK_D = "planned_instances plan_cpu_mean plan_cpu_max plan_mem_mean plan_mem_max plan_gpu_mean plan_gpu_max task_runtime_hours_mean task_runtime_hours_max".split()
_INST_S, _INST_D = "job_name instance_count executable_instance_count machine_count worker_count".split(), "instance_runtime_hours_sum instance_runtime_hours_mean instance_runtime_hours_max".split()
_SENS_S = "job_name telemetry_instance_count sensor_record_count gpu_util_outlier_count distinct_gpu_names gpu_name".split()
_SENS_D = "cpu_usage_mean gpu_utilization_mean gpu_utilization_max avg_mem_mean max_mem_max avg_gpu_mem_mean max_gpu_mem_max total_read total_write total_read_count total_write_count".split()
_REST_S = "tagged_instance_count distinct_workload_tags instances_with_machine_reference has_telemetry has_gpu_request has_execution_timing".split()
_REST_D = ["machine_spec_coverage", "telemetry_coverage"]


@query("task_summary", f"SELECT {', '.join(_TASK_S)}, {_round(_TASK_D)} FROM task_s")
def _(spark, d):
    return rounded(summaries.task_summary(cleaned(spark, d)["task"]))


@query("instance_summary", f"SELECT {', '.join(_INST_S)}, {_round(_INST_D)} FROM inst_s")
def _(spark, d):
    return rounded(summaries.instance_summary(cleaned(spark, d)["instance"]))


@query("sensor_summary", f"SELECT {', '.join(_SENS_S)}, {_round(_SENS_D)} FROM sens_s")
def _(spark, d):
    return rounded(summaries.sensor_summary(cleaned(spark, d)["sensor"]))


@query("group_tag_summary", "SELECT * FROM grp_s")
def _(spark, d):
    t = cleaned(spark, d)
    return summaries.group_summary(t["instance"], t["group_tag"])


@query("spec_coverage", "SELECT job_name, round(machine_spec_coverage + 1e-7, 4) AS machine_spec_coverage, instances_with_machine_reference FROM spec_s")
def _(spark, d):
    t = cleaned(spark, d)
    return rounded(summaries.spec_summary(t["instance"], t["machine_spec"]))


_MASTER = f'job_name, "user", job_status, job_start_time, job_end_time, {", ".join([*_TASK_S[1:], *_INST_S[1:], *_SENS_S[1:], *_REST_S])}, {_round([*_TASK_D, *_INST_D, *_SENS_D, *_REST_D])}'


@query("job_master", f"SELECT {_MASTER} FROM master")
def _(spark, d):
    return rounded(job_master(spark, d))


_FLAGS = ["has_telemetry", "has_gpu_request", "has_execution_timing"]


@query("availability_flags", "SELECT has_telemetry, has_gpu_request, has_execution_timing, CAST(count(*) AS BIGINT) AS n FROM master GROUP BY 1, 2, 3")
def _(spark, d):
    return job_master(spark, d).groupBy(*_FLAGS).agg(F.count("*").alias("n"))


_ENG = [*CORE[2:], "gpu_idle_ratio"]


@query("engineered_features", f"SELECT job_name, gpu_active_flag, machine_count, {_round(_ENG)} FROM feat")
def _(spark, d):
    return rounded(job_features(spark, d).select("job_name", "gpu_active_flag", "machine_count", *_ENG))


def _audit(c: str) -> str:
    return f"""SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS valid_count, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS missing_count, CAST(0 AS BIGINT) AS infinite_count,
CAST(count(*) FILTER ({c} = 0) AS BIGINT) AS zero_count, CAST(count(*) FILTER ({c} < 0) AS BIGINT) AS negative_count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.5), 4) AS median, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(skewness({c}), 3) AS skewness FROM feat"""


@query("feature_audit", " UNION ALL ".join(_audit(c) for c in CORE[2:] + ["gpu_idle_ratio"]))
def _(spark, d):
    return features.audit(job_features(spark, d), CORE[2:] + ["gpu_idle_ratio"])


@query("feature_violations", "SELECT " + ", ".join([*(f"CAST(0 AS BIGINT) AS infinite_{n}" for n in features.ENGINEERED), *(f"CAST(count(*) FILTER ({n} < 0) AS BIGINT) AS negative_{n}" for n in features.NON_NEGATIVE), "CAST(count(*) FILTER (gpu_idle_ratio NOT BETWEEN 0 AND 1) AS BIGINT) AS idle_out_of_range", "CAST(count(*) FILTER (gpu_active_flag NOT IN (0, 1)) AS BIGINT) AS flag_not_binary"]) + " FROM feat")
def _(spark, d):
    return features.violations(job_features(spark, d))


# -- exploratory statistics ------------------------------------------------------------------------------------------

_EDA = ["plan_cpu_mean", "instance_runtime_hours_sum", "gpu_utilization_mean", "runtime_log", "task_count"]


_LINEITEM = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@query("overview", "SELECT CAST(count(*) AS BIGINT) AS rows, 11 AS columns, 8 AS numeric_columns, 3 AS other_columns, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicate_rows, CAST(count(*) - count(DISTINCT l_orderkey) AS BIGINT) AS duplicate_keys FROM lineitem")
def _(spark, d):
    return profile.overview(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey")


@query("dtypes", " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values FROM lineitem" for c, t in _LINEITEM))
def _(spark, d):
    return profile.dtypes(spark.read.parquet(f"{d}/lineitem.parquet"))


@query("missingness", " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS missing_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4) AS missing_percent FROM feat" for c in CORE))
def _(spark, d):
    return profile.missingness(job_features(spark, d).select(*CORE))


def _describe(c: str, table: str = "feat", extra: str = ", CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS missing") -> str:
    return f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(CAST(max({c}) AS DOUBLE), 4) AS max{extra.format(c=c)}, CAST(count(*) FILTER ({c} = 0) AS BIGINT) AS zeros FROM {table}"


@query("describe", " UNION ALL ".join(map(_describe, _EDA)))
def _(spark, d):
    return profile.describe(job_features(spark, d), _EDA)


_CLASS = "CASE WHEN abs(s) < 0.5 THEN 'approximately symmetric' WHEN abs(s) <= 1 THEN 'moderately skewed' WHEN s IS NOT NULL THEN 'highly skewed' END AS skew_class"


@query("skew_kurtosis", f"SELECT column_name, n, round(s, 3) AS skewness, round(k, 3) AS kurtosis, {_CLASS} FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, skewness({c}) AS s, kurtosis({c}) AS k FROM feat" for c in _EDA) + ")")
def _(spark, d):
    return profile.skew_kurtosis(job_features(spark, d), _EDA)


def _iqr(c: str) -> str:
    low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    out = f"count(*) FILTER ({c} < {low} OR {c} > {high})"
    return f"SELECT '{c}' AS column_name, round(max({low}), 4) AS lower_bound, round(max({high}), 4) AS upper_bound, CAST(count({c}) AS BIGINT) AS n, CAST({out} AS BIGINT) AS outliers, round(100.0 * {out} / nullif(count({c}), 0), 4) AS outlier_percent FROM feat, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM feat)"


@query("iqr_outliers", " UNION ALL ".join(map(_iqr, _EDA)))
def _(spark, d):
    return profile.iqr_outliers(job_features(spark, d), _EDA)


@query("feature_quality", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS missing_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4) AS missing_percent FROM feat" for c in _EDA) + ") a JOIN (" + " UNION ALL ".join(_describe(c, extra="") for c in _EDA) + f") b USING (column_name) JOIN (SELECT column_name, round(s, 3) AS skewness, round(k, 3) AS kurtosis, {_CLASS} FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, skewness({c}) AS s, kurtosis({c}) AS k FROM feat" for c in _EDA) + ")) s USING (column_name) JOIN (SELECT * EXCLUDE (n) FROM (" + " UNION ALL ".join(map(_iqr, _EDA)) + ")) o USING (column_name)")
def _(spark, d):
    return profile.feature_quality(job_features(spark, d), _EDA)


@query("corr_pairs", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 4) AS r FROM feat" for i, a in enumerate(_EDA) for b in _EDA[i + 1 :]))
def _(spark, d):
    return profile.correlation_pairs(job_features(spark, d), _EDA)


@query("corr_pairs_both", "SELECT x, y, r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 4) AS r FROM core" for a in CORE for b in CORE if a != b) + ") WHERE abs(r) >= 0.8")
def _(spark, d):
    return profile.correlation_pairs(prepare.complete_cases(job_features(spark, d)), CORE, 0.8, both=True)


@query("category_topk", " UNION ALL ".join(f"(SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / (SELECT count(*) FROM master), 4) AS percent FROM master GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) ASC NULLS LAST LIMIT 15)" for c in ("job_status", "gpu_name", "task_count")))
def _(spark, d):
    return profile.top_categories(job_master(spark, d), ["job_status", "gpu_name", "task_count"])


_BAND = "CASE WHEN gpu_utilization_mean <= 10 THEN 0 WHEN gpu_utilization_mean <= 30 THEN 1 WHEN gpu_utilization_mean <= 70 THEN 2 WHEN gpu_utilization_mean IS NOT NULL THEN 3 END"


@query("util_bands", f"SELECT b.i AS band_order, b.label AS band, CAST(count(m.x) AS BIGINT) AS n, round(100.0 * count(m.x) / (SELECT count(*) FROM master WHERE has_telemetry = 1), 4) AS percent FROM (VALUES (0, 'Very Low (<10)'), (1, 'Low (10-30)'), (2, 'Medium (30-70)'), (3, 'High (>70)')) b(i, label) LEFT JOIN (SELECT {_BAND} AS x FROM master WHERE has_telemetry = 1) m ON b.i = m.x GROUP BY b.i, b.label")
def _(spark, d):
    return profile.band_table(job_master(spark, d).filter("has_telemetry = 1"), "gpu_utilization_mean")


@query("runtime_stats", _describe("instance_runtime_hours_sum", "(SELECT * FROM master WHERE instance_runtime_hours_sum >= 0)"))
def _(spark, d):
    return profile.describe(profile.runtime_rows(job_master(spark, d), "instance_runtime_hours_sum"), ["instance_runtime_hours_sum"])


@query("coverage_stats", _describe("telemetry_coverage", "(SELECT least(greatest(telemetry_coverage, 0.0), 1.0) AS telemetry_coverage FROM master)"))
def _(spark, d):
    return profile.telemetry_stats(job_master(spark, d))


def _hist(x: str, bins: int) -> str:
    return f"SELECT bin, round(max(lo + bin * (hi - lo) / {bins}), 4) AS low, CAST(count(*) AS BIGINT) AS n FROM (SELECT lo, hi, CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin FROM (SELECT {x} AS x FROM feat), (SELECT min({x}) AS lo, max({x}) AS hi FROM feat) WHERE x IS NOT NULL) GROUP BY bin"


@query("histogram", _hist("plan_cpu_mean", 50))
def _(spark, d):
    return profile.histogram(job_features(spark, d), "plan_cpu_mean", 50)


@query("histogram_log", _hist("ln(1 + instance_runtime_hours_sum)", 30))
def _(spark, d):
    return profile.histogram(job_features(spark, d), "instance_runtime_hours_sum", 30, log=True)


@query("boxplot", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 4) AS low, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(CAST(max({c}) AS DOUBLE), 4) AS high FROM feat" for c in _EDA))
def _(spark, d):
    return profile.boxplot(job_features(spark, d), _EDA)


# -- preparation -----------------------------------------------------------------------------------------------------


@query("complete_case_split", "SELECT CAST(count(*) AS BIGINT) AS total, (SELECT CAST(count(*) AS BIGINT) FROM core) AS complete, CAST(count(*) - (SELECT count(*) FROM core) AS BIGINT) AS excluded, round(100.0 * (SELECT count(*) FROM core) / count(*), 4) AS complete_percent FROM feat")
def _(spark, d):
    return prepare.case_counts(job_features(spark, d))


@query("tail_caps", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.005) + 1e-7, 4) AS lower_cap, round(quantile_cont({c}, 0.995) + 1e-7, 4) AS upper_cap FROM core" for c in prepare.RATIOS))
def _(spark, d):
    return rounded(prepare.tail_caps(prepare.complete_cases(job_features(spark, d)), prepare.RATIOS))


def _capped(both: list[str], upper: list[str]) -> str:
    caps = ", ".join(f"quantile_cont({c}, 0.005) AS lo_{c}, quantile_cont({c}, 0.995) AS hi_{c}" for c in [*both, *upper])
    value = lambda c: f"least(greatest({c}, lo_{c}), hi_{c})" if c in both else f"least({c}, hi_{c})" if c in upper else c
    return f"SELECT job_name, {', '.join(f'{value(c)} AS {c}' for c in CORE)} FROM core, (SELECT {caps} FROM core)"


@query("capped", f"SELECT job_name, {_round(CORE)} FROM ({_capped(prepare.RATIOS, [])})")
def _(spark, d):
    return rounded(prepare.apply_caps(prepare.complete_cases(job_features(spark, d)).select("job_name", *CORE)))


@query("winsorized", f"SELECT job_name, {_round(CORE)} FROM ({_capped(prepare.RATIOS, prepare.UPPER_ONLY)})")
def _(spark, d):
    return rounded(prepare.winsorized(prepare.complete_cases(job_features(spark, d)).select("job_name", *CORE)))


_ROBUST = f"SELECT job_name, {', '.join(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}' for c in CORE)} FROM ({_capped(prepare.RATIOS, [])}), (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}' for c in CORE)} FROM ({_capped(prepare.RATIOS, [])}))"
_STANDARD = f"SELECT job_name, {', '.join(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}' for c in CORE)} FROM ({_capped(prepare.RATIOS, prepare.UPPER_ONLY)}), (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in CORE)} FROM ({_capped(prepare.RATIOS, prepare.UPPER_ONLY)}))"


def matrix(spark: SparkSession, sf_dir: str, kind: str = "robust") -> DataFrame:
    return prepare.matrices(job_features(spark, sf_dir), "job_name")[kind]


@query("robust_scaled", f"SELECT job_name, {_round(CORE)} FROM ({_ROBUST})")
def _(spark, d):
    return rounded(matrix(spark, d))


@query("standard_scaled", f"SELECT job_name, {_round(CORE)} FROM ({_STANDARD})")
def _(spark, d):
    return rounded(matrix(spark, d, "standard"))


@query("matrix_audit", f"SELECT CAST(count(*) AS BIGINT) AS rows, 12 AS columns, CAST(0 AS BIGINT) AS nan_count, CAST(0 AS BIGINT) AS infinite_count, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(CORE)} FROM ({_ROBUST}))) AS BIGINT) AS duplicate_vectors, round(least({', '.join(f'min({c})' for c in CORE)}), 4) AS global_min, round(greatest({', '.join(f'max({c})' for c in CORE)}), 4) AS global_max FROM ({_ROBUST})")
def _(spark, d):
    return prepare.matrix_audit(matrix(spark, d), CORE)


@query("feature_stats", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}) + 1e-7, 4) AS mean, round(stddev_pop({c}) + 1e-7, 4) AS std, round(quantile_cont({c}, 0.5) + 1e-7, 4) AS median, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) + 1e-7, 4) AS iqr, round(min({c}) + 1e-7, 4) AS min, round(max({c}) + 1e-7, 4) AS max FROM core" for c in CORE))
def _(spark, d):
    return rounded(prepare.feature_stats(prepare.complete_cases(job_features(spark, d)), CORE))


@query("vif")
def _(spark, d):
    return prepare.vif(matrix(spark, d), CORE)


_EX = " AND ".join(f"{c} IS NOT NULL" for c in CORE)


@query("excluded_profile", " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce(CAST({c} AS VARCHAR), '<MISSING>') AS value, CAST(count(*) FILTER ({_EX}) AS BIGINT) AS eligible, CAST(count(*) FILTER (NOT ({_EX})) AS BIGINT) AS excluded, round(100.0 * count(*) FILTER (NOT ({_EX})) / count(*), 4) AS excluded_percent FROM feat GROUP BY 2" for c in ("job_status", "gpu_name", "has_telemetry")))
def _(spark, d):
    return prepare.excluded_profile(job_features(spark, d), ["job_status", "gpu_name", "has_telemetry"])


@query("ratio_review", " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS n, " + ", ".join(f"round(quantile_cont({c}, {p}), 4) AS {n}" for n, p in (("p01", 0.01), ("p05", 0.05), ("median", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM feat" for c in prepare.RATIOS))
def _(spark, d):
    return prepare.ratio_review(job_features(spark, d))


# -- sampling, windows, selection --------------------------------------------------------------------------------------

_EDGES = "(SELECT " + ", ".join(f"quantile_cont(plan_cpu_mean, {i / 5}) AS e{i}" for i in range(1, 5)) + " FROM feat)"


@query("qcut_strata", f"SELECT CAST(CASE WHEN plan_cpu_mean <= e1 THEN 0 WHEN plan_cpu_mean <= e2 THEN 1 WHEN plan_cpu_mean <= e3 THEN 2 WHEN plan_cpu_mean <= e4 THEN 3 WHEN plan_cpu_mean IS NOT NULL THEN 4 END AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS n FROM feat, {_EDGES} GROUP BY 1")
def _(spark, d):
    return sampling.qcut(job_features(spark, d), "plan_cpu_mean", "bucket").groupBy("bucket").agg(F.count("*").alias("n"))


@query("rank_bucket", "SELECT CAST((row_number() OVER (ORDER BY plan_cpu_mean ASC NULLS LAST, job_name) - 1) % 5 AS INTEGER) AS bucket, job_name FROM feat")
def _(spark, d):
    return sampling.rank_bucket(job_features(spark, d).select("job_name", "plan_cpu_mean"), "plan_cpu_mean", "job_name", "bucket").select("bucket", "job_name")


_STATUS_MEAN = "SELECT job_status, avg(plan_cpu_mean) AS v FROM master GROUP BY job_status"


@query("rank_pct", f"SELECT job_status, round((rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER (), 4) AS rank_pct FROM ({_STATUS_MEAN})")
def _(spark, d):
    means = job_master(spark, d).groupBy("job_status").agg(F.avg("plan_cpu_mean").alias("v"))
    return means.select("job_status", F.round(evaluate.average_rank_pct("v"), 4).alias("rank_pct"))


# -- semantic tags: clusters played by the customer's segment -----------------------------------------------------------

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_CLUSTER = "CASE " + " ".join(f"WHEN job_status = '{s}' THEN {i - 1}" for i, s in enumerate(_SEGMENTS)) + " END"
_TAGS = "SELECT job_name, max(CASE WHEN lower(trim(workload)) NOT IN ('', 'nan', 'none', 'null', 'na', 'n/a', 'unknown') THEN trim(workload) END) AS workload FROM (SELECT DISTINCT job_name, inst_id FROM instance) i JOIN grp USING (inst_id) GROUP BY job_name"
_TAGGED = f"SELECT m.job_name, {_CLUSTER} AS cluster_id, t.workload FROM master m LEFT JOIN ({_TAGS}) t ON m.job_name = t.job_name"
_CELLS = f"SELECT workload, cluster_id, count(*) AS n FROM ({_TAGGED}) WHERE workload IS NOT NULL AND cluster_id <> -1 GROUP BY 1, 2"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    jobs = t["job"].select("job_name", F.expr(_CLUSTER.replace("job_status", "status")).alias("cluster_id"))
    return semantic.tagged_assignments(jobs, semantic.job_tags(t["instance"], t["group_tag"]))


@query("job_tags", f"SELECT * FROM ({_TAGS})")
def _(spark, d):
    t = tables(spark, d)
    return semantic.job_tags(t["instance"], t["group_tag"])


@query("tag_coverage", f"SELECT CAST(count(*) AS BIGINT) AS jobs, CAST(count(workload) AS BIGINT) AS tagged_jobs, round(100.0 * count(workload) / count(*), 4) AS tagged_percent, CAST(count(*) FILTER (workload IS NOT NULL AND cluster_id <> -1) AS BIGINT) AS tagged_clustered_jobs, CAST(count(DISTINCT workload) AS BIGINT) AS tags FROM ({_TAGGED})")
def _(spark, d):
    return semantic.tag_coverage(tagged(spark, d))


@query("tag_crosstab", "SELECT workload, " + ", ".join(f'CAST(coalesce(sum(CASE WHEN cluster_id = {i} THEN n END), 0) AS BIGINT) AS "{i}"' for i in range(4)) + f" FROM ({_CELLS}) GROUP BY workload")
def _(spark, d):
    return semantic.crosstab(tagged(spark, d), [0, 1, 2, 3])


@query("tag_enrichment", f"""SELECT workload AS workload_tag, cluster_id, CAST(n AS BIGINT) AS tag_count_in_cluster, CAST(t AS BIGINT) AS tag_total, CAST(c AS BIGINT) AS cluster_tagged_total, round(100.0 * n / nullif(t, 0), 4) AS tag_within_cluster_percent,
round(100.0 * n / nullif(c, 0), 4) AS cluster_within_tag_percent, round(CAST(n AS DOUBLE) * total / nullif(t * c, 0), 4) AS enrichment_ratio FROM (SELECT *, sum(n) OVER (PARTITION BY workload) AS t, sum(n) OVER (PARTITION BY cluster_id) AS c, sum(n) OVER () AS total
FROM (SELECT a.workload, b.cluster_id, coalesce(x.n, 0) AS n FROM (SELECT DISTINCT workload FROM ({_CELLS})) a CROSS JOIN (SELECT DISTINCT cluster_id FROM ({_CELLS})) b LEFT JOIN ({_CELLS}) x ON a.workload = x.workload AND b.cluster_id = x.cluster_id))""")
def _(spark, d):
    return semantic.enrichment(tagged(spark, d))


@query("dominant_tag", f"SELECT cluster_id, workload AS dominant_tag, CAST(n AS BIGINT) AS dominant_count, CAST(t AS BIGINT) AS tagged_jobs, round(100.0 * n / t, 4) AS dominant_percent, CAST(k AS BIGINT) AS number_of_workload_tags FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, workload) AS rn, sum(n) OVER (PARTITION BY cluster_id) AS t, count(*) OVER (PARTITION BY cluster_id) AS k FROM ({_CELLS})) WHERE rn = 1")
def _(spark, d):
    return semantic.dominant_tags(tagged(spark, d))


# -- modelling ----------------------------------------------------------------------------------------------------------


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robust matrix with clusters played by the job's status, for the metrics that SQL can check."""
    jobs = tables(spark, sf_dir)["job"].select("job_name", F.expr(_CLUSTER.replace("job_status", "status")).alias("cluster_id"))
    return matrix(spark, sf_dir).join(jobs, "job_name").withColumn("cluster_probability", F.lit(1.0))


_SEG = f"SELECT r.*, {_CLUSTER} AS cluster_id FROM ({_ROBUST}) r JOIN (SELECT job_name AS j, job_status FROM master) ON r.job_name = j"


@query("cluster_structure", f"""SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) FILTER (cluster_id <> -1) AS BIGINT) AS cluster_count, CAST(coalesce(sum(n) FILTER (cluster_id = -1), 0) AS BIGINT) AS noise_count, round(CAST(coalesce(sum(n) FILTER (cluster_id = -1), 0) AS DOUBLE) / sum(n), 4) AS noise_fraction,
CAST(max(n) FILTER (cluster_id <> -1) AS BIGINT) AS largest_cluster_size, CAST(min(n) FILTER (cluster_id <> -1) AS BIGINT) AS smallest_cluster_size, CAST(median(n) FILTER (cluster_id <> -1) AS DOUBLE) AS median_cluster_size, round(CAST(max(n) FILTER (cluster_id <> -1) AS DOUBLE) / sum(n), 4) AS largest_cluster_fraction,
round(CAST(max(n) FILTER (cluster_id <> -1) AS DOUBLE) / sum(n) FILTER (cluster_id <> -1), 4) AS largest_cluster_fraction_non_noise, CAST(0 AS BIGINT) AS number_of_clusters_below_1_percent FROM (SELECT cluster_id, count(*) AS n FROM (SELECT {_CLUSTER} AS cluster_id FROM master) GROUP BY 1)""")
def _(spark, d):
    return evaluate.structure(tagged(spark, d))


@query("cluster_summary", f"SELECT cluster_id, CAST(count(*) AS BIGINT) AS job_count, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percentage, CAST(1.0 AS DOUBLE) AS mean_probability, CASE WHEN cluster_id = -1 THEN 'NOISE' ELSE 'CLUSTER_' || cluster_id END AS cluster_name FROM ({_SEG}) GROUP BY cluster_id")
def _(spark, d):
    return evaluate.cluster_summary(segments(spark, d))


@query("cluster_profiles", "SELECT cluster_id, CAST(job_count AS BIGINT) AS job_count, mean_probability, percentage, " + _round([f"{c}_{s}" for c in CORE for s in ("mean", "median")]) + ", " + ", ".join(f"round((rank() OVER (ORDER BY {c}_mean) + (count(*) OVER (PARTITION BY {c}_mean) - 1) / 2.0) / count(*) OVER (), 4) AS {c}_rank" for c in CORE[:8]) + " FROM (SELECT cluster_id, count(*) AS job_count, CAST(1.0 AS DOUBLE) AS mean_probability, " + ", ".join(f"avg({c}) AS {c}_mean, quantile_cont({c}, 0.5) AS {c}_median" for c in CORE) + f", round(100.0 * count(*) / (SELECT count(*) FROM ({_SEG})), 4) AS percentage FROM ({_SEG}) WHERE cluster_id <> -1 GROUP BY cluster_id)")
def _(spark, d):
    return rounded(evaluate.cluster_profiles(segments(spark, d), CORE, CORE[:8]))


@query("profile_z_scores", f"SELECT cluster_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 4) AS {c}" for c in CORE) + " FROM (SELECT cluster_id, " + ", ".join(f"avg({c}) AS {c}" for c in CORE) + f" FROM ({_SEG}) GROUP BY cluster_id)")
def _(spark, d):
    means = segments(spark, d).groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in CORE])
    return evaluate.profile_z_scores(means, CORE)


_CENTERS = "SELECT cluster_id, count(*) AS n, " + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in CORE) + f" FROM ({_SEG}) GROUP BY cluster_id"


@query("calinski_harabasz", f"SELECT round(sum(n * ({' + '.join(f'power(m_{c} - g_{c}, 2)' for c in CORE)})) * (sum(n) - count(*)) / (sum(n * ({' + '.join(f'v_{c}' for c in CORE)})) * (count(*) - 1)), 4) AS calinski_harabasz FROM ({_CENTERS}), (SELECT {', '.join(f'avg({c}) AS g_{c}' for c in CORE)} FROM ({_SEG}))")
def _(spark, d):
    return evaluate.calinski_harabasz(segments(spark, d), CORE)


_NEAR = f"SELECT c.cluster_id, {', '.join(f'max(m_{c}) AS m_{c}' for c in CORE)}, avg(sqrt({' + '.join(f'power(s.{c} - m_{c}, 2)' for c in CORE)})) AS s FROM ({_SEG}) s JOIN ({_CENTERS}) c ON s.cluster_id = c.cluster_id GROUP BY c.cluster_id"


@query("davies_bouldin", f"SELECT round(avg(worst), 4) AS davies_bouldin FROM (SELECT a.cluster_id, max((a.s + b.s) / sqrt({' + '.join(f'power(a.m_{c} - b.m_{c}, 2)' for c in CORE)})) AS worst FROM ({_NEAR}) a JOIN ({_NEAR}) b ON a.cluster_id <> b.cluster_id GROUP BY a.cluster_id)")
def _(spark, d):
    return evaluate.davies_bouldin(segments(spark, d), CORE)


_OTHER = 'CAST("user" AS INTEGER) % 3'
_PAIRS = f"SELECT {_CLUSTER} AS a, {_OTHER} AS b, count(*) AS n FROM master WHERE {_CLUSTER} <> -1 GROUP BY 1, 2"
_C2 = lambda x: f"{x} * ({x} - 1) / 2.0"


@query("adjusted_rand", f"SELECT CAST(n AS BIGINT) AS comparison_rows, round((cells - r * c / ({_C2('n')})) / ((r + c) / 2 - r * c / ({_C2('n')})), 4) AS ari FROM (SELECT sum({_C2('n')}) AS cells, CAST(sum(n) AS DOUBLE) AS n FROM ({_PAIRS})), (SELECT sum({_C2('n')}) AS r FROM (SELECT CAST(sum(n) AS DOUBLE) AS n FROM ({_PAIRS}) GROUP BY a)), (SELECT sum({_C2('n')}) AS c FROM (SELECT CAST(sum(n) AS DOUBLE) AS n FROM ({_PAIRS}) GROUP BY b))")
def _(spark, d):
    jobs = tables(spark, d)["job"]
    other = jobs.select("job_name", F.expr("cast(user as int) % 3").alias("cluster_id"))
    return evaluate.adjusted_rand(evaluate.contingency(tagged(spark, d).select("job_name", "cluster_id"), other, "job_name"))


@query("hdbscan_assign")
def _(spark, d):
    return cluster.fit_density(matrix(spark, d), "job_name", CORE)


@query("pca_2d")
def _(spark, d):
    return cluster.pca_2d(matrix(spark, d), "job_name", CORE)


@query("cluster_metrics")
def _(spark, d):
    rows = segments(spark, d).cache()
    m = evaluate.metrics(rows, CORE, "job_name")
    return spark.createDataFrame([tuple(m[k] for k in ("silhouette", "davies_bouldin", "calinski_harabasz", "dbcv", "dbcv_status"))], "silhouette double, davies_bouldin double, calinski_harabasz double, dbcv double, dbcv_status string")


@query("events_windowed", "SELECT date_trunc('day', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS events, round(avg(CASE WHEN value BETWEEN 0 AND 100 THEN value END), 4) AS mean_value, CAST(count(*) FILTER (value < 0 OR value > 100) AS BIGINT) AS outliers FROM events GROUP BY 1, 2")
def _(spark, d):
    return events.windowed(spark.read.parquet(f"{d}/events.parquet")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


from . import audit_queries, choice_queries  # noqa: E402,F401  they add their queries
