"""Queries of join validation, range checks, eligibility, provenance, scaling and the decision report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, features, integrity, prepare, profile
from ..operators.features import CORE
from .catalog import query
from .registry import _ROBUST, _SEG, _STANDARD, _cov, _describe, matrix, segments
from .trace import cleaned, job_features, job_master, rounded, tables

# -- joins between raw tables ------------------------------------------------------------------------------------------


def _full(child: str, parent: str, keys: list[str], null_unmatched: bool = True) -> str:
    """SQL of ``integrity.full_coverage``: rows of the child by IN over known keys, different keys of the parent by IN."""
    ks, known = ", ".join(keys), " AND ".join(f"{k} IS NOT NULL" for k in keys)
    total, null = f"(SELECT count(*) FROM {child})", f"(SELECT count(*) FROM {child} WHERE NOT ({known}))"
    matched = f"(SELECT count(*) FROM {child} WHERE {known} AND ({ks}) IN (SELECT ({ks}) FROM {parent} WHERE {known}))"
    unmatched = f"{total} - {matched}" + ("" if null_unmatched else f" - {null}")
    distinct = f"SELECT DISTINCT {ks} FROM {parent} WHERE {known}"
    hit = f"(SELECT count(*) FROM ({distinct}) WHERE ({ks}) IN (SELECT ({ks}) FROM {child} WHERE {known}))"
    return f"""SELECT CAST({total} AS BIGINT) AS total_rows, CAST({matched} AS BIGINT) AS matched_rows, CAST({unmatched} AS BIGINT) AS unmatched_rows, CAST({null} AS BIGINT) AS null_key_rows,
round(100.0 * {matched} / nullif({total}, 0), 4) AS matched_percent, CASE WHEN {unmatched} = 0 THEN 'OK' ELSE 'WARNING' END AS status, CAST((SELECT count(*) FROM ({distinct})) AS BIGINT) AS parent_keys,
CAST({hit} AS BIGINT) AS parent_keys_matched, round(100.0 * {hit} / nullif((SELECT count(*) FROM ({distinct})), 0), 4) AS parent_percent"""


@query("cov_sensor_instance", _full("sensor", "instance", ["inst_id"], False))
def _(spark, d):
    t = tables(spark, d)
    return integrity.full_coverage(t["sensor"], t["instance"], ["inst_id"], null_unmatched=False)


_FOUR, _THREE = ["job_name", "task_name", "inst_id", "worker_name"], ["job_name", "task_name", "inst_id"]
_SAMPLED = "(SELECT * FROM instance WHERE status = 'F' AND worker_name <> '2')"


def _sampled(t):
    """What telemetry would have of the instances: finished ones, without their second worker."""
    return t["instance"].filter("status = 'F' and worker_name <> '2'")


@query("cov_instance_sensor_key", _full(_SAMPLED, "instance", _FOUR))
def _(spark, d):
    t = tables(spark, d)
    return integrity.full_coverage(_sampled(t), t["instance"], _FOUR)


@query("cov_sensor_instance_key", _full("sensor", "instance", _FOUR))
def _(spark, d):
    t = tables(spark, d)
    return integrity.full_coverage(t["sensor"], t["instance"], _FOUR)


@query("worker_containment", f"""SELECT CAST(count(*) AS BIGINT) AS shared_keys, CAST(count(*) FILTER (lacking > 0) AS BIGINT) AS keys_not_contained FROM (SELECT {', '.join(f'a.{k}' for k in _THREE)}, count(*) FILTER (b.worker_name IS NULL) AS lacking
FROM (SELECT DISTINCT {', '.join(_FOUR)} FROM instance) a LEFT JOIN (SELECT DISTINCT {', '.join(_FOUR)} FROM {_SAMPLED}) b USING ({', '.join(_FOUR)})
WHERE ({', '.join(f'a.{k}' for k in _THREE)}) IN (SELECT ({', '.join(_THREE)}) FROM {_SAMPLED}) GROUP BY ALL)""")
def _(spark, d):
    t = tables(spark, d)
    return integrity.containment(t["instance"], _sampled(t), _THREE, "worker_name")


@query("cov_group_tag_keys", _full("instance", "grp", ["inst_id"]))
def _(spark, d):
    t = tables(spark, d)
    return integrity.full_coverage(t["instance"], t["group_tag"], ["inst_id"])


@query("cov_machine_spec_keys", _full("instance", "spec", ["machine"]))
def _(spark, d):
    t = tables(spark, d)
    return integrity.full_coverage(t["instance"], t["machine_spec"], ["machine"])


@query("cov_machine_metric", _cov("instance", "metric", ["worker_name", "machine"]))
def _(spark, d):
    t = tables(spark, d)
    return integrity.coverage(t["instance"], t["machine_metric"], ["worker_name", "machine"])


@query("merge_one_to_one", "SELECT t.job_name, task_count, instance_count FROM task_s t JOIN inst_s i ON t.job_name = i.job_name")
def _(spark, d):
    from ..operators import summaries

    c = cleaned(spark, d)
    tasks = summaries.task_summary(c["task"]).select("job_name", "task_count")
    return integrity.merge_one_to_one(tasks, summaries.instance_summary(c["instance"]).select("job_name", "instance_count"), ["job_name"])


# -- ranges and missing values of raw tables -----------------------------------------------------------------------------


def _ranges(table: str, name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(count(*) FILTER ({v}) AS BIGINT) AS violations FROM {name}" for k, v in profile.RANGE_RULES[table].items())


for _table, _name in (("job", "job"), ("task", "task"), ("instance", "instance"), ("sensor", "sensor"), ("machine_metric", "metric")):

    @query(f"range_violations_{_table}", _ranges(_table, _name))
    def _(spark, d, table=_table):
        return profile.range_violations(tables(spark, d)[table], profile.RANGE_RULES[table])


@query("task_missing_by_status", "SELECT coalesce(status, '<MISSING>') AS status, CAST(count(*) AS BIGINT) AS rows, " + ", ".join(f"CAST(count(*) - count({c}) AS BIGINT) AS null_{c}" for c in profile.TASK_FIELDS) + " FROM task GROUP BY 1")
def _(spark, d):
    return profile.nulls_by_status(tables(spark, d)["task"], profile.TASK_FIELDS, keep_missing=True)


# -- master and features -------------------------------------------------------------------------------------------------

_SEEN = "(SELECT * FROM master WHERE has_telemetry = 1)"


@query("utilization_stats", " UNION ALL ".join(_describe(c, _SEEN) for c in ("gpu_utilization_mean", "gpu_utilization_max")))
def _(spark, d):
    return profile.describe(job_master(spark, d).filter("has_telemetry = 1"), ["gpu_utilization_mean", "gpu_utilization_max"])


_POINTS = "(SELECT * FROM feat ORDER BY md5(job_name || ':42'), job_name LIMIT 1000)"


@query("scatter_pairs", " UNION ALL ".join(f"SELECT '{x}' AS x_column, '{y}' AS y_column, job_name, round(CAST({x} AS DOUBLE) + 1e-7, 4) AS x, round(CAST({y} AS DOUBLE) + 1e-7, 4) AS y FROM {_POINTS} WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in profile.RELATIONSHIPS))
def _(spark, d):
    return rounded(profile.scatter_pairs(job_features(spark, d), "job_name", 1000))


_FLAGS = {"telemetry": "has_telemetry", "gpu_request": "has_gpu_request", "execution_timing": "has_execution_timing"}


@query("modeling_eligibility", "SELECT CAST(count(*) AS BIGINT) AS total_jobs, " + ", ".join(f"CAST(count(*) FILTER ({f} = {v}) AS BIGINT) AS jobs_{w}_{n}" for n, f in _FLAGS.items() for w, v in (("with", 1), ("without", 0))) + ", " + ", ".join(f"CAST(count(*) - count({c}) AS BIGINT) AS missing_{c}" for c in features.REPORTED) + " FROM feat")
def _(spark, d):
    return features.eligibility(job_features(spark, d))


def _source(c: str) -> str:
    reason = next((r for r, fs in prepare.REASONS.items() if c in fs), prepare.OTHER_REASON)
    return f"""SELECT '{c}' AS feature, CAST(count(*) - count({c}) AS BIGINT) AS missing_count, round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing_percentage,
CAST(count(*) FILTER (isinf(CAST({c} AS DOUBLE))) AS BIGINT) AS inf_count, CAST(count(*) FILTER ({c} = 0) AS BIGINT) AS zero_count, CAST(count(*) FILTER ({c} < 0) AS BIGINT) AS negative_count, '{reason}' AS likely_reason FROM feat"""


_SOURCES = [*CORE, "gpu_idle_ratio", "machine_count"]


@query("provenance", " UNION ALL ".join(map(_source, _SOURCES)))
def _(spark, d):
    return prepare.provenance(job_features(spark, d), _SOURCES)


def _scaling(name: str, kind: str, rows: str, c: str) -> str:
    ok = "abs(median) < 1e-6 AND abs(iqr - 1) < 0.10" if kind == "robust" else "abs(mean) < 0.10 AND abs(std - 1) < 0.10"
    return f"""SELECT '{name}' AS matrix, '{c}' AS feature, round(mean + 1e-7, 4) AS mean, round(std + 1e-7, 4) AS std, round(median + 1e-7, 4) AS median, round(iqr + 1e-7, 4) AS iqr, '{kind}' AS expected_scaling,
CASE WHEN {ok} THEN 'PASS' ELSE 'REVIEW' END AS scale_status FROM (SELECT avg({c}) AS mean, coalesce(stddev_samp({c}), 0.0) AS std, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM ({rows}))"""


@query("scaling_audit", " UNION ALL ".join(_scaling(n, k, r, c) for n, k, r in (("hdbscan", "robust", _ROBUST), ("kmeans", "standard", _STANDARD)) for c in CORE))
def _(spark, d):
    robust = prepare.scaling_audit(matrix(spark, d), CORE, "hdbscan", "robust")
    return rounded(robust.unionByName(prepare.scaling_audit(matrix(spark, d, "standard"), CORE, "kmeans", "standard")))


_THREE_FEATURES = ["plan_cpu_mean", "plan_mem_mean", "gpu_utilization_intensity"]


def _vif(i: int) -> str:
    """Variance inflation among three features in closed form, from their correlations."""
    x, y, z = _THREE_FEATURES[i], *(_THREE_FEATURES[j] for j in range(3) if j != i)
    r2 = f"(power(corr({x}, {y}), 2) + power(corr({x}, {z}), 2) - 2 * corr({x}, {y}) * corr({x}, {z}) * corr({y}, {z})) / (1 - power(corr({y}, {z}), 2))"
    return f"SELECT '{x}' AS feature, round(1 / (1 - {r2}), 4) AS vif, 1 / (1 - {r2}) > 5 AS high FROM core"


@query("vif_three", " UNION ALL ".join(map(_vif, range(3))))
def _(spark, d):
    rows = prepare.complete_cases(job_features(spark, d)).select(*_THREE_FEATURES)
    return prepare.vif(rows, _THREE_FEATURES).withColumn("vif", F.round("vif", 4))


@query("alignment", "SELECT CAST(count(*) AS BIGINT) AS eligible_rows, CAST(count(*) FILTER (CAST(job_name AS BIGINT) % 7 <> 3) + count(*) FILTER (CAST(job_name AS BIGINT) % 11 = 0) AS BIGINT) AS matrix_rows, CAST(count(*) FILTER (CAST(job_name AS BIGINT) % 7 = 3 AND CAST(job_name AS BIGINT) % 11 <> 0) AS BIGINT) AS missing_in_matrix, CAST(0 AS BIGINT) AS unknown_in_matrix, CAST(count(*) FILTER (CAST(job_name AS BIGINT) % 7 <> 3 AND CAST(job_name AS BIGINT) % 11 = 0) AS BIGINT) AS repeated_keys, count(*) FILTER (CAST(job_name AS BIGINT) % 7 = 3 AND CAST(job_name AS BIGINT) % 11 <> 0) = 0 AND count(*) FILTER (CAST(job_name AS BIGINT) % 7 <> 3 AND CAST(job_name AS BIGINT) % 11 = 0) = 0 AS aligned FROM core")
def _(spark, d):
    """A matrix that lacks some jobs of the population and repeats others, so that every count has something to find."""
    eligible, rows = prepare.complete_cases(job_features(spark, d)), matrix(spark, d)
    faulty = rows.filter("cast(job_name as long) % 7 <> 3").unionByName(rows.filter("cast(job_name as long) % 11 = 0"))
    return prepare.alignment(eligible, faulty, "job_name")


@query("matrix_alignment", "SELECT CAST(count(*) AS BIGINT) AS eligible_rows, CAST(count(*) AS BIGINT) AS matrix_rows, CAST(0 AS BIGINT) AS missing_in_matrix, CAST(0 AS BIGINT) AS unknown_in_matrix, CAST(0 AS BIGINT) AS repeated_keys, TRUE AS aligned FROM core")
def _(spark, d):
    return prepare.alignment(prepare.complete_cases(job_features(spark, d)), matrix(spark, d), "job_name")


@query("decision_report")
def _(spark, d):
    return prepare.decision_report(job_features(spark, d), "job_name")


_APART = "sqrt(" + " + ".join(f"power(a.{c} - b.{c}, 2)" for c in CORE) + ")"
_MEANS = f"SELECT a.job_name, a.cluster_id AS own, b.cluster_id AS other, avg({_APART}) AS m FROM ({_SEG}) a JOIN ({_SEG}) b ON a.job_name <> b.job_name WHERE a.cluster_id <> -1 AND b.cluster_id <> -1 GROUP BY 1, 2, 3"


@query("silhouette", f"SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM (SELECT job_name, max(CASE WHEN own = other THEN m END) AS a, min(CASE WHEN own <> other THEN m END) AS b FROM ({_MEANS}) GROUP BY job_name)")
def _(spark, d):
    return spark.createDataFrame([(round(evaluate.metrics(segments(spark, d), CORE, "job_name")["silhouette"], 4),)], "silhouette double")
