"""Clustering matrices: complete cases, tail caps, scaling, audits. Every matrix carries its key, never positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clip, finite
from .features import CORE
from .profile import correlation, correlation_pairs

RATIOS = ["resource_efficiency_score", "cpu_gpu_imbalance"]
UPPER_ONLY = ["io_intensity", "runtime_log"]
TAIL = (0.005, 0.995)


def complete(columns: list[str] = CORE) -> Column:
    return reduce(lambda a, b: a & b, [finite(F.col(c)) for c in columns])


def complete_cases(df: DataFrame, columns: list[str] = CORE) -> DataFrame:
    return df.filter(complete(columns))


def excluded_cases(df: DataFrame, columns: list[str] = CORE) -> DataFrame:
    return df.filter(~complete(columns))


def case_counts(df: DataFrame, columns: list[str] = CORE) -> DataFrame:
    yes = F.count_if(complete(columns))
    return df.agg(F.count("*").alias("total"), yes.alias("complete"), (F.count("*") - yes).alias("excluded"), F.round(F.try_divide(100.0 * yes, F.count("*")), 4).alias("complete_percent"))


def tail_caps(df: DataFrame, columns: list[str], low: float = TAIL[0], high: float = TAIL[1]) -> DataFrame:
    """A row for each column: exact quantiles as lower and upper cap."""
    rows = [F.struct(F.lit(c).alias("feature"), F.percentile(F.col(c).cast("double"), F.lit(low)).alias("lower_cap"), F.percentile(F.col(c).cast("double"), F.lit(high)).alias("upper_cap")) for c in columns]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _one_row(df: DataFrame, columns: list[str]) -> DataFrame:
    q = {c: F.percentile(F.col(c).cast("double"), F.array(F.lit(TAIL[0]), F.lit(TAIL[1]))).alias(f"__{c}") for c in columns}
    return F.broadcast(df.agg(*q.values()))  # one row


def apply_caps(df: DataFrame, both: list[str] = RATIOS, upper: list[str] = ()) -> DataFrame:
    """Values beyond the tail quantiles drawn in: on both sides, or on the upper only. Null stays null."""
    names = [*both, *upper]
    wide = df.crossJoin(_one_row(df, names))
    edge = lambda c, i: F.col(f"__{c}")[i]
    return wide.withColumns({c: clip(F.col(c), edge(c, 0) if c in both else None, edge(c, 1)) for c in names}).select(df.columns)


def winsorized(df: DataFrame) -> DataFrame:
    return apply_caps(df, RATIOS, UPPER_ONLY)


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / IQR; an IQR of 0 divides by 1."""
    q = F.broadcast(df.agg(*[F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__{c}") for c in columns]))
    spread = lambda c: F.col(f"__{c}")[2] - F.col(f"__{c}")[0]
    return df.crossJoin(q).withColumns({c: (F.col(c) - F.col(f"__{c}")[1]) / F.when(spread(c) == 0, 1.0).otherwise(spread(c)) for c in columns}).select(df.columns)


def standard_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; 0 divides by 1."""
    q = F.broadcast(df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"__{c}") for c in columns]))
    return df.crossJoin(q).withColumns({c: (F.col(c) - F.col(f"__{c}.m")) / F.when(F.col(f"__{c}.s") == 0, 1.0).otherwise(F.col(f"__{c}.s")) for c in columns}).select(df.columns)


def matrices(features: DataFrame, key: str, columns: list[str] = CORE) -> dict[str, DataFrame]:
    """robust: capped and robust-scaled, for density clustering; standard: winsorised and standard-scaled."""
    core = complete_cases(features, columns).select(key, *columns)
    return {"robust": robust_scaled(apply_caps(core), columns), "standard": standard_scaled(winsorized(core), columns)}


def matrix_audit(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, columns, NaN, infinite, repeated vectors, least and largest value."""
    distinct = matrix.select(*columns).distinct().agg(F.count("*").alias("d"))
    total = lambda f: reduce(lambda a, b: a + b, [F.count_if(f(F.col(c))) for c in columns])
    one = matrix.agg(F.count("*").alias("rows"), total(F.isnan).alias("nan_count"), total(lambda c: F.abs(c) == float("inf")).alias("infinite_count"), F.round(F.least(*[F.min(c) for c in columns]), 4).alias("global_min"), F.round(F.greatest(*[F.max(c) for c in columns]), 4).alias("global_max"))
    return one.crossJoin(distinct).select("rows", F.lit(len(columns)).alias("columns"), "nan_count", "infinite_count", (F.col("rows") - F.col("d")).alias("duplicate_vectors"), "global_min", "global_max")  # one row each


def feature_stats(matrix: DataFrame, columns: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.median(c).alias("median"), (F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))).alias("iqr"), F.min(c).alias("min"), F.max(c).alias("max")) for c in columns]
    return matrix.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def validate(matrix: DataFrame, columns: list[str]) -> DataFrame:
    found = matrix_audit(matrix, columns).first()
    if not found.rows or found.nan_count or found.infinite_count:
        raise ValueError(f"matrix breaks its contract: {found}")
    return matrix


def scaling_audit(matrix: DataFrame, columns: list[str], name: str, kind: str) -> DataFrame:
    """matrix, feature, mean, sample deviation, median, IQR, expected_scaling and scale_status (PASS or REVIEW): robust
    has median 0 and IQR 1, standard has mean 0 and deviation 1. One value has deviation 0."""
    ok = (F.abs("median") < 1e-6) & (F.abs(F.col("iqr") - 1) < 0.10) if kind == "robust" else (F.abs("mean") < 0.10) & (F.abs(F.col("std") - 1) < 0.10)
    rows = []
    for c in columns:
        std = F.when(F.count(c) > 1, F.stddev_samp(c)).when(F.count(c) == 1, 0.0).alias("std")
        iqr = (F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))).alias("iqr")
        rows.append(F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), std, F.median(c).alias("median"), iqr))
    out = matrix.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return out.select(F.lit(name).alias("matrix"), "feature", "mean", "std", "median", "iqr", F.lit(kind).alias("expected_scaling"), F.when(ok, "PASS").otherwise("REVIEW").alias("scale_status"))


def vif(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation of each feature: diagonal of the inverse correlation matrix (k x k, k features, on the
    driver); infinite for a constant or fully explained feature."""
    import numpy as np

    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = matrix.agg(*[correlation(matrix, columns[i], columns[j]).alias(f"r{n}") for n, (i, j) in enumerate(pairs)]).first()
    r = np.full((k, k), np.nan)
    for n, (i, j) in enumerate(pairs):
        r[i, j] = r[j, i] = np.nan if found[n] is None else found[n]
    good = [i for i in range(k) if not np.isnan(r[i, i])]
    out = np.full(k, np.inf)
    for i in good:
        rest = [j for j in good if j != i]
        if not rest:
            out[i] = 1.0
            continue
        explained = float(r[i, rest] @ np.linalg.lstsq(r[np.ix_(rest, rest)], r[rest, i], rcond=None)[0])
        out[i] = 1.0 / (1.0 - explained) if explained < 1 - 1e-12 else np.inf
    spark = matrix.sparkSession
    return spark.createDataFrame([(c, float(v), bool(v > 5)) for c, v in zip(columns, out.tolist(), strict=True)], "feature string, vif double, high boolean").orderBy(F.desc("vif"), "feature")


def excluded_profile(df: DataFrame, categories: list[str], columns: list[str] = CORE) -> DataFrame:
    """Rows with and without a complete case for each value of each category."""
    out = None
    for c in categories:
        part = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>")).alias("value")).agg(F.count_if(complete(columns)).alias("eligible"), F.count_if(~complete(columns)).alias("excluded"))
        part = part.select(F.lit(c).alias("field"), "value", "eligible", "excluded", F.round(100.0 * F.col("excluded") / (F.col("eligible") + F.col("excluded")), 4).alias("excluded_percent"))
        out = part if out is None else out.unionByName(part)
    return out


def ratio_review(df: DataFrame, columns: list[str] = RATIOS) -> DataFrame:
    ps = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
    rows = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), *[F.round(F.percentile(F.col(c).cast("double"), F.lit(p)), 4).alias(n) for n, p in ps.items()]) for c in columns]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


#: Feature, axis, rationale and status of the feature dictionary.
DICTIONARY = [
    ("plan_cpu_mean", "Resource Requirement", "Primary CPU demand", "CORE"),
    ("plan_mem_mean", "Resource Requirement", "Primary memory demand", "CORE"),
    ("gpu_demand_scale", "Resource Requirement", "Log-scaled GPU allocation magnitude", "CORE"),
    ("gpu_utilization_intensity", "Utilization Behavior", "GPU compute intensity", "CORE"),
    ("gpu_memory_intensity", "Utilization Behavior", "GPU memory footprint", "CORE"),
    ("memory_intensity", "Utilization Behavior", "Host-memory intensity", "CORE"),
    ("cpu_usage_transformed", "Utilization Behavior", "CPU consumption", "CORE"),
    ("resource_efficiency_score", "Utilization Behavior", "GPU allocation-utilization relationship", "CORE"),
    ("cpu_gpu_imbalance", "Utilization Behavior", "Relative CPU-GPU utilization imbalance", "CORE"),
    ("io_intensity", "Utilization Behavior", "I/O activity per runtime", "CORE"),
    ("gpu_idle_ratio", "Utilization Behavior", "GPU idleness; redundant with transformed GPU utilization", "INTERPRETATION_ONLY"),
    ("runtime_log", "Execution Characteristics", "Execution duration", "CORE"),
    ("task_fanout", "Execution Characteristics", "Task/job fan-out", "CORE"),
    ("machine_count", "Execution Characteristics", "Machine execution footprint; redundant with task fan-out", "INTERPRETATION_ONLY"),
    ("job_name", "Identifier", "Job identifier; not behavioral", "EXCLUDED"),
    ("user", "Context", "Post-cluster analysis only", "EXCLUDED"),
    ("job_status", "Context", "Outcome validation only", "EXCLUDED"),
    ("has_telemetry", "Context", "Observability guardrail", "EXCLUDED"),
    ("telemetry_coverage", "Context", "Observability guardrail", "EXCLUDED"),
    ("has_gpu_request", "Context", "Availability guardrail", "EXCLUDED"),
    ("has_execution_timing", "Context", "Availability guardrail", "EXCLUDED"),
]


def feature_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "feature string, axis string, rationale string, status string")


#: Which features lack values for which reason (fixed groups); all others for the last.
REASONS = {
    "ratio of sources that are missing or zero": ["resource_efficiency_score", "cpu_gpu_imbalance"],
    "defined only for observed utilization within 0 to 100": ["gpu_idle_ratio"],
    "log of a measurement that is absent or invalid": ["gpu_utilization_intensity", "gpu_memory_intensity"],
    "execution metadata that the job lacks": ["runtime_log", "task_fanout", "machine_count"],
}
OTHER_REASON = "source quantity that is absent or not finite"


def provenance(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each feature: missing, infinite, zero and negative values, and the likely reason of missing ones."""
    reason = {f: r for r, fs in REASONS.items() for f in fs}
    rows = []
    for c in columns:
        x = F.col(c).cast("double")
        share = F.round(F.try_divide(100.0 * F.count_if(x.isNull()), F.count("*")), 4)
        rows.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count_if(x.isNull()).alias("missing_count"),
                share.alias("missing_percentage"),
                F.count_if(F.abs(x) == float("inf")).alias("inf_count"),
                F.count_if(x == 0).alias("zero_count"),
                F.count_if(x < 0).alias("negative_count"),
                F.lit(reason.get(c, OTHER_REASON)).alias("likely_reason"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def alignment(eligible: DataFrame, matrix: DataFrame, key: str) -> DataFrame:
    """One row: rows of the eligible population and of its matrix, keys that either lacks, keys that repeat, and whether the
    two are aligned."""
    left = eligible.groupBy(key).agg(F.count("*").alias("__l"))
    right = matrix.groupBy(key).agg(F.count("*").alias("__r"))
    both = left.join(right, key, "full")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = both.agg(
        zero("__l").alias("eligible_rows"),
        zero("__r").alias("matrix_rows"),
        F.count_if(F.col("__r").isNull()).alias("missing_in_matrix"),
        F.count_if(F.col("__l").isNull()).alias("unknown_in_matrix"),
        F.count_if((F.coalesce("__l", F.lit(1)) > 1) | (F.coalesce("__r", F.lit(1)) > 1)).alias("repeated_keys"),
    )
    return out.withColumn("aligned", (F.col("missing_in_matrix") == 0) & (F.col("unknown_in_matrix") == 0) & (F.col("repeated_keys") == 0))


def validate_alignment(eligible: DataFrame, matrix: DataFrame, key: str) -> DataFrame:
    found = alignment(eligible, matrix, key).first()
    if not found.aligned:
        raise ValueError(f"population and matrix are not aligned: {found}")
    return matrix


def decision_report(features: DataFrame, key: str, columns: list[str] = CORE) -> DataFrame:
    """check, result, status (PASS, REVIEW, FAIL) of the checks A to H before clustering, computed from the data."""
    spark, made = features.sparkSession, matrices(features, key, columns)
    robust, standard = made["robust"], made["standard"]
    audits = {name: matrix_audit(m, columns).first() for name, m in made.items()}
    broken = sum(a.nan_count + a.infinite_count for a in audits.values())
    lacking = provenance(features, columns).filter("missing_count > 0").count()
    wide = ratio_review(features).collect()  # one row for each ratio
    strong = correlation_pairs(robust, columns, 0.80).collect()  # at most pairs of features
    inflation = vif(robust, columns).collect()
    scales = scaling_audit(robust, columns, "hdbscan", "robust").unionByName(scaling_audit(standard, columns, "kmeans", "standard"))
    off = scales.filter("scale_status = 'REVIEW'").count()
    counts = case_counts(features, columns).first()
    repeated = audits["robust"].duplicate_vectors
    over = lambda least: sum(r.vif > least for r in inflation)
    review = lambda bad: "REVIEW" if bad else "PASS"
    rows = [
        ("A. NaN/Inf integrity", f"{broken} values not finite in matrices; {lacking} source features lack values", review(broken)),
        ("B. Ratio-feature validity", "; ".join(f"{r.feature}: {r.p01} to {r.p99} (1 % to 99 %)" for r in wide), "REVIEW"),
        ("C. Correlation redundancy", f"{len(strong)} pairs with |r| >= 0.80", review(strong)),
        ("D. VIF/multicollinearity", f"VIF > 5: {over(5)}; VIF > 10: {over(10)}", review(over(5))),
        ("E. Scaling", f"{off} features off their expected scaling", review(off)),
        ("F. Excluded-population composition", f"eligible {counts.complete}, excluded {counts.excluded}, {counts.complete_percent} %", "REVIEW"),
        ("G. Duplicate behavioral vectors", f"{repeated} repeated vectors", "PASS"),
        ("H. Temporal-shape support", "no feature of the job's course over time", "FAIL"),
    ]
    return spark.createDataFrame(rows, "check string, result string, status string")
