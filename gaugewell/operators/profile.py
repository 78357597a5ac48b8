"""Profiles of tables: quality of raw rows, exploratory statistics, distributions and correlations.

One-pass statistics of all columns are one aggregate whose result is unpivoted, so a table is read once and not once
for each column. What needs bounds first (outliers, histograms) joins a one-row aggregate back.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BANDS, band, clip, outside, skew_class

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def _rows(df: DataFrame, structs: list[Column]) -> DataFrame:
    return df.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))


# -- quality of raw tables ------------------------------------------------------------------------------------------


def quality(df: DataFrame) -> DataFrame:
    """A row for each column: nulls and, of text columns, blanks (which count nulls too)."""
    kinds = dict(df.dtypes)
    blank = lambda c: F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "") if kinds[c] == "string" else F.lit(None).cast("long")
    return _rows(df, [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("null_count"), blank(c).alias("blank_count")) for c in df.columns])


def status_distribution(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(status))


_TIMES = {"start_time missing": "start_time is null", "end_time missing": "end_time is null", "end_before_start": "end_time < start_time"}
#: Range rules of each raw table: name -> SQL predicate of a violation (fixed rules).
RANGE_RULES = {
    "job": _TIMES,
    "task": {f"{c} < 0": f"{c} < 0" for c in ("inst_num", "plan_cpu", "plan_mem", "plan_gpu")},
    "instance": _TIMES,
    "sensor": {"gpu_wrk_util < 0": "gpu_wrk_util < 0", "gpu_wrk_util > 100": "gpu_wrk_util > 100"}
    | {f"{c} < 0": f"{c} < 0" for c in ("cpu_usage", "avg_mem", "max_mem", "avg_gpu_wrk_mem", "max_gpu_wrk_mem")},
    "machine_metric": _TIMES,
}
#: Fields of a task whose absence is counted by status (fixed list).
TASK_FIELDS = ["inst_num", "start_time", "end_time", "plan_cpu", "plan_mem", "plan_gpu", "gpu_type"]
#: Relationships that are drawn (fixed list of pairs).
RELATIONSHIPS = [
    ("plan_gpu_mean", "gpu_utilization_mean"),
    ("plan_cpu_mean", "gpu_utilization_mean"),
    ("plan_mem_mean", "gpu_utilization_mean"),
    ("task_runtime_hours_mean", "gpu_utilization_mean"),
    ("avg_gpu_mem_mean", "gpu_utilization_mean"),
    ("instance_runtime_hours_sum", "plan_gpu_mean"),
]


def range_violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """A row for each rule: rows that break it; missing values break none."""
    return _rows(df, [F.struct(F.lit(k).alias("rule"), F.count_if(F.expr(v)).alias("violations")) for k, v in rules.items()])


def nulls_by_status(df: DataFrame, columns: Iterable[str], status: str = "status", keep_missing: bool = False) -> DataFrame:
    """Nulls of columns by status, either without null statuses or with them as ``<MISSING>``, last."""
    rows = df.withColumn(status, F.coalesce(status, F.lit("<MISSING>"))) if keep_missing else df.filter(F.col(status).isNotNull())
    return rows.groupBy(status).agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]).orderBy(F.col(status) == "<MISSING>", status)


# -- exploratory statistics -----------------------------------------------------------------------------------------


def overview(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, columns, numeric and other columns, repeated rows and keys."""
    numbers = len(numeric_columns(df))
    distinct = df.distinct().agg(F.count("*").alias("d"))
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("k"), F.max(F.col(key).isNull().cast("int")).alias("nulls")).crossJoin(distinct).select(  # one row each
        F.col("n").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(numbers).alias("numeric_columns"),
        F.lit(len(df.columns) - numbers).alias("other_columns"),
        (F.col("n") - F.col("d")).alias("duplicate_rows"),
        (F.col("n") - F.col("k") - F.coalesce("nulls", F.lit(0))).alias("duplicate_keys"),
    )


def dtypes(df: DataFrame) -> DataFrame:
    """A row for each column: type, values, different values. Columns are counted one after another, each by a two-stage
    aggregate of its own values, as one aggregate of all would repeat every row for each column."""
    out = None
    for c, t in df.dtypes:
        values = df.select(F.col(c).alias("v")).groupBy("v").agg(F.count("v").alias("n"))
        one = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("non_null"), F.count("v").alias("distinct_values"))
        one = one.select(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), "non_null", "distinct_values")
        out = one if out is None else out.unionByName(one)
    return out


def missingness(df: DataFrame) -> DataFrame:
    n = F.count("*")
    rows = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("missing_count"), F.round(F.try_divide(100.0 * F.count_if(F.col(c).isNull()), n), 4).alias("missing_percent")) for c in df.columns]
    return _rows(df, rows).orderBy(F.desc("missing_count"), "column_name")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max, missing and zeros of each numeric column."""
    rows = []
    for c in columns or numeric_columns(df):
        x = F.col(c).cast("double")
        q = [F.round(F.percentile(x, F.lit(p)), 4).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"), F.round(F.min(x), 4).alias("min"), *q, F.round(F.max(x), 4).alias("max"), F.count_if(x.isNull()).alias("missing"), F.count_if(x == 0).alias("zeros")))
    return _rows(df, rows)


def bias_corrected_skewness(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when((n >= 4) & (F.stddev_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def skew_kurtosis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    rows = []
    for c in columns or numeric_columns(df):
        x = F.col(c).cast("double")
        rows.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), bias_corrected_skewness(x).alias("s"), bias_corrected_kurtosis(x).alias("k")))
    return _rows(df, rows).select("column_name", "n", F.round("s", 3).alias("skewness"), F.round("k", 3).alias("kurtosis"), skew_class(F.col("s")).alias("skew_class"))


def iqr_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Tukey's fences of each column and how many values are outside. Bounds are one row, joined back for the count."""
    names = columns or numeric_columns(df)
    bounds = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.75))).alias(f"__{c}") for c in names])
    rows = []
    for c in names:
        q1, q3, x = F.col(f"__{c}")[0], F.col(f"__{c}")[1], F.col(c).cast("double")
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        out = F.count_if((x < low) | (x > high))
        rows.append(F.struct(F.lit(c).alias("column_name"), F.round(F.max(low), 4).alias("lower_bound"), F.round(F.max(high), 4).alias("upper_bound"), F.count(x).alias("n"), out.alias("outliers"), F.round(F.try_divide(100.0 * out, F.count(x)), 4).alias("outlier_percent")))
    return _rows(df.select(*names).crossJoin(F.broadcast(bounds)), rows)  # bounds: one row


def feature_quality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missingness, moments, shape and outliers of each column in one table."""
    names = columns or numeric_columns(df)
    n = missingness(df.select(*names))
    parts = [describe(df, names).drop("missing"), skew_kurtosis(df, names).drop("n"), iqr_outliers(df, names).drop("n")]
    for part in parts:
        n = n.join(part, "column_name")
    return n


def correlation(df: DataFrame, x: str, y: str) -> Column:
    """Pearson's r of complete pairs; null for a constant column, where the built-in raises."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation_pairs(df: DataFrame, columns: list[str], least: float | None = None, both: bool = False) -> DataFrame:
    """Upper triangle (or both directions) of the correlation matrix, strongest first."""
    rows = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), correlation(df, a, b).alias("r")) for a, b in combinations(columns, 2)]
    out = _rows(df, rows).select("x", "y", F.round("r", 4).alias("r"))
    if both:
        out = out.unionByName(out.select(F.col("y").alias("x"), F.col("x").alias("y"), "r"))
    out = out.filter(F.abs("r") >= least) if least is not None else out
    return out.orderBy(F.desc_nulls_last(F.abs("r")), "x", "y")


def top_categories(df: DataFrame, columns: list[str], k: int = 15) -> DataFrame:
    """The k most frequent values of each column, nulls included, with percentages."""
    total = F.broadcast(df.agg(F.count("*").alias("total")))  # one row
    out = None
    for c in columns:
        top = df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)
        part = top.crossJoin(total).select(F.lit(c).alias("column_name"), "value", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))
        out = part if out is None else out.unionByName(part)
    return out


def band_table(df: DataFrame, column: str, bands=BANDS) -> DataFrame:
    """Rows in each band, empty bands with 0; percentages of all rows, missing values included."""
    x = band(F.col(column), bands)
    rows = [F.struct(F.lit(i).alias("band_order"), F.lit(label).alias("band"), F.count_if(x == label).alias("n"), F.round(F.try_divide(100.0 * F.count_if(x == label), F.count("*")), 4).alias("percent")) for i, (_, label) in enumerate(bands)]
    return _rows(df, rows)


def histogram(df: DataFrame, column: str, bins: int = 50, log: bool = False) -> DataFrame:
    """bin, low, n of equal-width bins from the least to the largest value; the last bin is closed. With ``log``
    values are log1p of the non-negative ones."""
    x = F.col(column).cast("double")
    values = df.select((F.when(x >= 0, F.log1p(x)) if log else x).alias("x")).filter("x is not null")
    bounds = F.broadcast(values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    found = values.crossJoin(bounds).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.max(F.col("lo") + place * width), 4).alias("low"))
    return found.select("bin", "low", "n").orderBy("bin")


def boxplot(df: DataFrame, columns: list[str]) -> DataFrame:
    q = lambda c: F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.round(q(c)[i], 4).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))]) for c in columns]
    return _rows(df, rows)


def scatter_pairs(df: DataFrame, key: str, rows: int, pairs: list[tuple[str, str]] = RELATIONSHIPS) -> DataFrame:
    """x_column, y_column, key, x, y of one sample of the table for every pair, without rows that lack either value."""
    from .sampling import hash_sample

    point = lambda x, y: F.struct(F.lit(x).alias("x_column"), F.lit(y).alias("y_column"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sample = hash_sample(df, key, rows)
    return sample.select(key, F.inline(F.array(*[point(x, y) for x, y in pairs]))).filter("x is not null and y is not null")


def telemetry_stats(df: DataFrame) -> DataFrame:
    """Statistics of the coverage, clipped to [0, 1]."""
    return describe(df.select(clip(F.col("telemetry_coverage"), 0.0, 1.0).alias("telemetry_coverage")))


def runtime_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) >= 0))


def outlier_flags(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("out_of_range", outside(F.col(column)))
