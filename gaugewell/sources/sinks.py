"""Sinks: data sets, the audit table, text reports and models."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "stage string, metric string, value double"


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, order: Iterable[str] = ()) -> None:
    """A folder of CSV files with a header, in order of ``order``: the only place where a data set is sorted."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def audit(spark: SparkSession, rows: Iterable[tuple[str, str, float]]) -> DataFrame:
    """Rows (stage, metric, value); the values of one metric are summed by the caller, so each occurs once."""
    return spark.createDataFrame([(s, m, None if v is None else float(v)) for s, m, v in rows], AUDIT)


def append_audit(df: DataFrame, path: str) -> None:
    """Adds audit rows to those that earlier stages wrote."""
    df.select("stage", "metric", "value").write.mode("append").parquet(path)


def write_sets(sets: dict[str, DataFrame], folder: str, order: dict[str, Iterable[str]] | None = None) -> None:
    """Each named data set as a folder of CSV files with a header; Spark makes the folders."""
    for name, df in sets.items():
        write_csv(df, f"{folder}/{name}.csv", (order or {}).get(name, ()))


def report(spark: SparkSession, sections: Iterable[tuple[str, DataFrame]], path: str, width: int = 80, rows: int = 100) -> None:
    """A text report: a banner and the rows of each small table, written through Spark's file systems. Of a table with
    more than ``rows`` rows the report holds the first ones and says how many follow."""
    lines: list[str] = []
    for title, df in sections:
        lines += ["=" * width, title, "=" * width, "\t".join(df.columns)]
        lines += ["\t".join("" if v is None else str(v) for v in r) for r in df.limit(rows).collect()]
        if (more := df.count() - rows) > 0:
            lines.append(f"... and {more} more rows")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def issues(decisions: DataFrame) -> DataFrame:
    """The checks of a decision report that need a look (REVIEW) or can't be met (FAIL), gravest first."""
    rank = F.when(F.col("status") == "FAIL", 0).otherwise(1)
    return decisions.filter(F.col("status") != "PASS").orderBy(rank, "check").select("status", "check", "result")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    """A saved model of the class ``kind``."""
    return kind.load(path)
