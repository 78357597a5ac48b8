"""Raw CSV and Parquet sources with their contract checks."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, null_tokens, numeric
from .schemas import COLUMNS, NUMBERS, raw_schema


def _first_line(spark: SparkSession, path: str) -> list[str] | None:
    rows = spark.read.text(path).limit(1).collect()
    return next(csv.reader(io.StringIO(rows[0].value)), []) if rows else None


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Names of a header file, stripped, without blank ones. An empty file raises."""
    names = [x.strip() for x in _first_line(spark, path) or [] if x.strip()]
    if not names:
        raise ValueError(f"header file {path} names no columns")
    return names


def read_first_row(spark: SparkSession, path: str) -> list[str]:
    row = _first_line(spark, path)
    if row is None:
        raise ValueError(f"{path} has no rows")
    return row


def validate_columns(table: str, names: list[str]) -> None:
    """Names must be the expected ones in the expected order."""
    if names != COLUMNS[table]:
        raise ValueError(f"{table}: columns {names} instead of {COLUMNS[table]}")


def validate_table(spark: SparkSession, table: str, csv_path: str, header_path: str) -> list[str]:
    """Names of a table whose header and first row keep the contract."""
    names = read_header(spark, header_path)
    validate_columns(table, names)
    width = len(read_first_row(spark, csv_path))
    if width != len(names):
        raise ValueError(f"{table}: rows have {width} fields, the header {len(names)}")
    return names


def validate_all(spark: SparkSession, folder: str, tables: Iterable[str] = tuple(COLUMNS)) -> dict[str, list[str]]:
    return {t: validate_table(spark, t, f"{folder}/{t}.csv", f"{folder}/{t}.header") for t in tables}


def read_raw(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The files as strings, with ``ordinal`` (file, start of the block, row of the task), so that ties between rows can be
    settled by position: files in order of name, blocks in order of place, rows in order within a block."""
    raw = spark.read.schema(raw_schema(table)).option("header", False).option("escape", '"').csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.withColumn("ordinal", place)


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The file with null tokens and blanks as null, text trimmed and numbers coerced."""
    return coerce(read_raw(spark, table, path), NUMBERS[table])


def coerce(df: DataFrame, numbers: Iterable[str]) -> DataFrame:
    """Text columns cleaned, those of ``numbers`` as doubles or null; other types stay."""
    kinds, numbers = dict(df.dtypes), set(numbers)
    return df.withColumns({c: numeric(null_tokens(F.col(c))) if c in numbers else clean_text(null_tokens(F.col(c))) for c in df.columns if kinds[c] == "string"})


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def read_derived(spark: SparkSession, path: str, names: Iterable[str] = ()) -> DataFrame:
    """A derived data set (Parquet, or CSV with a header) that must have the columns ``names``."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return require_columns(df, names)
