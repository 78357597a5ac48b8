"""Referential integrity: coverage of keys, containment, conflicts and uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def coverage(child: DataFrame, parent: DataFrame, keys: list[str], null_unmatched: bool = True) -> DataFrame:
    """One row: child rows, matched, unmatched (null keys never match, and count here only if ``null_unmatched``),
    null-key rows, percentage, status.

    The parent's different keys are one semi side: rows can't multiply, and the join stays an equi-join.
    """
    right = parent.select(*keys).dropna().distinct().withColumn("__hit", F.lit(1))
    joined = child.select(*keys).join(right, keys, "left")
    out = joined.agg(F.count("*").alias("total_rows"), F.count("__hit").alias("matched_rows"), F.count_if(~_known(keys)).alias("null_key_rows"))
    unmatched = F.col("total_rows") - F.col("matched_rows") - (F.lit(0) if null_unmatched else F.col("null_key_rows"))
    return out.withColumn("unmatched_rows", unmatched).select(
        "total_rows",
        "matched_rows",
        "unmatched_rows",
        "null_key_rows",
        F.round(F.try_divide(100.0 * F.col("matched_rows"), F.col("total_rows")), 4).alias("matched_percent"),
        F.when(F.col("unmatched_rows") == 0, "OK").otherwise("WARNING").alias("status"),
    )


def full_coverage(child: DataFrame, parent: DataFrame, keys: list[str], null_unmatched: bool = True) -> DataFrame:
    """One row: ``coverage`` of the child's rows and, beside it, how many different keys of the parent have a child."""
    keyed = distinct_coverage(parent, child, keys)
    share = F.round(F.try_divide(100.0 * F.col("common_keys"), F.col("left_keys")), 4)
    keyed = keyed.select(F.col("left_keys").alias("parent_keys"), F.col("common_keys").alias("parent_keys_matched"), share.alias("parent_percent"))
    return coverage(child, parent, keys, null_unmatched).crossJoin(keyed)  # one row each


def distinct_coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: different keys on each side, common, only left, only right. Keys with a null don't count."""
    a = left.select(*keys).dropna().distinct().withColumn("__a", F.lit(1))
    b = right.select(*keys).dropna().distinct().withColumn("__b", F.lit(1))
    both = a.join(b, keys, "full")
    return both.agg(
        F.count("__a").alias("left_keys"),
        F.count("__b").alias("right_keys"),
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("common_keys"),
        F.count_if(F.col("__b").isNull()).alias("left_only"),
        F.count_if(F.col("__a").isNull()).alias("right_only"),
    )


def common_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def containment(inner: DataFrame, outer: DataFrame, keys: list[str], member: str) -> DataFrame:
    """One row: keys of ``inner`` in both, and those that have a member which ``outer`` lacks for the same key."""
    pairs = inner.select(*keys, member).dropna().distinct()
    have = outer.select(*keys, member).dropna().distinct()
    lacking = pairs.join(have, [*keys, member], "left_anti").select(*keys).distinct().withColumn("__bad", F.lit(1))
    shared = pairs.select(*keys).distinct().join(have.select(*keys).distinct(), keys, "left_semi")
    return shared.join(lacking, keys, "left").agg(F.count("*").alias("shared_keys"), F.count("__bad").alias("keys_not_contained"))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one different value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    bad = df.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if bad:
        raise ValueError(f"keys {keys} are not unique")
    return df


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return assert_unique(left, keys).join(assert_unique(right, keys), keys, how)


def left_with_marker(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that keeps the row count and says in ``matched`` which rows found a partner."""
    return left.join(assert_unique(right, keys).withColumn("matched", F.lit(True)), keys, "left").fillna(False, ["matched"])
