"""Workload tags against clusters: tags of jobs, crosstab, enrichment, dominant tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import tag
from .integrity import left_with_marker


def job_tags(instances: DataFrame, groups: DataFrame) -> DataFrame:
    """job_name, workload: the largest valid tag of a job's instances; tags without meaning are dropped."""
    tags = groups.groupBy("inst_id").agg(F.max("workload").alias("workload"))
    joined = instances.select("job_name", "inst_id").dropna().distinct().join(tags, "inst_id")
    return joined.groupBy("job_name").agg(F.max(tag(F.col("workload"))).alias("workload"))


def tagged_assignments(assignments: DataFrame, tags: DataFrame) -> DataFrame:
    """Every assignment with its tag and whether it has a row of tags; the row count stays."""
    return left_with_marker(assignments, tags, ["job_name"])


def tag_coverage(tagged: DataFrame) -> DataFrame:
    return tagged.agg(
        F.count("*").alias("jobs"),
        F.count("workload").alias("tagged_jobs"),
        F.round(F.try_divide(100.0 * F.count("workload"), F.count("*")), 4).alias("tagged_percent"),
        F.count_if(F.col("workload").isNotNull() & (F.col("cluster_id") != -1)).alias("tagged_clustered_jobs"),
        F.count_distinct("workload").alias("tags"),
    )


def crosstab(tagged: DataFrame, clusters: list[int] | None = None) -> DataFrame:
    return tagged.filter("workload is not null and cluster_id <> -1").groupBy("workload").pivot("cluster_id", clusters).count().na.fill(0)


def enrichment(tagged: DataFrame) -> DataFrame:
    """Every tag with every cluster, zero cells too: counts, shares and observed over expected.

    Both sides of the grid are small by nature: tags are a vocabulary, clusters a model's.
    """
    rows = tagged.filter("workload is not null and cluster_id <> -1").groupBy("workload", "cluster_id").agg(F.count("*").alias("n"))
    grid = rows.select("workload").distinct().crossJoin(rows.select("cluster_id").distinct()).join(rows, ["workload", "cluster_id"], "left").fillna(0, ["n"])
    t = F.sum("n").over(W.partitionBy("workload"))
    c = F.sum("n").over(W.partitionBy("cluster_id"))
    total = rows.agg(F.sum("n").alias("total"))
    sums = grid.withColumns({"tag_total": t, "cluster_tagged_total": c}).crossJoin(F.broadcast(total))  # one row
    n = F.col("n")
    return sums.select(
        F.col("workload").alias("workload_tag"),
        "cluster_id",
        n.alias("tag_count_in_cluster"),
        "tag_total",
        "cluster_tagged_total",
        F.round(F.try_divide(100.0 * n, F.col("tag_total")), 4).alias("tag_within_cluster_percent"),
        F.round(F.try_divide(100.0 * n, F.col("cluster_tagged_total")), 4).alias("cluster_within_tag_percent"),
        F.round(F.try_divide(n * F.col("total"), F.col("tag_total") * F.col("cluster_tagged_total")), 4).alias("enrichment_ratio"),
    )


def dominant_tags(tagged: DataFrame) -> DataFrame:
    """Each cluster's most frequent tag (ties: first by name), its count and share, and the number of its tags."""
    rows = tagged.filter("workload is not null and cluster_id <> -1").groupBy("cluster_id", "workload").agg(F.count("*").alias("n"))
    w = W.partitionBy("cluster_id")
    out = rows.withColumns({"nth": F.row_number().over(w.orderBy(F.desc("n"), "workload")), "tagged": F.sum("n").over(w), "tags": F.count("*").over(w)})
    return out.filter("nth = 1").select("cluster_id", F.col("workload").alias("dominant_tag"), F.col("n").alias("dominant_count"), F.col("tagged").alias("tagged_jobs"), F.round(100.0 * F.col("n") / F.col("tagged"), 4).alias("dominant_percent"), F.col("tags").alias("number_of_workload_tags"))
