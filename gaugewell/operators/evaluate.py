"""Cluster structure, profiles, quality metrics and agreement of labelings."""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cluster_name
from .sampling import hash_sample

#: Rows of the pairwise metrics (silhouette and DBCV), which need all distances of their sample.
SECONDARY_CAP, DBCV_CAP = 20_000, 5_000


def structure(assignments: DataFrame) -> DataFrame:
    """One row: clusters, noise, sizes, clusters under 1 % of all rows; fractions of all and of non-noise rows."""
    sizes = assignments.groupBy("cluster_id").agg(F.count("*").alias("n"))
    real = F.col("cluster_id") != -1
    size = F.when(real, F.col("n"))
    total = F.sum("n")
    tiny = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("total")))).filter(real).agg(F.count_if(F.col("n") < 0.01 * F.col("total")).alias("number_of_clusters_below_1_percent"))  # one row
    one = sizes.agg(
        total.alias("rows"),
        F.count(size).alias("cluster_count"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("noise_count"),
        F.round(F.try_divide(F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).cast("double"), total), 4).alias("noise_fraction"),
        F.max(size).alias("largest_cluster_size"),
        F.min(size).alias("smallest_cluster_size"),
        F.median(size).alias("median_cluster_size"),
        F.round(F.try_divide(F.max(size).cast("double"), total), 4).alias("largest_cluster_fraction"),
        F.round(F.try_divide(F.max(size).cast("double"), F.sum(size)), 4).alias("largest_cluster_fraction_non_noise"),
    )
    return one.crossJoin(tiny)


def cluster_summary(assignments: DataFrame) -> DataFrame:
    total = F.sum(F.count("*")).over(W.partitionBy())  # over clusters
    return assignments.groupBy("cluster_id").agg(F.count("*").alias("job_count"), F.round(100.0 * F.count("*") / total, 4).alias("percentage"), F.round(F.avg("cluster_probability"), 4).alias("mean_probability")).withColumn("cluster_name", cluster_name(F.col("cluster_id")))


def average_rank_pct(column: str):
    """Rank of the value among all rows as a share, ties at their mean rank; null for a missing value."""
    w = W.orderBy(column)
    ties = F.count("*").over(W.partitionBy(column))
    known = F.count(column).over(W.partitionBy())
    missing = F.count("*").over(W.partitionBy()) - known  # nulls come first in the order
    return F.when(F.col(column).isNotNull(), (F.rank().over(w) - missing + (ties - 1) / 2) / known)


def cluster_profiles(rows: DataFrame, columns: list[str], ranked: list[str] = ()) -> DataFrame:
    """Means and medians of each cluster without noise (percentages of all rows), and ranks of chosen means."""
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    stats = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("median", F.median))]
    out = rows.filter("cluster_id <> -1").groupBy("cluster_id").agg(F.count("*").alias("job_count"), F.avg("cluster_probability").alias("mean_probability"), *stats)
    out = out.crossJoin(total).withColumn("percentage", F.round(100.0 * F.col("job_count") / F.col("total"), 4)).drop("total")
    return out.withColumns({f"{c}_rank": F.round(average_rank_pct(f"{c}_mean"), 4) for c in ranked})


def profile_z_scores(profiles: DataFrame, columns: list[str]) -> DataFrame:
    one = F.broadcast(profiles.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"__{c}") for c in columns]))  # one row
    return profiles.crossJoin(one).select("cluster_id", *[F.round((F.col(c) - F.col(f"__{c}.m")) / F.when(F.col(f"__{c}.s") == 0, 1.0).otherwise(F.col(f"__{c}.s")), 4).alias(c) for c in columns])


def davies_bouldin(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row; null under two clusters. Centroids meet in a clusters x clusters join, both sides a model's."""
    centers = rows.groupBy("cluster_id").agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    gap = lambda a, b: F.sqrt(sum(((F.col(a(c)) - F.col(b(c))) ** 2 for c in columns), F.lit(0.0)))
    near = rows.join(F.broadcast(centers), "cluster_id").groupBy("cluster_id").agg(F.avg(gap(lambda c: c, lambda c: f"__{c}")).alias("s"), *[F.first(f"__{c}").alias(f"__{c}") for c in columns])
    other = near.select(F.col("cluster_id").alias("o"), F.col("s").alias("so"), *[F.col(f"__{c}").alias(f"o_{c}") for c in columns])
    ratio = F.try_divide(F.col("s") + F.col("so"), gap(lambda c: f"__{c}", lambda c: f"o_{c}"))
    worst = near.crossJoin(other).filter("cluster_id <> o").groupBy("cluster_id").agg(F.max(F.coalesce(ratio, F.lit(0.0))).alias("worst"))
    return worst.agg(F.round(F.avg("worst"), 4).alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row; null under two clusters."""
    sums = rows.groupBy("cluster_id").agg(F.count("*").alias("n"), *[F.struct(F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(f"__{c}") for c in columns])
    whole = F.broadcast(rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns]))  # one row
    between = sum((F.col("n") * (F.col(f"__{c}.m") - F.col(f"m_{c}")) ** 2 for c in columns), F.lit(0.0))
    within = sum((F.col("n") * F.col(f"__{c}.v") for c in columns), F.lit(0.0))
    one = sums.crossJoin(whole).agg(F.sum(between).alias("b"), F.sum(within).alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    value = F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1))
    return one.select(F.when(F.col("k") >= 2, F.round(value, 4)).alias("calinski_harabasz"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))


def silhouette_of(x: np.ndarray, labels: np.ndarray) -> float | None:
    names, index = np.unique(labels, return_inverse=True)
    if len(names) < 2 or len(x) < 3:
        return None
    sizes = np.bincount(index)
    onehot = np.eye(len(names))[index]
    total = 0.0
    for low in range(0, len(x), 1024):
        sums = _distances(x[low : low + 1024], x) @ onehot
        own = index[low : low + 1024]
        at = np.arange(len(own))
        a = sums[at, own] / np.maximum(sizes[own] - 1, 1)
        means = sums / sizes
        means[at, own] = np.inf
        b = means.min(1)
        s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
        total += s.sum()
    return float(total / len(x))


def davies_bouldin_of(x: np.ndarray, labels: np.ndarray) -> float | None:
    """``davies_bouldin`` of rows that the driver holds, not rounded."""
    names, index = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return None
    centers = np.array([x[index == i].mean(0) for i in range(len(names))])
    s = np.bincount(index, np.sqrt(((x - centers[index]) ** 2).sum(1))) / np.bincount(index)
    gap = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2))
    ratio = np.divide(s[:, None] + s, gap, out=np.zeros_like(gap), where=gap > 0)
    np.fill_diagonal(ratio, 0.0)
    return float(ratio.max(1).mean())


def calinski_harabasz_of(x: np.ndarray, labels: np.ndarray) -> float | None:
    """``calinski_harabasz`` of rows that the driver holds, not rounded."""
    names, index = np.unique(labels, return_inverse=True)
    n, k = len(x), len(names)
    if k < 2:
        return None
    centers = np.array([x[index == i].mean(0) for i in range(k)])
    between = float((np.bincount(index) * ((centers - x.mean(0)) ** 2).sum(1)).sum())
    within = float(((x - centers[index]) ** 2).sum())
    return between * (n - k) / (within * (k - 1)) if within else None


def dbcv_of(x: np.ndarray, labels: np.ndarray) -> float | None:
    """Density-based validity (Moulavi et al., 2014) with all-points core distances; noise weighs the mean down."""
    names = [c for c in np.unique(labels) if c != -1]
    if len(names) < 2:
        return None
    d = x.shape[1]
    groups = [np.flatnonzero(labels == c) for c in names]
    core, sparse, inner = np.zeros(len(x)), [], []
    for g in groups:
        dist = _distances(x[g], x[g])
        np.fill_diagonal(dist, np.inf)
        with np.errstate(divide="ignore"):
            mean = np.where(dist > 0, 1 / dist, 0) ** d
        core[g] = (mean.sum(1) / max(len(g) - 1, 1) + 1e-300) ** (-1 / d)
        reach = np.maximum(dist, np.maximum(core[g][:, None], core[g][None]))
        edges = minimum_spanning_tree(reach)
        degree = np.bincount(edges[:, :2].astype(int).ravel(), minlength=len(g))
        inside = degree > 1
        both = inside[edges[:, 0].astype(int)] & inside[edges[:, 1].astype(int)] if len(edges) else np.zeros(0, bool)
        sparse.append(edges[both, 2].max() if both.any() else edges[:, 2].max() if len(edges) else 0.0)
        inner.append(g[inside] if inside.any() else g)
    value = 0.0
    for i, g in enumerate(groups):
        apart = min(np.maximum(_distances(x[inner[i]], x[inner[j]]), np.maximum(core[inner[i]][:, None], core[inner[j]][None])).min() for j in range(len(groups)) if j != i)
        value += len(g) / len(x) * (apart - sparse[i]) / max(apart, sparse[i], 1e-300)
    return float(value)


def minimum_spanning_tree(weights: np.ndarray) -> np.ndarray:
    """Prim's algorithm over a full matrix: rows (from, to, weight)."""
    n = len(weights)
    best, source, done, out = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), []
    at = 0
    for _ in range(n - 1):
        done[at] = True
        closer = (weights[at] < best) & ~done
        best[closer], source[closer] = weights[at][closer], at
        at = int(np.where(done, np.inf, best).argmin())
        out.append((source[at], at, best[at]))
    return np.array(out, float).reshape(-1, 3)


def _sampled(rows: DataFrame, columns: list[str], key: str, cap: int) -> tuple[np.ndarray, np.ndarray]:
    table = hash_sample(rows.select(key, "cluster_id", *columns), key, cap).toPandas()  # at most ``cap`` rows
    return table[columns].to_numpy(float), table["cluster_id"].to_numpy()


def metrics(rows: DataFrame, columns: list[str], key: str, secondary_cap: int = SECONDARY_CAP, dbcv_cap: int = DBCV_CAP) -> dict:
    """Silhouette, Davies-Bouldin, Calinski-Harabasz of non-noise rows and DBCV of all; None under two clusters.

    The pairwise two use a hash sample of bounded size; the others all rows.
    """
    real = rows.filter("cluster_id <> -1")
    x, labels = _sampled(real, columns, key, secondary_cap)
    enough = len(np.unique(labels)) >= 2 and len(x) >= 3
    out = {"silhouette": silhouette_of(x, labels) if enough else None, "davies_bouldin": None, "calinski_harabasz": None, "dbcv": None, "dbcv_status": "NOT_ENOUGH_CLUSTERS"}
    if enough:
        out["davies_bouldin"] = davies_bouldin(real, columns).first()[0]
        out["calinski_harabasz"] = calinski_harabasz(real, columns).first()[0]
        try:
            out["dbcv"], out["dbcv_status"] = dbcv_of(*_sampled(rows, columns, key, dbcv_cap)), "OK"
        except (ValueError, FloatingPointError) as e:
            out["dbcv_status"] = f"ERROR: {e}"
    return out


def contingency(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows that are in a cluster on both sides, by pair of clusters."""
    left = a.filter("cluster_id <> -1").select(key, F.col("cluster_id").alias("a"))
    right = b.filter("cluster_id <> -1").select(key, F.col("cluster_id").alias("b"))
    return left.join(right, key).groupBy("a", "b").agg(F.count("*").alias("n"))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """One row: rows compared and the adjusted Rand index, by sums over the contingency table."""
    two = lambda c: c * (c - 1) / 2.0
    cells = pairs.agg(F.sum(two(F.col("n"))).alias("cells"), F.sum("n").alias("n"))
    rows = pairs.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("rows"))
    cols = pairs.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("cols"))
    expected = F.try_divide(F.col("rows") * F.col("cols"), two(F.col("n")))
    most = (F.col("rows") + F.col("cols")) / 2
    index = F.when(most == expected, 1.0).otherwise(F.try_divide(F.col("cells") - expected, most - expected))
    return cells.crossJoin(rows).crossJoin(cols).select(F.col("n").alias("comparison_rows"), F.round(index, 4).alias("ari"))  # one row each


def adjusted_mutual_information(table: np.ndarray) -> float:
    """AMI (arithmetic mean) of a contingency table of clusters x clusters."""
    n = int(table.sum())
    a, b = table.sum(1), table.sum(0)
    if len(a) == len(b) == 1 or n == 0:
        return 1.0
    nz = table[table > 0] / n
    pi, pj = np.nonzero(table)
    mi = float((nz * np.log(nz / (a[pi] / n * b[pj] / n))).sum())
    ent = lambda c: -sum(x / n * log(x / n) for x in c.tolist() if x)
    emi = 0.0
    for x in a.tolist():
        for y in b.tolist():
            for k in range(max(1, x + y - n), min(x, y) + 1):
                p = lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1)
                emi += k / n * log(n * k / (x * y)) * exp(p)
    mean = (ent(a) + ent(b)) / 2
    return (mi - emi) / (mean - emi) if abs(mean - emi) > 1e-15 else 1.0


def agreement(a: DataFrame, b: DataFrame, key: str, least_rows: int = 1000) -> dict:
    """ari, ami, comparison_rows, error: an error instead of values if too few rows or labels can be compared."""
    pairs = contingency(a, b, key)
    cells = pairs.collect()  # clusters x clusters
    rows = sum(r.n for r in cells)
    if rows < least_rows or len({r.a for r in cells}) < 2 or len({r.b for r in cells}) < 2:
        return {"ari": None, "ami": None, "comparison_rows": rows, "error": "too few rows or labels to compare"}
    ia, ib = sorted({r.a for r in cells}), sorted({r.b for r in cells})
    table = np.zeros((len(ia), len(ib)), np.int64)
    for r in cells:
        table[ia.index(r.a), ib.index(r.b)] = r.n
    return {"ari": adjusted_rand(pairs).first().ari, "ami": adjusted_mutual_information(table), "comparison_rows": rows, "error": None}


def adjusted_rand_of(table: np.ndarray) -> float:
    """``adjusted_rand`` of a contingency table of clusters x clusters, not rounded."""
    two = lambda v: float((v * (v - 1) / 2.0).sum())
    n = int(table.sum())
    cells, rows, cols = two(table), two(table.sum(1)), two(table.sum(0))
    expected, most = rows * cols / (n * (n - 1) / 2.0), (rows + cols) / 2
    return 1.0 if most == expected else (cells - expected) / (most - expected)


def agreement_of(a: np.ndarray, b: np.ndarray, least_rows: int = 1000) -> dict:
    """``agreement`` of two labelings of the same rows, noise left out, that the driver holds."""
    (na, ia), (nb, ib) = (np.unique(v, return_inverse=True) for v in (a, b))
    if len(a) < least_rows or len(na) < 2 or len(nb) < 2:
        return {"ari": None, "ami": None, "comparison_rows": len(a), "error": "too few rows or labels to compare"}
    table = np.zeros((len(na), len(nb)), np.int64)
    np.add.at(table, (ia, ib), 1)
    return {"ari": round(adjusted_rand_of(table), 4), "ami": adjusted_mutual_information(table), "comparison_rows": len(a), "error": None}


def stability_summary(detail: DataFrame, columns: list[str] = ("ari", "ami", "cluster_count", "noise_fraction")) -> DataFrame:
    """mean, median, std, min, max and mode (least of the most frequent) of each measure."""
    rows = []
    for c in columns:
        x = F.col(c).cast("double")
        rows.append(F.struct(F.lit(c).alias("measure"), F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.median(x), 4).alias("median"), F.round(F.stddev_samp(x), 4).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.mode(x, True).alias("mode")))
    return detail.filter("error is null").agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
