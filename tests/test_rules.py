"""Edge rows of every rule, sources and sinks, gates, and the models on closed-form cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewell.functions import scalars as S
from gaugewell.operators import clean, cluster, evaluate, features, integrity, prepare, profile, sampling, selection, semantic, summaries
from gaugewell.sources import readers, sinks
from gaugewell.sources.schemas import COLUMNS
from gaugewell.streaming import events


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(expression(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_text_and_numbers(spark):
    assert column(spark, [" x ", "", "nan", "None", "\tt\t", None], S.clean_text) == ["x", None, None, None, "t", None]
    assert column(spark, ["abc", "3d", "1e3", " 2.5 ", "-4", "nan", None, "Infinity"], S.numeric) == [None, None, 1000.0, 2.5, -4.0, None, None, None]
    assert column(spark, ["NA", " NA ", "unknown", "N/A"], S.null_tokens) == [None, " NA ", "unknown", None]
    assert column(spark, ["Unknown", " gpt ", "N/A", "NaN", None], S.tag) == [None, "gpt", None, None, None]


def test_ranges(spark):
    assert column(spark, [-1.0, 0.0, 2.0, None], S.non_negative, "double") == [None, 0.0, 2.0, None]
    assert column(spark, [-1.0, 0.0, 100.0, 100.1, None], S.outside, "double") == [True, False, False, True, False]
    assert column(spark, [-0.5, 0.0, None], S.safe_log1p, "double") == [None, 0.0, None]
    assert column(spark, [10.0, 30.0, 70.0, 70.1, None], S.band, "double") == ["Very Low (<10)", "Low (10-30)", "Medium (30-70)", "High (>70)", None]
    assert column(spark, [-1.0, 5.0, None], lambda c: S.clip(c, 0.0, 1.0), "double") == [0.0, 1.0, None]
    assert column(spark, [0.0, 2.0, None], lambda c: S.safe_ratio(F.lit(1.0), c), "double") == [None, 0.5, None]
    assert column(spark, [-1, 3], S.cluster_name, "int") == ["NOISE", "CLUSTER_3"]


def test_coverage_is_capped(spark):
    df = spark.createDataFrame([(3, 2), (1, 2), (None, 2), (1, 0)], "t int, n int")
    assert [r[0] for r in df.select(S.coverage_ratio(F.col("t"), F.col("n"))).collect()] == [1.0, 0.5, 0.0, 0.0]


def test_latest_row_of_a_key(spark):
    rows = [("a", 1.0, 5.0, 1), ("a", 1.0, 5.0, 2), ("a", 1.0, None, 3), ("b", 7.0, None, 1), ("b", None, None, 2)]
    df = spark.createDataFrame(rows, "job_name string, start_time double, end_time double, ordinal long")
    assert sorted((r.job_name, r.ordinal) for r in clean.dedup_latest(df, ["job_name"], ["ordinal"]).collect()) == [("a", 2), ("b", 1)]


def test_sensor_sums_are_zero_and_means_missing(spark):
    cols = "job_name string, task_name string, inst_id string, gpu_name string, gpu_wrk_util double, " + ", ".join(f"{c} double" for c in clean.SENSOR_QUANTITIES)
    df = spark.createDataFrame([("j", "t", "i", None, 101.0, *[None] * 9), ("j", "t", None, None, 1.0, *[1.0] * 9)], cols)
    row = clean.sensor_rows(clean.clean_sensors(df), ["job_name", "task_name", "inst_id"]).collect()
    assert len(row) == 1 and row[0].read_sum == 0.0 and row[0].avg_mem is None and row[0].util_sum is None and row[0].util_outliers == 1


def test_raw_files(spark, tmp_path):
    (tmp_path / "job.csv").write_text('j1, i1 ,u,Terminated,5,3d\nj2,,nan,Failed,abc,7\n')
    (tmp_path / "job.header").write_text(", ".join(COLUMNS["job"]) + ",\n")
    assert readers.validate_all(spark, str(tmp_path), ["job"]) == {"job": COLUMNS["job"]}
    rows = readers.read_table(spark, "job", str(tmp_path / "job.csv")).orderBy("job_name").collect()
    assert (rows[0].inst_id, rows[0].start_time, rows[0].end_time) == ("i1", 5.0, None)
    assert (rows[1].inst_id, rows[1].user, rows[1].start_time, rows[1].end_time) == (None, None, None, 7.0)
    (tmp_path / "job.header").write_text("job_name,user\n")
    with pytest.raises(ValueError):
        readers.validate_table(spark, "job", str(tmp_path / "job.csv"), str(tmp_path / "job.header"))
    with pytest.raises(ValueError):
        readers.require_columns(spark.range(1), ["x"])


def test_order_of_files(spark, tmp_path):
    """A small first file may be read by a later task than a large second one; its rows still come first."""
    folder = tmp_path / "job"
    folder.mkdir()
    (folder / "a.csv").write_text("j0,i,u,S,1,2\nj1,i,u,S,1,2\n")
    (folder / "b.csv").write_text("".join(f"k{i:05d},i,u,S,1,2\n" for i in range(3000)))
    names = [r.job_name for r in readers.read_raw(spark, "job", str(folder)).orderBy("ordinal").collect()]
    assert names == ["j0", "j1", *(f"k{i:05d}" for i in range(3000))]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, x string")
    sinks.write_csv(df, str(tmp_path / "c.csv"), ["id"])
    assert [r.x for r in readers.read_derived(spark, str(tmp_path / "c.csv"), ["id", "x"]).orderBy("id").collect()] == ["a", "b"]
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert readers.read_derived(spark, str(tmp_path / "p")).count() == 2
    sinks.report(spark, [("T", df)], str(tmp_path / "r"))
    assert "T" in [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert sinks.audit(spark, [("s", "m", 1)]).first().value == 1.0


def test_integrity(spark):
    child = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    parent = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    r = integrity.coverage(child, parent, ["k"]).first()
    assert (r.total_rows, r.matched_rows, r.unmatched_rows, r.null_key_rows, r.status) == (3, 1, 2, 1, "WARNING")
    with pytest.raises(ValueError):
        integrity.assert_unique(parent.dropna(), ["k"])
    assert integrity.left_with_marker(child, parent.dropna().distinct(), ["k"]).filter("matched").count() == 1


def test_features_keep_missing_missing(spark):
    names = "plan_gpu_mean plan_cpu_mean gpu_utilization_mean avg_gpu_mem_mean avg_mem_mean cpu_usage_mean total_read total_write instance_runtime_hours_sum".split()
    schema = "job_name string, has_telemetry int, task_count long, machine_count long, " + ", ".join(f"{n} double" for n in names)
    rows = [("idle", 1, 2, 1, 50.0, 4.0, 0.0, 1.0, 1.0, 2.0, 5.0, 5.0, 1.0), ("dark", 0, 1, 1, 0.0, 4.0, None, None, None, None, None, None, 0.0), ("odd", 1, 1, 1, 1.0, 1.0, 50.0, 1.0, 1.0, 1.0, -5.0, 1.0, 1.0)]
    out = {r.job_name: r for r in features.engineer(spark.createDataFrame(rows, schema)).collect()}
    assert out["idle"].gpu_active_flag == 0 and out["dark"].gpu_active_flag is None
    assert out["dark"].resource_efficiency_score is None and out["dark"].io_intensity is None and out["odd"].io_intensity is None
    assert abs(out["odd"].resource_efficiency_score - 50.0) < 1e-9 and out["dark"].runtime_log == 0.0
    bad = spark.createDataFrame(rows, schema)
    assert features.validate(features.engineer(bad)).count() == 3


def test_constant_column(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(10)], "k int, c double, x double")
    assert profile.correlation_pairs(df, ["c", "x"]).first().r is None
    assert {r.feature: r.vif for r in prepare.vif(df, ["c", "x"]).collect()} == {"c": math.inf, "x": 1.0}
    assert {r.c for r in prepare.robust_scaled(df, ["c", "x"]).collect()} == {0.0}
    assert {r.c for r in prepare.standard_scaled(df, ["c", "x"]).collect()} == {0.0}
    with pytest.raises(ValueError):
        prepare.validate(df.limit(0), ["c", "x"])


def test_samples_are_stable_and_exact(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 900, "a").otherwise("b"))
    one = sorted(r.id for r in sampling.hash_sample(df, "id", 50).collect())
    assert one == sorted(r.id for r in sampling.hash_sample(df.repartition(7), "id", 50).collect()) and len(one) == 50
    counts = {r.s: r["count"] for r in sampling.stratified_sample(df, "id", ["s"], 101).groupBy("s").count().collect()}
    assert counts == {"a": 91, "b": 10} or counts == {"a": 90, "b": 11} or sum(counts.values()) == 101
    assert 700 < sampling.share_sample(df, "id", 0.8).count() < 900


FIT = "region string, min_cluster_size int, min_samples int, cluster_count long, noise_fraction double, dbcv double, error string"


def flags(spark, rows):
    found = selection.neighbour_flags(spark.createDataFrame(rows, FIT)).orderBy("min_samples").collect()
    return [(r.plateau_flag, r.spike_flag, r.comparison_status, r.edge_config) for r in found]


def test_neighbour_flags(spark):
    unknown = ("INDETERMINATE", "INDETERMINATE", "INDETERMINATE")
    assert flags(spark, [("A", 1, 1, 5, 0.1, 0.2, None)]) == [(*unknown, True)]
    plateau = [("A", 1, 5, 10, 0.10, 0.40, ""), ("A", 1, 10, 11, 0.13, 0.45, None), ("A", 1, 20, 11, 0.15, 0.50, None)]
    assert flags(spark, plateau) == [("YES", "NO", "ONE_SIDED", True), ("YES", "NO", "VALID", False), ("YES", "NO", "ONE_SIDED", True)]
    spike = [("A", 1, 5, 5, 0.20, 0.20, None), ("A", 1, 10, 9, 0.40, 0.90, None), ("A", 1, 20, 5, 0.20, 0.30, None)]
    assert flags(spark, spike) == [("NO", "NO", "ONE_SIDED", True), ("NO", "YES", "VALID", False), ("NO", "NO", "ONE_SIDED", True)]
    failed = [("A", 1, 5, 7, 0.1, 0.3, None), ("A", 1, 10, None, None, None, "failed"), ("A", 1, 20, 7, 0.1, 0.3, None), ("A", 1, 30, 7, 0.1, 0.3, None)]
    assert flags(spark, failed) == [(*unknown, True), ("NO", "NO", "VALID", False), (*unknown, False), ("YES", "NO", "ONE_SIDED", True)]


def test_structure_and_final_choice(spark):
    more = spark.createDataFrame([("A", 1, 1, 5, 0.1, 0.2, None)], FIT)
    more = more.withColumns({c: F.lit(0.5) for c in ("persistence_median", "mean_probability", "davies_bouldin", "calinski_harabasz", "silhouette")})
    more = more.withColumns({"number_of_clusters_below_1_percent": F.lit(0), "smallest_cluster_size": F.lit(100), "median_cluster_size": F.lit(100.0)})
    assert selection.select_final(more).count() == 1
    for column, value in (("noise_fraction", 0.31), ("number_of_clusters_below_1_percent", 3), ("dbcv", None), ("error", "x"), ("smallest_cluster_size", 99), ("median_cluster_size", 99.0), ("cluster_count", 0)):
        kind = dict(more.dtypes)[column]
        assert selection.select_final(more.withColumn(column, F.lit(value).cast(kind))).count() == 0, column
    status = lambda largest, noise, tiny: selection.structure_flags(spark.createDataFrame([(largest, noise, tiny)], "largest_cluster_fraction double, noise_fraction double, number_of_clusters_below_1_percent int")).first().interpretability_status
    assert [status(0.5, 0.1, 0), status(0.65, 0.9, 9), status(0.75, 0.1, 0), status(0.5, 0.31, 0), status(0.5, 0.1, 3), status(None, None, None)] == ["PASS", "CAUTION", "REVIEW", "REVIEW", "REVIEW", "PASS"]


def test_grids():
    assert [len(cluster.GRIDS[n][1]) for n in ("first", "second", "full")] == [23, 17, 6]
    assert cluster.grid("full", 599_288) == cluster.GRIDS["full"][1] and ("A", 30, 2) in cluster.grid("first", 750)


def test_stability_gates(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(5, 0.1, (60, 2))])
    df = spark.createDataFrame([(f"j{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(x)], "job_name string, a double, b double")
    labels = cluster.fit_density(df, "job_name", ["a", "b"]).cache()
    found = cluster.stability(df, "job_name", ["a", "b"], labels, times=2, population=100).collect()
    assert all((r.population_size, r.resample_size) == (100, 80) and r.overlap_rows <= 50 for r in found)
    tiny = cluster.stability(df, "job_name", ["a", "b"], labels, times=1, population=1).first()
    assert tiny.error == "too few rows in the overlap"
    summary = {r.measure: r for r in evaluate.stability_summary(spark.createDataFrame([(0.5, 0.4, 3, 0.1, None), (0.7, 0.4, 3, 0.1, None), (0.1, 0.1, 9, 0.9, "bad")], "ari double, ami double, cluster_count int, noise_fraction double, error string")).collect()}
    assert (summary["ari"].n, summary["ari"].mean, summary["cluster_count"].mode) == (2, 0.6, 3.0)


def test_stability_searches_once_and_gives_each_resample_its_own_fit(spark, monkeypatch):
    from gaugewell.operators import trees

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.3, (300, 2)), rng.normal(4, 0.5, (250, 2)), rng.uniform(-9, 9, (40, 2)), np.full((30, 2), 7.0)])
    df = spark.createDataFrame([(f"j{i:04d}", *map(float, v)) for i, v in enumerate(x)], "job_name string, a double, b double").repartition(3).cache()
    labels = cluster.fit_density(df, "job_name", ["a", "b"]).cache()
    searches, search = [], trees.neighbours
    monkeypatch.setattr(trees, "neighbours", lambda *a: searches.append(a) or search(*a))
    found = sorted(cluster.stability(df, "job_name", ["a", "b"], labels, times=3, population=500).collect())
    assert len(searches) == 1
    whole, evaluation = sampling.population_and_evaluation(df, "job_name", 500)
    for r, part in zip(found, sampling.resamples(whole, "job_name", 3), strict=True):
        own = cluster.fit_density(part, "job_name", ["a", "b"]).cache()
        s = evaluate.structure(own).first()
        a = evaluate.agreement(labels.join(evaluation, "job_name", "left_semi"), own, "job_name", 5)
        assert (r.resample_size, r.cluster_count, r.noise_fraction, r.error) == (400, s.cluster_count, s.noise_fraction, None)
        assert (r.comparison_rows, r.ari, r.ami) == (a["comparison_rows"], a["ari"], pytest.approx(a["ami"])) and r.overlap_rows == part.join(evaluation, "job_name", "left_semi").count()
    spark.catalog.clearCache()


@pytest.mark.parametrize("copies", [0, 40])
def test_trees_are_least_ones(copies):
    from gaugewell.operators import trees

    def brute(x, k):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        core = np.sort(d, 1)[:, k - 1]
        return np.sort(evaluate.minimum_spanning_tree(np.maximum(d, np.maximum(core[:, None], core[None])))[:, 2])

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(30, 0.1, (90, 3)), rng.normal(-500, 3, (5, 3)), np.full((copies, 3), 2.0)])
    tree, _ = trees.spanning_tree(None, x, 6, 32)
    assert len(trees.forest(tree, len(x))) == len(x) - 1 and np.allclose(tree[:, 2], brute(x, 6), atol=1e-9)
    assert (tree[:, 2] == 0).sum() == max(0, copies - 1)  # equal rows are no distance apart
    p = trees.points(x, 32)
    ids, core = trees.neighbours(None, p, 8, 8, 6)  # too few neighbours for some rows of a small resample
    whole = trees.of_points(None, p, core, ids)
    for share in (0.8, 0.2):
        rows = np.flatnonzero(rng.random(len(x)) < share)
        assert np.allclose(trees.resampled_tree(p, ids, whole, rows, 6)[:, 2], brute(x[rows], 6), atol=1e-9)


def test_methods_are_compared_on_rows_that_are_collected_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.6, (50, 2)) for c in (0, 3, 7)])
    df = spark.createDataFrame([(f"j{i:03d}", *map(float, v), i // 50 - (i % 9 == 0) * (i // 50 + 1), i % 4) for i, v in enumerate(x)], "job_name string, a double, b double, one int, two int").cache()
    labels = {n: df.select("job_name", F.col(n).alias("cluster_id")) for n in ("one", "two")}
    expected = {}
    for name, l in labels.items():
        clustered = df.filter("one <> -1").select("job_name", "a", "b").join(l, "job_name")
        whole = df.select("job_name", "a", "b").join(l.withColumn("cluster_id", F.when(F.col("cluster_id") == -1, 99).otherwise(F.col("cluster_id"))), "job_name")
        expected |= {(name, p): (rows.count(), evaluate.metrics(rows, ["a", "b"], "job_name")) for p, rows in (("all", whole), ("clustered", clustered))}
    monkeypatch.setattr(evaluate, "metrics", lambda *a: pytest.fail("a Spark job for each metric"))
    found = cluster.compare_methods(df.select("job_name", "a", "b"), "job_name", ["a", "b"], labels, "one").collect()
    assert len(found) == 4
    for r in found:
        n, m = expected[r.method, r.population]
        assert (r.rows, r.evaluation, r.silhouette) == (n, "full_population", pytest.approx(m["silhouette"])) and r.davies_bouldin == pytest.approx(m["davies_bouldin"], abs=1.1e-4)
        assert r.calinski_harabasz == pytest.approx(m["calinski_harabasz"], abs=1.1e-4)
    spark.catalog.clearCache()


def test_outputs(spark, tmp_path):
    from gaugewell.plans import outputs

    outputs.save_all(spark, "/root/testdata/sf0.01", str(tmp_path))
    master = readers.read_derived(spark, f"{tmp_path}/job_master.csv", ["job_name", "telemetry_coverage"])
    assert master.count() == 1500 and readers.read_derived(spark, f"{tmp_path}/feature_dictionary.csv").count() == 21
    lines = [r.value for r in spark.read.text(f"{tmp_path}/report").collect()]
    assert "DECISIONS" in lines and any(line.startswith("FAIL\tH. Temporal-shape support") for line in lines)


def test_audit_grows_and_long_tables_say_so(spark, tmp_path):
    for stage in ("one", "two"):
        sinks.append_audit(sinks.audit(spark, [(stage, "rows", 3)]), str(tmp_path / "audit"))
    assert {r.stage for r in spark.read.parquet(str(tmp_path / "audit")).collect()} == {"one", "two"}
    sinks.report(spark, [("T", spark.range(7))], str(tmp_path / "r"), rows=5)
    assert "... and 2 more rows" in [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]


def test_models_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml.clustering import KMeansModel

    df = spark.createDataFrame([(i, float(i % 2)) for i in range(20)], "k int, x double")
    model = cluster.fit_kmeans(df, ["x"], k=2, starts=2)
    sinks.save_model(model, str(tmp_path / "m"))
    again = sinks.load_model(KMeansModel, str(tmp_path / "m"))
    one, two = (sorted(map(tuple, cluster.predict(m, df, "k", ["x"]).collect())) for m in (model, again))
    assert one == two


def test_cached_sample(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    one = sorted(r.k for r in sampling.cached_sample(df, "k", 10, str(tmp_path / "s")).collect())
    assert one == sorted(r.k for r in sampling.cached_sample(df, "k", 10, str(tmp_path / "s")).collect()) and len(one) == 10
    assert sampling.cached_sample(df, "k", 12, str(tmp_path / "s")).count() == 12


def test_gates(spark):
    from gaugewell.operators import master

    jobs = spark.createDataFrame([("a", 1.0), ("b", None)], "job_name string, instance_runtime_hours_sum double")
    assert master.validate(jobs).count() == 2
    for bad in (jobs.unionByName(jobs), jobs.withColumn("instance_runtime_hours_sum", F.lit(-1.0))):
        with pytest.raises(ValueError):
            master.validate(bad)
    with pytest.raises(ValueError):
        integrity.merge_one_to_one(jobs, jobs.unionByName(jobs), ["job_name"])
    assert integrity.merge_one_to_one(jobs, jobs.select("job_name"), ["job_name"]).count() == 2
    with pytest.raises(ValueError):
        prepare.validate_alignment(jobs, jobs.limit(1), "job_name")
    assert prepare.validate_alignment(jobs, jobs, "job_name").count() == 2
    flagged = profile.outlier_flags(spark.createDataFrame([(-1.0,), (5.0,)], "x double"), "x")
    assert sorted(r.out_of_range for r in flagged.collect()) == [False, True]
    assert prepare.excluded_cases(spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double"), ["x"]).count() == 2


def test_rank_bucket_over_ranges(spark):
    rng = np.random.default_rng(2)
    values = [None if v < 0.1 else float(round(v * 7)) for v in rng.random(500)]
    df = spark.createDataFrame([(f"k{i:03d}", v) for i, v in enumerate(values)], "k string, v double").repartition(5)
    order = sorted(range(500), key=lambda i: (values[i] is None, values[i] or 0, f"k{i:03d}"))
    assert {r.k: r.b for r in sampling.rank_bucket(df, "v", "k", "b").collect()} == {f"k{i:03d}": n % 5 for n, i in enumerate(order)}


def test_jobs_with_equal_plans_tie_whatever_the_order_of_their_tasks(spark):
    plans = {"a": [0.1, 0.2, 0.3], "b": [0.3, 0.2, 0.1], "c": [None], "d": [float("inf"), 1.0], "e": [1e300, -3.5]}  # a plain sum makes a's mean the larger
    rows = [(j, f"t{i}", v) for j, values in plans.items() for i, v in enumerate(values)]
    tasks = spark.createDataFrame(rows, "job_name string, task_name string, plan_cpu double").coalesce(1)
    empty = {c: F.lit(None).cast(t) for c, t in (("status", "string"), ("inst_num", "double"), ("plan_mem", "double"), ("plan_gpu", "double"), ("gpu_type", "string"), ("start_time", "double"), ("end_time", "double"))}
    means = summaries.task_summary(tasks.withColumns(empty)).select("job_name", "plan_cpu_mean")
    found = {r.job_name: r.plan_cpu_mean for r in means.collect()}
    assert found["a"] == found["b"] == pytest.approx(0.2, rel=1e-15) and found["c"] is None and found["d"] == float("inf") and found["e"] == 5e299
    assert {r.job_name: r.b for r in sampling.rank_bucket(means, "plan_cpu_mean", "job_name", "b").collect()} == {"a": 0, "b": 1, "e": 2, "d": 3, "c": 4}


def test_matrix_of_fits_is_computed_once(spark):
    from gaugewell.plans import choice_queries
    from gaugewell.plans.registry import matrix

    for kind in ("robust", "standard"):
        kept = choice_queries.fit_matrix(spark, "/root/testdata/sf0.01", kind)
        assert kept.storageLevel.useMemory and kept.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        one, two = ({r.job_name: r[1:] for r in df.collect()} for df in (kept, matrix(spark, "/root/testdata/sf0.01", kind)))
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)
    spark.catalog.clearCache()


def test_complete_cases_drop_jobs_without_telemetry_before_the_join(spark):
    from gaugewell.plans import choice_queries, trace

    found = trace.complete_features(spark, "/root/testdata/sf0.01")
    whole = prepare.complete_cases(trace.job_features(spark, "/root/testdata/sf0.01"))
    columns = sorted(whole.columns)
    one, two = ({r.job_name: tuple(r) for r in df.select("job_name", *columns).collect()} for df in (found, whole))
    assert found.columns == whole.columns and one.keys() == two.keys()
    for k in one:
        assert all(a == (pytest.approx(b, rel=1e-9) if isinstance(b, float) else b) for a, b in zip(one[k], two[k], strict=True))
    plan = found.select("runtime_log")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda i: len(plan[i]) - len(plan[i].lstrip(" :+-"))
    join = next(i for i, line in enumerate(plan) if "Join Inner" in line and "l_orderkey" in line)
    below = next((i for i in range(join + 1, len(plan)) if depth(i) <= depth(join)), len(plan))
    assert any("LeftSemi" in line for line in plan[join:below])
    assert choice_queries.fit_matrix(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 1
    spark.catalog.clearCache()


def test_sweep_shares_one_search_for_all_trees(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, s, (150, 3)) for c, s in ((0, 0.3), (3, 1.0), (9, 0.1))] + [rng.normal(0, 0.3, (1, 3)).repeat(20, 0)])
    searches, whole = [], cluster._spanning_tree
    monkeypatch.setattr(cluster, "_spanning_tree", lambda *a: searches.append(a[2]) or whole(*a))
    trees = cluster._spanning_trees(spark, x, [2, 12, 5, 30, 5], 100)
    assert searches == [30] and sorted(trees) == [2, 5, 12, 30]
    for samples, tree in trees.items():
        assert np.allclose(np.sort(tree[:, 2]), np.sort(whole(spark, x, samples, 100)[:, 2]), atol=1e-6) and len(tree) == len(x) - 1
    df = spark.createDataFrame([(f"j{i:03d}", *map(float, v)) for i, v in enumerate(x)], "job_name string, a double, b double, c double")
    grid, searches[:] = [("A", 20, 5), ("A", 40, 12), ("B", 20, 12)], []
    one, two = ([{k: v for k, v in r.asDict().items() if k != "elapsed_seconds"} for r in cluster.sweep(df, "job_name", ["a", "b", "c"], grid, n).collect()] for n in (200, 1000))
    assert searches == [12] and [r["error"] for r in one] == [None] * 3
    assert all(a[k] == (pytest.approx(b[k], abs=1e-5) if isinstance(b[k], float) else b[k]) for a, b in zip(one, two, strict=True) for k in a)


def test_silhouette_and_dbcv_against_brute_force():
    rng = np.random.default_rng(7)
    x, labels = rng.normal(0, 1, (40, 3)) + np.repeat([[0, 0, 0], [4, 0, 0]], 20, 0), np.repeat([0, 1], 20)
    dist = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    scores = []
    for i in range(40):
        own = [dist(x[i], x[j]) for j in range(40) if j != i and labels[j] == labels[i]]
        other = [dist(x[i], x[j]) for j in range(40) if labels[j] != labels[i]]
        a, b = np.mean(own), np.mean(other)
        scores.append((b - a) / max(a, b))
    assert abs(evaluate.silhouette_of(x, labels) - np.mean(scores)) < 1e-8
    groups = [np.flatnonzero(labels == c) for c in (0, 1)]
    core = {i: np.mean([(1 / dist(x[i], x[j])) ** 3 for j in g if j != i]) ** (-1 / 3) for g in groups for i in g}
    reach = lambda i, j: max(dist(x[i], x[j]), core[i], core[j])
    sparse, inner = [], []
    for g in groups:
        joined, edges = {g[0]}, []
        while len(joined) < len(g):
            w, i, j = min((reach(i, j), i, j) for i in joined for j in g if j not in joined)
            edges.append((w, i, j))
            joined.add(j)
        inside = {i for i in g if sum(i in e[1:] for e in edges) > 1}
        inner.append(inside)
        sparse.append(max(w for w, i, j in edges if i in inside and j in inside))
    apart = min(reach(i, j) for i in inner[0] for j in inner[1])
    expected = np.mean([(apart - s) / max(apart, s) for s in sparse])
    assert abs(evaluate.dbcv_of(x, labels) - expected) < 1e-7


def test_density_clusters_two_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(5, 0.1, (60, 2)), [[2.5, 2.5]]])
    df = spark.createDataFrame([(f"j{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(x)], "job_name string, a double, b double")
    out = {r.job_name: r for r in cluster.fit_density(df, "job_name", ["a", "b"], 20, 5).collect()}
    first, second = {out[f"j{i:03d}"].cluster_id for i in range(60)} - {-1}, {out[f"j{i:03d}"].cluster_id for i in range(60, 120)} - {-1}
    assert len(first) == len(second) == 1 and first != second
    assert all(0 <= r.cluster_probability <= 1 for r in out.values())
    far = {r.job_name: r.cluster_id for r in cluster.fit_density(df, "job_name", ["a", "b"], 10, 3, fit_rows=80).collect()}
    assert len(far) == 121


def test_density_by_pairs_of_blocks_fits_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.2, (150, 3)), rng.normal(3, 0.4, (120, 3)), rng.normal(-4, 0.1, (25, 3)), rng.uniform(-9, 9, (30, 3))])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(f"j{i:03d}", *map(float, v)) for i, v in enumerate(x)], "job_name string, a double, b double, c double").repartition(4)
    for least, samples in ((15, 4), (None, None)):
        one = cluster.fit_density(df, "job_name", ["a", "b", "c"], least, samples).toPandas().sort_values("job_name")
        for rows in (60, 101):
            many = cluster.fit_density(df, "job_name", ["a", "b", "c"], least, samples, fit_rows=rows).toPandas().sort_values("job_name")
            assert many.cluster_id.tolist() == one.cluster_id.tolist() and one.cluster_id.max() >= 2
            for c in ("cluster_probability", "cluster_persistence"):
                assert np.allclose(many[c].to_numpy(float), one[c].to_numpy(float), atol=1e-6, equal_nan=True)


def test_metrics_on_closed_forms(spark):
    x, labels = np.array([[0.0], [1.0], [10.0], [11.0]]), np.array([0, 0, 1, 1])
    expected = np.mean([1 - 1 / 10.5, 1 - 1 / 9.5, 1 - 1 / 9.5, 1 - 1 / 10.5])
    assert abs(evaluate.silhouette_of(x, labels) - expected) < 1e-12
    df = spark.createDataFrame([(i, float(v[0]), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "k int, x double, cluster_id int")
    assert evaluate.davies_bouldin(df, ["x"]).first()[0] == 0.1
    assert evaluate.calinski_harabasz(df, ["x"]).first()[0] == 200.0
    assert evaluate.metrics(df.withColumn("cluster_id", F.lit(0)), ["x"], "k")["silhouette"] is None
    assert evaluate.dbcv_of(np.random.default_rng(1).normal(0, 0.1, (40, 2)) + np.repeat([[0.0], [5.0]], 20, 0), np.repeat([0, 1], 20)) > 0.5
    same = spark.createDataFrame([(i, i % 3) for i in range(90)], "k int, cluster_id int")
    a = evaluate.agreement(same, same, "k", 10)
    assert a["ari"] == 1.0 and abs(a["ami"] - 1) < 1e-9
    assert evaluate.agreement(same, same, "k")["error"]
    assert abs(evaluate.adjusted_mutual_information(np.array([[5, 5], [5, 5]]))) < 0.12


def test_ranks_have_mean_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "v double")
    assert sorted(r[0] for r in df.select(evaluate.average_rank_pct("v").alias("p")).filter("p is not null").collect()) == [1 / 3, 2.5 / 3, 2.5 / 3]


def test_tags(spark):
    jobs = spark.createDataFrame([("a", 0), ("b", 1), ("c", -1)], "job_name string, cluster_id int")
    inst = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", None)], "job_name string, inst_id string")
    groups = spark.createDataFrame([("1", "bert"), ("1", "ads"), ("2", "N/A")], "inst_id string, workload string")
    t = semantic.tagged_assignments(jobs, semantic.job_tags(inst, groups))
    assert {r.job_name: r.workload for r in t.collect()} == {"a": "bert", "b": None, "c": None}
    assert semantic.enrichment(t).first().enrichment_ratio == 1.0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "view", float(i * 9)) for i in range(20)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), late="10 days")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, events.windowed(rows).collect()))
