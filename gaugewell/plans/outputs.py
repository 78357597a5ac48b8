"""The named data sets that a whole run leaves, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean, features, prepare, profile
from ..operators.features import CORE
from ..sources import sinks
from .trace import job_features, job_master, tables


def data_sets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Master, audits, features, eligibility, caps, matrices and the feature dictionary, by name."""
    master, engineered = job_master(spark, sf_dir), job_features(spark, sf_dir)
    complete = prepare.complete_cases(engineered)
    made = prepare.matrices(engineered, "job_name")
    return {
        "job_master": master,
        "cleaning_audit": clean.rule_counts(tables(spark, sf_dir)["sensor"], ["cpu_usage", "avg_mem", "max_mem"]),
        "engineered_features": engineered.select("job_name", *features.ENGINEERED),
        "feature_audit": features.audit(engineered),
        "modeling_eligibility": features.eligibility(engineered),
        "clustering_eligibility": prepare.case_counts(engineered),
        "tail_caps": prepare.tail_caps(complete, prepare.RATIOS),
        "matrix_robust": made["robust"],
        "matrix_standard": made["standard"],
        "feature_dictionary": prepare.feature_dictionary(spark),
    }


def save_all(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Every data set as CSV, those with jobs in order of job, and the text report."""
    sets = data_sets(spark, sf_dir)
    sinks.write_sets(sets, folder, {name: ["job_name"] for name, df in sets.items() if "job_name" in df.columns})
    engineered = job_features(spark, sf_dir)
    decisions = prepare.decision_report(engineered, "job_name").cache()
    sections = [
        ("MISSINGNESS", profile.missingness(engineered.select(*CORE))),
        ("QUALITY OF FEATURES", profile.feature_quality(engineered, CORE)),
        ("CORRELATED PAIRS", profile.correlation_pairs(engineered, CORE, 0.8)),
        ("DECISIONS", decisions),
        ("ISSUES", sinks.issues(decisions)),
    ]
    sinks.report(spark, sections, f"{folder}/report")
