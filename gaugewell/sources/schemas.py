"""Schemas of the raw trace tables: column order is part of the contract, every raw file is headerless CSV."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

#: Columns of each raw table in order, and those that are numbers once they are cleaned (fixed values).
COLUMNS = {
    "job": "job_name inst_id user status start_time end_time".split(),
    "task": "job_name task_name inst_num status start_time end_time plan_cpu plan_mem plan_gpu gpu_type".split(),
    "instance": "job_name task_name inst_name worker_name inst_id status start_time end_time machine".split(),
    "sensor": (
        "job_name task_name worker_name inst_id machine gpu_name cpu_usage gpu_wrk_util avg_mem max_mem avg_gpu_wrk_mem "
        "max_gpu_wrk_mem read write read_count write_count"
    ).split(),
    "group_tag": "inst_id user gpu_type_spec group workload".split(),
    "machine_spec": "machine gpu_type cap_cpu cap_mem cap_gpu".split(),
    "machine_metric": (
        "worker_name machine start_time end_time machine_cpu_iowait machine_cpu_kernel machine_cpu_usr machine_gpu "
        "machine_load_1 machine_net_receive machine_num_worker machine_cpu"
    ).split(),
}
NUMBERS = {
    "job": {"start_time", "end_time"},
    "task": {"inst_num", "start_time", "end_time", "plan_cpu", "plan_mem", "plan_gpu"},
    "instance": {"start_time", "end_time"},
    "sensor": set(COLUMNS["sensor"][6:]),
    "group_tag": set(),
    "machine_spec": {"cap_cpu", "cap_mem", "cap_gpu"},
    "machine_metric": set(COLUMNS["machine_metric"][2:]),
}
KEYS = {
    "job": ["job_name"],
    "task": ["job_name", "task_name"],
    "instance": ["job_name", "task_name", "inst_id"],
    "sensor": ["job_name", "task_name", "inst_id"],
    "group_tag": ["inst_id"],
    "machine_spec": ["machine"],
    "machine_metric": ["worker_name", "machine"],
}


def raw_schema(table: str) -> StructType:
    """All strings: numbers are coerced after the read, so that a bad value becomes null and not an error."""
    return StructType([StructField(c, StringType()) for c in COLUMNS[table]])
