"""Resource usage of runs and stages from metric samples.

samples: host, metric, instance, ts (epoch seconds), v1, v2. An interval in milliseconds
covers the whole seconds ``start div 1000 .. end div 1000``, both ends included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.units import busy_percent, bytes_to_mb, ms_to_s, ns_to_s, whole
from .intervals import interval_join, interval_totals
from .run_stats import KEY, has_tasks

# fixed values: what each sample column measures
MEASURES = {
    "idle": ("cpu", "v1"),
    "load": ("load", "v1"),
    "download": ("network", "v1"),
    "upload": ("network", "v2"),
    "disk_read": ("disk", "v1"),
    "disk_write": ("disk", "v2"),
}
MEAN_PER_NODE = {"idle", "load"}  # the others are summed per node


def without_hosts(samples: DataFrame, pattern: str = "master") -> DataFrame:
    return samples.filter(~F.col("host").rlike(pattern))


def usage(samples: DataFrame, intervals: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """Cluster value of each measure per interval: node mean (cpu, load) or node sum
    (disk, network) first, then the mean over nodes. A sample with a figure that is not a
    number is left out with both its figures. Nodes without a valid sample do not count;
    with no such node the value is null.

    ``intervals`` has ``start`` and ``end`` in milliseconds. All measures share one pass.
    """
    wanted = {m: MEASURES[m] for m in measures}
    metrics = sorted({metric for metric, _ in wanted.values()})
    whole_lines = ~F.isnan("v1") & ~F.isnan("v2")
    points = without_hosts(samples).filter(F.col("metric").isin(metrics) & whole_lines).select(
        "host", "ts", *[F.when(F.col("metric") == metric, F.col(v)).alias(m) for m, (metric, v) in wanted.items()]
    )
    spans = intervals.select(*ids, ms_to_s(F.col("start")).alias("_from"), ms_to_s(F.col("end")).alias("_to"))
    per_node = interval_totals(points, spans, "ts", "_from", "_to", ["host"], list(wanted), ids)
    node = lambda m: F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_sum") / F.col(f"{m}_n") if m in MEAN_PER_NODE else F.col(f"{m}_sum"))
    found = per_node.groupBy(*ids).agg(*[F.avg(node(m)).alias(m) for m in wanted])
    return intervals.select(*ids).join(found, ids, "left")


def _stage_spans(stages: DataFrame) -> DataFrame:
    return stages.filter(has_tasks()).select(*KEY, "start", F.col("completion").alias("end"))


def stage_usage(samples: DataFrame, stages: DataFrame, measures: list[str]) -> DataFrame:
    return usage(samples, _stage_spans(stages), KEY, measures)


def run_usage(samples: DataFrame, run_table: DataFrame, measures: list[str]) -> DataFrame:
    return usage(samples, run_table.select("run", "start", "end"), ["run"], measures)


def usage_report(samples: DataFrame, stages: DataFrame, run_table: DataFrame, first: str, second: str) -> DataFrame:
    """Mean over runs of two measures per stage id, and an ``App`` row with stage id -1.

    Stages and whole runs are intervals of one pass over the samples. Rows in which either measure is missing are left out before averaging.
    """
    whole_runs = run_table.select("run", F.lit(-1).alias("stage"), F.lit(-1).alias("attempt"), "start", "end")
    spans = _stage_spans(stages).unionByName(whole_runs)
    used = usage(samples, spans, KEY, [first, second]).filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    names = stages.groupBy("stage").agg(F.min("name").alias("name")).unionByName(
        stages.sparkSession.createDataFrame([(-1, "App")], "stage int, name string"))
    # a report without any run still has its row
    mean = used.groupBy("stage").agg(F.avg(first).alias(first), F.avg(second).alias(second))
    rows = names.join(mean, "stage", "left").filter((F.col("stage") == -1) | F.col(first).isNotNull())
    return rows.select("stage", "name", first, second)


def disk_report(samples: DataFrame, stages: DataFrame, run_table: DataFrame) -> DataFrame:
    return usage_report(samples, stages, run_table, "disk_read", "disk_write")


def network_report(samples: DataFrame, stages: DataFrame, run_table: DataFrame) -> DataFrame:
    return usage_report(samples, stages, run_table, "download", "upload")


def series(samples: DataFrame, metric: str, values: dict[str, Column], by_instance: bool = False) -> DataFrame:
    """Values per machine (and instance) and time, with the average machine ``cluster``.

    ``values`` maps output names to expressions over v1 and v2.
    """
    rows = without_hosts(samples).filter(F.col("metric") == metric).select(
        "host", "instance", "ts", *[c.alias(n) for n, c in values.items()]
    )
    for n in values:
        rows = rows.filter(F.col(n).isNotNull() & ~F.isnan(n))
    keys = ["ts", "instance"] if by_instance else ["ts"]
    means = [F.avg(n).alias(n) for n in values]
    machines = rows.groupBy("host", *keys).agg(*means)
    cluster = rows.groupBy(*keys).agg(*means).withColumn("host", F.lit("cluster"))
    return machines.unionByName(cluster)


def run_series(samples: DataFrame, run_table: DataFrame, metric: str, values: dict[str, Column]) -> DataFrame:
    """``run, host, at`` and the values of a metric over each run, ``at`` being seconds from
    the run's start, with the average machine ``cluster``.

    A sample is met by time blocks as long as a run usually is, so it is compared with the
    few runs of its block; runs that overlap each have their samples.
    """
    spans = run_table.select("run", ms_to_s(F.col("start")).alias("_from"), ms_to_s(F.col("end")).alias("_to"))
    width = spans.agg(F.ceil(F.avg(F.col("_to") - F.col("_from") + 1)).alias("w")).first()["w"] or 1
    rows = without_hosts(samples).filter(F.col("metric") == metric).select("host", "ts", *[c.alias(n) for n, c in values.items()])
    for n in values:
        rows = rows.filter(F.col(n).isNotNull() & ~F.isnan(n))
    met = interval_join(rows, spans, "ts", "_from", "_to", int(width)).withColumn("at", F.col("ts") - F.col("_from"))
    sums = [F.sum(n).alias(f"_{n}") for n in values]
    machines = met.groupBy("run", "host", "at").agg(F.count(F.lit(1)).alias("_n"), *sums)
    # both averages from one table of sums
    both = machines.withColumn("host", F.explode(F.array(F.col("host"), F.lit("cluster"))))
    return both.groupBy("run", "host", "at").agg(*[(F.sum(f"_{n}") / F.sum("_n")).alias(n) for n in values])


def between_ms(samples: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Samples inside one run, in whole seconds with both ends included."""
    return samples.filter(F.col("ts").between(start_ms // 1000, end_ms // 1000))


def cpu_series(samples: DataFrame) -> DataFrame:
    return series(samples, "cpu", {"busy": busy_percent(F.col("v1"))})


def disk_series(samples: DataFrame) -> DataFrame:
    return series(samples, "disk", {"disk_read": F.col("v1"), "disk_write": F.col("v2")}, by_instance=True)


def network_series(samples: DataFrame) -> DataFrame:
    return series(samples, "network", {"download": F.col("v1"), "upload": F.col("v2")})


def stage_summary(stages: DataFrame, stats: DataFrame, io: DataFrame, used: DataFrame) -> DataFrame:
    """Twenty-four statistics per stage id, averaged over the (run, stage) rows that have
    all four resource measures, with times in seconds and bytes in MB.

    ``stats``, ``io`` and ``used`` come from ``stage_stats``, ``stage_io`` and
    :func:`stage_usage` with idle, load, upload and download.
    """
    complete = used.filter(
        F.col("idle").isNotNull() & F.col("load").isNotNull() & F.col("upload").isNotNull() & F.col("download").isNotNull()
    )
    rows = (
        stages.filter(has_tasks()).withColumn("runtime", F.col("completion") - F.col("start"))
        .select(*KEY, "name", "runtime").join(stats, KEY).join(io, KEY).join(complete, KEY)
    )
    n = F.count(F.lit(1))
    mean = lambda c: whole(F.sum(c), n)
    return rows.groupBy("stage").agg(
        F.min("name").alias("name"),
        mean("task_count").alias("task_count"),
        *[mean(c).alias(c) for c in ("mean", "shortest", "longest", "std", "p5", "p25", "median", "p75", "p95")],
        ms_to_s(mean("total")).alias("task_time_s"),
        ms_to_s(mean("runtime")).alias("runtime_s"),
        ms_to_s(mean("fetch_wait")).alias("fetch_wait_s"),
        ns_to_s(mean("shuffle_write")).alias("shuffle_write_s"),
        F.avg(busy_percent(F.col("idle"))).alias("cpu"), F.avg("load").alias("load"),
        F.avg("upload").alias("upload"), F.avg("download").alias("download"),
        ms_to_s(mean("partial_wait")).alias("partial_wait_s"),
        ms_to_s(mean("initial_read")).alias("initial_read_s"),
        *[bytes_to_mb(mean(f"{m}_bytes")).alias(f"{m}_mb") for m in ("memory", "hadoop", "network", "disk")],
    )


# fixed values: header of the stage summary file, and the number patterns of the reports
STAGE_SUMMARY_HEADER = {
    "StageId": "stage", "Name": "name", "TaskCount": "task_count", "StageRuntime": "runtime_s",
    "TotalTaskRuntime": "task_time_s", "InitialReadTime": "initial_read_s", "PartialOutputWaitTime": "partial_wait_s",
    "FetchWaitTime": "fetch_wait_s", "ShuffleWriteTime": "shuffle_write_s", "MemoryInput": "memory_mb",
    "HadoopInput": "hadoop_mb", "NetworkInput": "network_mb", "DiskInput": "disk_mb",
}
STAGE_SUMMARY_PATTERNS = {c: "#,### MB" for c in ("MemoryInput", "HadoopInput", "NetworkInput", "DiskInput")}
USAGE_PATTERN = "#,###"
RUNTIME_PATTERN = "#.##"


def stage_summary_file(summary: DataFrame) -> DataFrame:
    """The thirteen named columns of the summary file."""
    return summary.select(*[F.col(c).alias(header) for header, c in STAGE_SUMMARY_HEADER.items()])
