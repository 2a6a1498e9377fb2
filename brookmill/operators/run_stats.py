"""Statistics of application runs from ``runs``, ``stages`` and ``tasks`` tables.

runs: run, workload, variant, start, end · stages: run, stage, attempt, name, job,
task_count, start, completion, failed · tasks: run, stage, attempt, task_id, host, start,
end, gc, fetch_wait, initial_read, partial_wait, shuffle_write (ns), input_bytes,
input_source[, wait_periods]. Times are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.units import whole
from .ranking import index_pick, order_statistics, trim_ranks

KEY = ["run", "stage", "attempt"]


def real_jobs() -> Column:
    """Drops the warm-up job 0 and stages without a job."""
    return F.col("job") > 0


def has_tasks() -> Column:
    return F.col("task_count") > 0


def finite(col: str) -> Column:
    return F.col(col).isNotNull() & ~F.isnan(col)


def complete_runs(table: DataFrame, stages: DataFrame) -> DataFrame:
    """Leave out every run of which some stage failed."""
    return table.join(stages.filter("failed").select("run").distinct(), "run", "left_anti")


def run_table(runs: DataFrame, stages: DataFrame, keep: Column | None = None) -> DataFrame:
    """Start, end and runtime of each run from its stages with tasks.

    Runs with a failed stage, or with no stage left after ``keep``, are not valid.
    """
    used = complete_runs(stages, stages).filter(has_tasks())
    if keep is not None:
        used = used.filter(keep)
    span = used.groupBy("run").agg(F.min("start").alias("start"), F.max("completion").alias("end"))
    return (
        runs.drop("start", "end").join(span, "run")
        .withColumn("runtime", F.col("end") - F.col("start"))
    )


def with_duration(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("duration", F.col("end") - F.col("start"))


def stage_runtime(stages: DataFrame) -> DataFrame:
    return stages.withColumn("runtime", F.col("completion") - F.col("start"))


PERCENTS = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def stage_stats(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """Task-duration statistics per stage attempt.

    Mean and variance are integer figures over the planned task count; percentiles are
    ``sorted[floor(n p)]``. The squared deviations follow from the sum of squares, which
    is kept exact in two halves, so one map-side combined pass gives all but the ranks.
    """
    timed = with_duration(tasks).select(*KEY, "duration")
    square = F.col("duration") * F.col("duration")
    folded = timed.groupBy(*KEY).agg(
        F.count("duration").alias("recorded"),
        F.sum("duration").alias("total"),
        F.min("duration").alias("shortest"),
        F.max("duration").alias("longest"),
        F.sum(F.shiftright(square, 32)).alias("_high"),
        F.sum(square.bitwiseAND(F.lit(0xFFFFFFFF))).alias("_low"),
    )
    ranks = order_statistics(timed, KEY, "duration", {name: index_pick(p) for name, p in PERCENTS.items()})
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    squares = wide("_high") * F.lit(2**32).cast("decimal(10,0)") + wide("_low")
    spread = squares - 2 * wide("mean") * wide("total") + wide("mean") * wide("mean") * wide("recorded")
    return (
        folded.join(stages.select(*KEY, "task_count"), KEY).join(ranks, KEY)
        .withColumn("mean", whole(F.col("total"), F.col("task_count")))
        .withColumn("variance", whole(spread, F.col("task_count")))
        .withColumn("std", F.round(F.sqrt("variance")).cast("bigint"))
        .drop("_high", "_low")
    )


def stage_io(tasks: DataFrame) -> DataFrame:
    """Waits, shuffle writes (ns), GC and input bytes by read method per stage attempt."""
    read = lambda m: F.sum(F.when(F.col("input_source") == m, F.col("input_bytes")).otherwise(0))
    return tasks.groupBy(*KEY).agg(
        F.sum("fetch_wait").alias("fetch_wait"),
        F.sum("initial_read").alias("initial_read"),
        F.sum("partial_wait").alias("partial_wait"),
        F.sum("shuffle_write").alias("shuffle_write"),
        F.sum("gc").alias("gc"),
        F.sum(F.col("end") - F.col("start")).alias("task_time"),
        *[read(m).alias(f"{m.lower()}_bytes") for m in ("Memory", "Hadoop", "Disk", "Network")],
    )


def trimmed_runs(run_table: DataFrame, group: list[str], percent: int = 10) -> DataFrame:
    """Drop the extremes of each group by runtime (ties by run id)."""
    return trim_ranks(run_table, group, ["runtime", "run"], percent)


def selected_runs(
    runs: DataFrame, stages: DataFrame, keep: Column | None = None, percent: int = 10, group: tuple[str, ...] = ("workload", "variant")
) -> DataFrame:
    """The runs that reports are made of: start and end from the stages of real jobs (or
    those that ``keep`` holds), extremes of each group dropped unless ``percent`` is 0."""
    valid = run_table(runs, stages, real_jobs() if keep is None else keep)
    return trimmed_runs(valid, list(group), percent) if percent else valid


def stage_intervals(stages: DataFrame) -> DataFrame:
    return stages.filter(has_tasks()).select("run", "stage", "attempt", "start", F.col("completion").alias("end"))


def host_intervals(tasks: DataFrame) -> DataFrame:
    """First start and last end of each stage's tasks on each host."""
    return tasks.groupBy(*KEY, "host").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def host_timeline(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """:func:`host_intervals` plus a zero-length interval, at the stage start, for every
    host that was used by an earlier stage of the run but ran nothing in this one.

    Stage order within a run is (job, start, stage).
    """
    order = W.partitionBy("run").orderBy("job", "start", "stage", "attempt")
    ordered = stages.filter(has_tasks()).withColumn("_ord", F.row_number().over(order)).select(*KEY, "_ord", "start")
    ran = host_intervals(tasks)
    first = ran.join(ordered.select(*KEY, "_ord"), KEY).groupBy("run", "host").agg(F.min("_ord").alias("_first"))
    idle = (
        ordered.join(first, "run").filter(F.col("_first") < F.col("_ord"))
        .join(ran.select(*KEY, "host"), [*KEY, "host"], "left_anti")
        .select(*KEY, "host", "start", F.col("start").alias("end"), F.lit(True).alias("filler"))
    )
    return ran.withColumn("filler", F.lit(False)).unionByName(idle)


def wait_intervals(tasks: DataFrame) -> DataFrame:
    """One row per recorded wait for parent output."""
    return tasks.select(*KEY, "host", "task_id", F.explode("wait_periods").alias("w")).select(
        *KEY, "host", "task_id", F.col("w.start").alias("start"), (F.col("w.start") + F.col("w.duration")).alias("end")
    )


def worker_numbers(tasks: DataFrame) -> DataFrame:
    """Hosts of a run numbered in name order; the window sees one row per host."""
    hosts = tasks.select("run", "host").distinct()
    number = F.dense_rank().over(W.partitionBy("run").orderBy("host"))
    return hosts.withColumn("worker", F.concat(F.lit("Worker-"), number.cast("string")))


def job_end_markers(stages: DataFrame) -> DataFrame:
    """Last completion of every job of a run but the last one."""
    jobs = stages.filter(has_tasks()).groupBy("run", "job").agg(F.max("completion").alias("job_end"))
    last = F.max("job").over(W.partitionBy("run"))
    return jobs.withColumn("_last", last).filter(F.col("job") < F.col("_last")).drop("_last")


def relative_times(stages: DataFrame, run_table: DataFrame) -> DataFrame:
    """Stage start and completion relative to the start of the run."""
    begun = run_table.select("run", F.col("start").alias("_run_start"))
    return (
        stages.join(begun, "run")
        .withColumn("start", F.col("start") - F.col("_run_start"))
        .withColumn("completion", F.col("completion") - F.col("_run_start"))
        .drop("_run_start")
    )


def average_timeline(stages: DataFrame, run_table: DataFrame) -> DataFrame:
    """Integer mean of relative stage times over the runs, per job and stage."""
    rel = relative_times(stages.filter(has_tasks()), run_table)
    n = F.count(F.lit(1))
    return rel.groupBy("job", "stage").agg(
        whole(F.sum("start"), n).alias("start"), whole(F.sum("completion"), n).alias("completion"), n.alias("runs")
    )
