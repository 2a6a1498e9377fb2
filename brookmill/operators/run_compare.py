"""Comparison of two groups of runs of the same workloads.

The group of a run is its boolean ``variant``. Results name the two sides ``on`` and
``off``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.student import t_p_value, t_quantile
from ..functions.units import bytes_to_mb, ms_to_s, whole
from .ranking import interpolated_percentiles
from .run_stats import KEY, real_jobs


def runtime_moments(run_table: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, variance, standard deviation and squared-error sum of the runtime."""
    return run_table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("runtime").alias("mean"), F.stddev_samp("runtime").alias("std"),
        F.var_samp("runtime").alias("var"), (F.var_samp("runtime") * (F.count(F.lit(1)) - 1)).alias("sse"),
    )


def runtime_percentiles(run_table: DataFrame, by: list[str]) -> DataFrame:
    """Median and 90th percentile by the ``p (n + 1)`` rule."""
    return interpolated_percentiles(run_table, by, "runtime", {"median": 0.5, "p90": 0.9})


def mean_interval(moments: DataFrame, mean: str = "mean", std: str = "std", n: str = "n", prefix: str = "") -> DataFrame:
    """95 % confidence bounds of the mean: ``mean -+ t(.975, n - 1) * std / sqrt(n)``."""
    half = t_quantile(0.975, F.col(n).cast("double") - 1) * F.col(std) / F.sqrt(F.col(n))
    return moments.withColumn("_half", half).withColumn(f"{prefix}lower", F.col(mean) - F.col("_half")).withColumn(
        f"{prefix}upper", F.col(mean) + F.col("_half")
    ).drop("_half")


def _sides(run_table: DataFrame, key: str) -> DataFrame:
    """The workloads present in both groups, with moments ``on_*`` and ``off_*``: one
    conditional pass, no join of the two groups."""
    columns = []
    for tag, flag in (("on", F.col("variant")), ("off", ~F.col("variant"))):
        x = F.when(flag, F.col("runtime"))
        columns += [
            F.count(x).alias(f"{tag}_n"), F.avg(x).alias(f"{tag}_mean"), F.stddev_samp(x).alias(f"{tag}_std"),
            F.var_samp(x).alias(f"{tag}_var"), (F.var_samp(x) * (F.count(x) - 1)).alias(f"{tag}_sse"),
        ]
    return run_table.groupBy(key).agg(*columns).filter((F.col("on_n") > 0) & (F.col("off_n") > 0))


def compare_runtimes(run_table: DataFrame, key: str = "workload", legacy_n: bool = False) -> DataFrame:
    """Means of both groups, Welch statistic and freedom, pooled error and speed-up.

    ``legacy_n`` takes ``n1 * n2 / n1 + n2`` as the pooled size (an operator-precedence
    slip of older reports) in place of the harmonic mean.
    """
    both = _sides(run_table, key)
    n1, n2 = F.col("on_n").cast("double"), F.col("off_n").cast("double")
    a, b = F.col("on_var") / n1, F.col("off_var") / n2
    pooled = whole(F.col("on_n") * F.col("off_n"), F.col("on_n")).cast("double") + n2 if legacy_n else 2 * n1 * n2 / (n1 + n2)
    return (
        both.withColumn("diff", F.col("on_mean") - F.col("off_mean"))
        .withColumn("freedom", F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1)))
        .withColumn("t", F.try_divide(F.col("off_mean") - F.col("on_mean"), F.sqrt(a + b)))
        .withColumn("mse", F.try_divide(F.col("on_sse") + F.col("off_sse"), F.col("freedom")))
        .withColumn("error", F.sqrt(2 * F.col("mse") / pooled))
        .withColumn("speedup", 100 * F.col("diff") / F.col("on_mean"))
    )


def compare_report(run_table: DataFrame, key: str = "workload", legacy_n: bool = False) -> DataFrame:
    """The fifteen-column comparison report, with bounds and significance at 5 %."""
    rows = compare_runtimes(run_table, key, legacy_n)
    rows = mean_interval(rows, "on_mean", "on_std", "on_n", "on_")
    rows = mean_interval(rows, "off_mean", "off_std", "off_n", "off_")
    rows = rows.withColumn("p_value", t_p_value(F.col("t"), F.col("freedom"))).withColumn(
        "_reach", t_quantile(0.975, F.col("freedom")) * F.col("error")
    )
    percent = lambda c: 100 * c / F.col("on_mean")
    return rows.select(
        F.col(key).alias("Name"),
        F.col("on_mean").alias("Barrier"), F.col("on_lower").alias("BarrierLower"), F.col("on_upper").alias("BarrierUpper"),
        F.col("on_std").alias("BarrierStdDev"), F.col("on_n").alias("BarrierSample"),
        F.col("off_mean").alias("NoBarrier"), F.col("off_lower").alias("NoBarrierLower"), F.col("off_upper").alias("NoBarrierUpper"),
        F.col("off_std").alias("NoBarrierStdDev"), F.col("off_n").alias("NoBarrierSample"),
        (F.col("p_value") < 0.05).alias("SignificantDifferent"),
        F.col("speedup").alias("SpeedUp"),
        percent(F.col("diff") - F.col("_reach")).alias("SpeedUpLower"),
        percent(F.col("diff") + F.col("_reach")).alias("SpeedUpUpper"),
    )


def _side(flag: bool, col: Column) -> Column:
    return F.sum(F.when(F.col("variant") == flag, col).otherwise(0))


def group_sizes(runs: DataFrame) -> DataFrame:
    """One row: number of runs in each group."""
    return runs.agg(F.count(F.when(F.col("variant"), 1)).alias("on_runs"), F.count(F.when(~F.col("variant"), 1)).alias("off_runs"))


def compare_execution(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Per stage id and group: mean input MB by read method and mean net task seconds.

    Both groups are summed in one conditional pass; a missing side counts as 0.
    """
    methods = ("Memory", "Hadoop", "Network", "Disk")
    per_run = tasks.groupBy("run", "stage").agg(
        F.countDistinct("attempt").alias("attempts"),
        F.sum(F.col("end") - F.col("start") - F.col("partial_wait")).alias("net"),
        *[F.sum(F.when(F.col("input_source") == m, F.col("input_bytes")).otherwise(0)).alias(m.lower()) for m in methods],
    ).join(runs.select("run", "variant"), "run")
    columns = []
    for tag, flag in (("on", True), ("off", False)):
        n = _side(flag, F.col("attempts"))
        mean = lambda c: F.coalesce(whole(_side(flag, F.col(c)), n), F.lit(0))
        columns += [bytes_to_mb(mean(m.lower())).alias(f"{tag}_{m.lower()}_mb") for m in methods]
        columns.append(ms_to_s(mean("net")).alias(f"{tag}_task_s"))
    return per_run.groupBy("stage").agg(*columns)


def compare_gc(tasks: DataFrame, stages: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean GC ms per stage id in both groups, over stages of real jobs.

    A group's sum is divided by its own number of runs; a missing stage counts as 0.
    """
    sums = _gc_sums(tasks, stages, runs)
    return (
        sums.groupBy("stage").agg(_side(True, F.col("gc")).alias("on_sum"), _side(False, F.col("gc")).alias("off_sum"),
                                  F.max("on_runs").alias("on_runs"), F.max("off_runs").alias("off_runs"))
        .select("stage", F.coalesce(whole(F.col("on_sum"), F.col("on_runs")), F.lit(0)).alias("on_gc"),
                F.coalesce(whole(F.col("off_sum"), F.col("off_runs")), F.lit(0)).alias("off_gc"))
    )


def _gc_sums(tasks: DataFrame, stages: DataFrame, runs: DataFrame) -> DataFrame:
    per_run = tasks.groupBy(*KEY).agg(F.sum("gc").alias("gc"), F.sum(F.col("end") - F.col("start") - F.col("partial_wait")).alias("net"))
    used = per_run.join(stages.filter(real_jobs()).select(*KEY), KEY).join(runs.select("run", "variant"), "run")
    sizes = group_sizes(runs).first()  # two numbers
    return used.withColumn("on_runs", F.lit(sizes["on_runs"])).withColumn("off_runs", F.lit(sizes["off_runs"]))


def gc_share(tasks: DataFrame, stages: DataFrame, runs: DataFrame) -> DataFrame:
    """Total mean GC of both groups and its share of the mean net task time, in percent."""
    sums = _gc_sums(tasks, stages, runs)
    per_stage = sums.groupBy("stage").agg(
        *[_side(flag, F.col(c)).alias(f"{tag}_{c}") for tag, flag in (("on", True), ("off", False)) for c in ("gc", "net")],
        F.max("on_runs").alias("on_runs"), F.max("off_runs").alias("off_runs"),
    )
    out = per_stage.agg(
        *[F.sum(F.coalesce(whole(F.col(f"{t}_gc"), F.col(f"{t}_runs")), F.lit(0))).alias(f"{t}_gc") for t in ("on", "off")],
        *[whole(F.sum(f"{t}_net"), F.max(f"{t}_runs")).alias(f"{t}_net") for t in ("on", "off")],
    )
    return out.select("on_gc", "off_gc", *[(100.0 * F.col(f"{t}_gc") / F.col(f"{t}_net")).alias(f"{t}_share") for t in ("on", "off")])


def gc_report(tasks: DataFrame, stages: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of the appended text report: one line per stage, then totals and shares."""
    per_stage = compare_gc(tasks, stages, runs).select(F.format_string("Stage %d, gcTime", "stage").alias("item"), F.col("on_gc").cast("double").alias("on"), F.col("off_gc").cast("double").alias("off"))
    share = gc_share(tasks, stages, runs)
    totals = share.select(F.inline(F.array(
        F.struct(F.lit("Total GC Time").alias("item"), F.col("on_gc").cast("double").alias("on"), F.col("off_gc").cast("double").alias("off")),
        F.struct(F.lit("GC Time Percentage").alias("item"), F.col("on_share").alias("on"), F.col("off_share").alias("off")),
    )))
    return per_stage.unionByName(totals)
