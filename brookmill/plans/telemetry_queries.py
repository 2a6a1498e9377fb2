"""Run telemetry over the provided tables.

A supplier stands for an application run, its region for the workload, the parity of its
key for the group label. Each ``lineitem`` row is one task; the line number is the stage.
Runs of suppliers in debt have a failed first stage. ``orders`` rows stand for resource
samples: customer key gives the host, order priority the metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.units import busy_percent, epoch_ms
from ..operators import intervals, run_compare, run_resources, run_stats
from ..session import cut_lineage, scratch_path
from ..sources import eventlog, reports, samples as sample_files
from ..sources.sinks import append_report, formatted, write_statistics
from .registry import ORACLES, query, table

TASKS = """tasks AS (
  SELECT l_suppkey AS run, l_linenumber AS stage, 0 AS attempt,
    concat_ws('-', l_orderkey, l_partkey, l_linenumber) AS task_id,
    concat('node-', l_partkey % 8) AS host,
    epoch_ms(l_shipdate) AS start,
    epoch_ms(l_shipdate) + CAST(floor(l_extendedprice) AS BIGINT) AS "end",
    CAST(floor(l_tax * 1000) AS BIGINT) AS gc,
    CAST(floor(l_discount * 1000) AS BIGINT) AS fetch_wait,
    CAST(floor(l_quantity) AS BIGINT) AS initial_read,
    CAST(floor(l_discount * 10000) AS BIGINT) AS partial_wait,
    CAST(floor(l_extendedprice) AS BIGINT) * 100000 AS shuffle_write,
    CAST(floor(l_quantity) AS BIGINT) * 1000000 AS input_bytes,
    CASE WHEN l_returnflag = 'A' THEN 'Memory' WHEN l_returnflag = 'N' THEN 'Hadoop'
         WHEN l_linestatus = 'F' THEN 'Disk' ELSE 'Network' END AS input_source
  FROM lineitem)"""
STAGES = TASKS + """,
stages AS (
  SELECT run, stage, attempt, concat('stage-', stage) AS name, stage % 3 AS job, CAST(count(*) AS INTEGER) AS task_count,
    min(start) AS start, max("end") AS completion, bool_or(s_acctbal < 0 AND stage = 1) AS failed
  FROM tasks JOIN supplier ON run = s_suppkey GROUP BY run, stage, attempt)"""
def _runs_sql(cond: str) -> str:
    return STAGES + f""",
runs AS (SELECT s_suppkey AS run, r_name AS workload, s_suppkey % 2 = 0 AS variant FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
run_table AS (
  SELECT r.run, workload, variant, min(start) AS start, max(completion) AS "end", max(completion) - min(start) AS runtime
  FROM runs r JOIN stages s ON r.run = s.run
  WHERE {cond} AND r.run NOT IN (SELECT run FROM stages WHERE failed) GROUP BY r.run, workload, variant)"""


def _trimmed_sql(runs_sql: str) -> str:
    return runs_sql + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY workload, variant ORDER BY runtime, run) - 1 AS rank,
    count(*) OVER (PARTITION BY workload, variant) AS n FROM run_table),
trimmed AS (SELECT run, workload, variant, start, "end", runtime FROM ranked WHERE rank BETWEEN n * 10 // 100 AND n * 90 // 100)"""


# all stages with tasks, and those of real jobs, which the reports are made of
RUNS, REAL_RUNS = _runs_sql("task_count > 0"), _runs_sql("task_count > 0 AND job > 0")
TRIMMED, REAL_TRIMMED = _trimmed_sql(RUNS), _trimmed_sql(REAL_RUNS)


def whole_number(col: Column) -> Column:
    return F.floor(col).cast("bigint")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    begun = epoch_ms(F.col("l_shipdate"))
    price, quantity = whole_number(F.col("l_extendedprice")), whole_number(F.col("l_quantity"))
    source = (
        F.when(F.col("l_returnflag") == "A", "Memory").when(F.col("l_returnflag") == "N", "Hadoop")
        .when(F.col("l_linestatus") == "F", "Disk").otherwise("Network")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("stage"), F.lit(0).alias("attempt"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("task_id"), F.col("l_orderkey").alias("task_index"),
        F.concat(F.lit("node-"), F.col("l_partkey") % 8).alias("host"), F.lit("1").alias("executor"),
        begun.alias("start"), (begun + price).alias("end"), whole_number(F.col("l_tax") * 1000).alias("gc"),
        whole_number(F.col("l_discount") * 1000).alias("fetch_wait"), quantity.alias("initial_read"),
        whole_number(F.col("l_discount") * 10000).alias("partial_wait"), (price * 100000).alias("shuffle_write"),
        (quantity * 1000000).alias("input_bytes"), source.alias("input_source"),
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), (F.col("s_acctbal") < 0).alias("debt"))
    folded = tasks(spark, sf_dir).groupBy("run", "stage", "attempt").agg(
        F.count(F.lit(1)).cast("int").alias("task_count"), F.min("start").alias("start"), F.max("end").alias("completion")
    )
    table_of_stages = folded.join(debt, "run").select(
        "run", "stage", "attempt", F.concat(F.lit("stage-"), "stage").alias("name"), (F.col("stage") % 3).alias("job"),
        "task_count", "start", "completion", (F.col("debt") & (F.col("stage") == 1)).alias("failed"),
    )
    # a few rows per run, read several times by most queries
    return cut_lineage(table_of_stages)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("run"), F.col("r_name").alias("workload"), (F.col("s_suppkey") % 2 == 0).alias("variant"),
                F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"))
    )


def run_table(spark: SparkSession, sf_dir: str, stage_table: DataFrame | None = None) -> DataFrame:
    return cut_lineage(run_stats.run_table(runs(spark, sf_dir), stage_table or stages(spark, sf_dir)))


def stages_and_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All stages, and the table of valid runs."""
    stage_table = stages(spark, sf_dir)
    return stage_table, run_table(spark, sf_dir, stage_table)


def selected(spark: SparkSession, sf_dir: str, percent: int = 10) -> tuple[DataFrame, DataFrame]:
    """Stages of real jobs in the runs a report is made of, and these runs."""
    stage_table = stages(spark, sf_dir)
    run_rows = cut_lineage(run_stats.selected_runs(runs(spark, sf_dir), stage_table, percent=percent))
    return cut_lineage(valid(stage_table.filter(run_stats.real_jobs()), run_rows)), run_rows


def valid(df: DataFrame, run_rows: DataFrame) -> DataFrame:
    """Tasks or stages of valid runs only."""
    return df.join(run_rows.select("run"), "run", "left_semi")


@query("run_table", f"WITH {RUNS} SELECT run, workload, variant, start, \"end\", runtime FROM run_table")
def run_table_query(spark, sf_dir):
    return run_table(spark, sf_dir).select("run", "workload", "variant", "start", "end", "runtime")


@query(
    "run_table_real_jobs",
    f"""WITH {RUNS} SELECT run, min(start) AS start, max(completion) AS "end", max(completion) - min(start) AS runtime FROM stages
WHERE job > 0 AND task_count > 0 AND run NOT IN (SELECT run FROM stages WHERE failed) GROUP BY run""",
)
def run_table_real_jobs(spark, sf_dir):
    kept = run_stats.run_table(runs(spark, sf_dir), stages(spark, sf_dir), run_stats.real_jobs())
    return kept.select("run", "start", "end", "runtime")


_PCT = ", ".join(f"list_extract(ds, CAST(floor(n * {p}) AS INTEGER) + 1) AS {name}" for name, p in
                 {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}.items())


@query(
    "stage_stats",
    f"""WITH {STAGES}, d AS (SELECT run, stage, "end" - start AS duration FROM tasks),
s AS (SELECT run, stage, count(*) AS n, CAST(sum(duration) AS BIGINT) AS total, min(duration) AS shortest, max(duration) AS longest,
        list_sort(list(duration)) AS ds FROM d GROUP BY run, stage),
m AS (SELECT s.*, task_count, total // task_count AS mean FROM s JOIN stages USING (run, stage)),
v AS (SELECT d.run, d.stage, CAST(sum((duration - mean) * (duration - mean)) // any_value(task_count) AS BIGINT) AS variance
      FROM d JOIN m ON d.run = m.run AND d.stage = m.stage GROUP BY d.run, d.stage)
SELECT run, stage, task_count, CAST(n AS BIGINT) AS recorded, total, shortest, longest, mean, variance,
  CAST(round(sqrt(variance)) AS BIGINT) AS std, {_PCT} FROM m JOIN v USING (run, stage)""",
)
def stage_stats(spark, sf_dir):
    return run_stats.stage_stats(tasks(spark, sf_dir), stages(spark, sf_dir)).drop("attempt")


_IO = ", ".join(f"CAST(sum(CASE WHEN input_source = '{m}' THEN input_bytes ELSE 0 END) AS BIGINT) AS {m.lower()}_bytes"
                for m in ("Memory", "Hadoop", "Disk", "Network"))
_WAITS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("fetch_wait", "initial_read", "partial_wait", "shuffle_write", "gc"))


@query("stage_io", f"""WITH {TASKS} SELECT run, stage, {_WAITS}, CAST(sum("end" - start) AS BIGINT) AS task_time, {_IO} FROM tasks GROUP BY run, stage""")
def stage_io(spark, sf_dir):
    return run_stats.stage_io(tasks(spark, sf_dir)).drop("attempt")


@query("stage_runtime", f"WITH {STAGES} SELECT run, stage, completion - start AS runtime, failed FROM stages")
def stage_runtime(spark, sf_dir):
    return run_stats.stage_runtime(stages(spark, sf_dir)).select("run", "stage", "runtime", "failed")


@query("trimmed_runs", f"WITH {TRIMMED} SELECT run, workload, variant, runtime FROM trimmed")
def trimmed_runs(spark, sf_dir):
    return run_stats.trimmed_runs(run_table(spark, sf_dir), ["workload", "variant"]).select("run", "workload", "variant", "runtime")


HOSTS = STAGES + """,
ran AS (SELECT run, stage, host, min(start) AS start, max("end") AS "end" FROM tasks GROUP BY run, stage, host),
ordered AS (SELECT run, stage, start, row_number() OVER (PARTITION BY run ORDER BY job, start, stage, attempt) AS ord FROM stages WHERE task_count > 0),
first_use AS (SELECT r.run, host, min(ord) AS first_ord FROM ran r JOIN ordered o ON r.run = o.run AND r.stage = o.stage GROUP BY r.run, host)"""


@query(
    "host_timeline",
    f"""WITH {HOSTS} SELECT run, stage, host, start, "end", false AS filler FROM ran
UNION ALL
SELECT o.run, o.stage, f.host, o.start, o.start, true FROM ordered o JOIN first_use f ON o.run = f.run AND f.first_ord < o.ord
WHERE NOT EXISTS (SELECT 1 FROM ran r WHERE r.run = o.run AND r.stage = o.stage AND r.host = f.host)""",
)
def host_timeline(spark, sf_dir):
    return run_stats.host_timeline(tasks(spark, sf_dir), stages(spark, sf_dir)).drop("attempt")


@query("stage_intervals", f'WITH {STAGES} SELECT run, stage, start, completion AS "end" FROM stages WHERE task_count > 0')
def stage_intervals(spark, sf_dir):
    return run_stats.stage_intervals(stages(spark, sf_dir)).drop("attempt")


@query(
    "wait_intervals",
    f"""WITH {TASKS} SELECT run, stage, host, task_id, start + w AS start, start + w + partial_wait AS "end"
FROM tasks, (VALUES (0), (10)) waits(w) WHERE partial_wait > 0""",
)
def wait_intervals(spark, sf_dir):
    period = lambda shift: F.struct((F.col("start") + shift).alias("start"), F.col("partial_wait").alias("duration"))
    waits = F.when(F.col("partial_wait") > 0, F.array(period(0), period(10)))
    return run_stats.wait_intervals(tasks(spark, sf_dir).withColumn("wait_periods", waits)).drop("attempt")


@query(
    "worker_numbers",
    f"""WITH {TASKS} SELECT run, host, concat('Worker-', dense_rank() OVER (PARTITION BY run ORDER BY host)) AS worker
FROM (SELECT DISTINCT run, host FROM tasks)""",
)
def worker_numbers(spark, sf_dir):
    return run_stats.worker_numbers(tasks(spark, sf_dir))


@query(
    "job_end_markers",
    f"""WITH {STAGES}, j AS (SELECT run, job, max(completion) AS job_end FROM stages WHERE task_count > 0 GROUP BY run, job)
SELECT run, job, job_end FROM j WHERE job < (SELECT max(job) FROM j k WHERE k.run = j.run)""",
)
def job_end_markers(spark, sf_dir):
    return run_stats.job_end_markers(stages(spark, sf_dir))


@query(
    "average_timeline",
    f"""WITH {REAL_TRIMMED} SELECT s.job, s.stage, CAST(sum(s.start - r.start) // count(*) AS BIGINT) AS start,
  CAST(sum(s.completion - r.start) // count(*) AS BIGINT) AS completion, CAST(count(*) AS BIGINT) AS runs
FROM stages s JOIN trimmed r ON s.run = r.run WHERE task_count > 0 AND job > 0 GROUP BY s.job, s.stage""",
)
def average_timeline(spark, sf_dir):
    return run_stats.average_timeline(*selected(spark, sf_dir))


@query(
    "runtime_stats",
    f"""WITH {REAL_TRIMMED}, s AS (SELECT workload, variant, list_sort(list(runtime)) AS xs, count(*) AS n, avg(runtime) AS mean, stddev_samp(runtime) AS std
  FROM trimmed GROUP BY workload, variant),
p AS (SELECT *, 0.5::DOUBLE * n + 0.5::DOUBLE AS m, 0.9::DOUBLE * n + 0.9::DOUBLE AS q FROM s)
SELECT workload, variant, CAST(n AS BIGINT) AS n, round(mean, 2) AS mean, round(std, 2) AS std,
  round(CASE WHEN m < 1 THEN xs[1] WHEN m >= n THEN xs[n] ELSE xs[CAST(floor(m) AS INTEGER)] + (m - floor(m)) * (xs[CAST(floor(m) AS INTEGER) + 1] - xs[CAST(floor(m) AS INTEGER)]) END, 2) AS median,
  round(CASE WHEN q < 1 THEN xs[1] WHEN q >= n THEN xs[n] ELSE xs[CAST(floor(q) AS INTEGER)] + (q - floor(q)) * (xs[CAST(floor(q) AS INTEGER) + 1] - xs[CAST(floor(q) AS INTEGER)]) END, 2) AS p90
FROM p""",
)
def runtime_stats(spark, sf_dir):
    rows, by = selected(spark, sf_dir)[1], ["workload", "variant"]
    out = run_compare.runtime_moments(rows, by).join(run_compare.runtime_percentiles(rows, by), by)
    return out.select(*by, "n", *[F.round(c, 2).alias(c) for c in ("mean", "std", "median", "p90")])


COMPARED = REAL_TRIMMED + """,
side AS (SELECT workload, variant, count(*)::DOUBLE AS n, avg(runtime) AS mean, var_samp(runtime) AS var FROM trimmed GROUP BY workload, variant),
pair AS (SELECT a.workload, a.n AS n1, b.n AS n2, a.mean AS m1, b.mean AS m2, a.var AS v1, b.var AS v2
  FROM side a JOIN side b ON a.workload = b.workload AND a.variant AND NOT b.variant),
df AS (SELECT *, (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / (v1 * v1 / (n1 * n1 * (n1 - 1)) + v2 * v2 / (n2 * n2 * (n2 - 1))) AS freedom FROM pair)"""


@query(
    "runtime_compare",
    f"""WITH {COMPARED} SELECT workload, CAST(n1 AS BIGINT) AS on_n, CAST(n2 AS BIGINT) AS off_n, round(m1, 2) AS on_mean, round(m2, 2) AS off_mean,
  round(m1 - m2, 2) AS diff, round(freedom, 6) AS freedom, round((m2 - m1) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
  round(sqrt(2 * ((v1 * (n1 - 1) + v2 * (n2 - 1)) / freedom) / (2 * n1 * n2 / (n1 + n2))) / 1e6, 6) AS error_ks,
  round(100 * (m1 - m2) / m1, 6) AS speedup FROM df""",
)
def runtime_compare(spark, sf_dir):
    out = run_compare.compare_runtimes(selected(spark, sf_dir)[1])
    return out.select(
        "workload", "on_n", "off_n", *[F.round(c, 2).alias(c) for c in ("on_mean", "off_mean", "diff")],
        F.round("freedom", 6).alias("freedom"), F.round("t", 6).alias("t"), F.round(F.col("error") / 1e6, 6).alias("error_ks"),
        F.round("speedup", 6).alias("speedup"),
    )


def _quantile_sql(source: str) -> str:
    """CTE ``quantile`` (v, x): Student t at 0.975 for the degrees of freedom ``v`` of
    ``source``, by Newton steps on a Simpson integral of the density."""
    density = "exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi())"
    slices = "list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(i * x / 2000, 2) / v, -(v + 1) / 2)))"
    return f"""newton AS (SELECT DISTINCT v, 2.0::DOUBLE AS x, 0 AS k FROM {source} WHERE v > 0
  UNION ALL SELECT v, x - (0.5 - 0.975 + x / 6000 * {density} * {slices}) / ({density} * pow(1 + x * x / v, -(v + 1) / 2)), k + 1 FROM newton WHERE k < 12),
quantile AS (SELECT v, x FROM newton WHERE k = 12)"""


def _decimals_sql(x: str) -> str:
    """A number with at most two decimal places, without zeros that say nothing."""
    return f"regexp_replace(CAST(round({x}, 2) AS VARCHAR), '\\.0$', '')"


_REPORT = {
    "Barrier": "m1", "BarrierLower": "m1 - h1", "BarrierUpper": "m1 + h1", "BarrierStdDev": "sqrt(v1)", "BarrierSample": "n1",
    "NoBarrier": "m2", "NoBarrierLower": "m2 - h2", "NoBarrierUpper": "m2 + h2", "NoBarrierStdDev": "sqrt(v2)", "NoBarrierSample": "n2",
    "SpeedUp": "100 * (m1 - m2) / m1", "SpeedUpLower": "100 * (m1 - m2 - reach) / m1", "SpeedUpUpper": "100 * (m1 - m2 + reach) / m1",
}


@query(
    "runtime_compare_report",
    f"""WITH RECURSIVE {COMPARED}, sizes AS (SELECT n1 - 1 AS v FROM df UNION SELECT n2 - 1 FROM df UNION SELECT freedom FROM df), {_quantile_sql('sizes')},
r AS (SELECT df.*, a.x * sqrt(v1 / n1) AS h1, b.x * sqrt(v2 / n2) AS h2, abs((m2 - m1) / sqrt(v1 / n1 + v2 / n2)) > c.x AS differ,
  c.x * sqrt(2 * ((v1 * (n1 - 1) + v2 * (n2 - 1)) / freedom) / (2 * n1 * n2 / (n1 + n2))) AS reach
  FROM df LEFT JOIN quantile a ON a.v = n1 - 1 LEFT JOIN quantile b ON b.v = n2 - 1 LEFT JOIN quantile c ON c.v = freedom)
SELECT workload AS "Name", differ AS "SignificantDifferent", {', '.join(f'{_decimals_sql(x)} AS "{c}"' for c, x in _REPORT.items())} FROM r""",
)
def runtime_compare_report(spark, sf_dir):
    """The fifteen-column report, formatted."""
    report = run_compare.compare_report(selected(spark, sf_dir)[1])
    numbers = [c for c, t in report.dtypes if t in ("double", "bigint")]
    return formatted(report, {c: run_resources.RUNTIME_PATTERN for c in numbers})


@query(
    "mean_intervals",
    f"""WITH RECURSIVE {REAL_TRIMMED}, s AS (SELECT workload, variant, count(*) AS n, avg(runtime) AS mean, stddev_samp(runtime) AS std,
    (count(*) - 1)::DOUBLE AS v FROM trimmed GROUP BY workload, variant), {_quantile_sql('s')}
SELECT workload, variant, CAST(n AS BIGINT) AS n, round(mean, 2) AS mean, round(mean - x * std / sqrt(n), 2) AS lower, round(mean + x * std / sqrt(n), 2) AS upper
FROM s LEFT JOIN quantile ON s.v = quantile.v""",
)
def mean_intervals(spark, sf_dir):
    moments = run_compare.runtime_moments(selected(spark, sf_dir)[1], ["workload", "variant"])
    return run_compare.mean_interval(moments).select("workload", "variant", "n", *[F.round(c, 2).alias(c) for c in ("mean", "lower", "upper")])


def _exec_side(tag: str, cond: str) -> str:
    n = f"nullif(count(DISTINCT run) FILTER (WHERE {cond}), 0)"
    mb = lambda m: f"coalesce(CAST(sum(input_bytes) FILTER (WHERE {cond} AND input_source = '{m}') AS BIGINT), 0) // {n} // 1000000"
    cols = [f"coalesce({mb(m)}, 0) AS {tag}_{m.lower()}_mb" for m in ("Memory", "Hadoop", "Network", "Disk")]
    cols.append(f"coalesce(CAST(sum(\"end\" - start - partial_wait) FILTER (WHERE {cond}) AS BIGINT) // {n} // 1000, 0) AS {tag}_task_s")
    return ", ".join(cols)


@query(
    "execution_compare",
    f"""WITH {RUNS}, t AS (SELECT tasks.*, variant FROM tasks JOIN run_table r ON tasks.run = r.run)
SELECT stage, {_exec_side('on', 'variant')}, {_exec_side('off', 'NOT variant')} FROM t GROUP BY stage""",
)
def execution_compare(spark, sf_dir):
    return run_compare.compare_execution(tasks(spark, sf_dir), run_table(spark, sf_dir))


GC = REAL_RUNS + """,
t AS (SELECT tasks.*, variant FROM tasks JOIN run_table r ON tasks.run = r.run JOIN stages s ON s.run = tasks.run AND s.stage = tasks.stage WHERE s.job > 0),
sizes AS (SELECT count(*) FILTER (WHERE variant) AS n1, count(*) FILTER (WHERE NOT variant) AS n2 FROM run_table),
gc AS (SELECT stage, coalesce(CAST(sum(gc) FILTER (WHERE variant) AS BIGINT) // any_value(n1), 0) AS on_gc,
  coalesce(CAST(sum(gc) FILTER (WHERE NOT variant) AS BIGINT) // any_value(n2), 0) AS off_gc FROM t, sizes GROUP BY stage)"""


@query("gc_compare", f"WITH {GC} SELECT stage, on_gc, off_gc FROM gc")
def gc_compare(spark, sf_dir):
    return run_compare.compare_gc(tasks(spark, sf_dir), *selected(spark, sf_dir, 0))


@query(
    "gc_report",
    f"""WITH {GC}, net AS (SELECT CAST(sum("end" - start - partial_wait) FILTER (WHERE variant) AS BIGINT) // any_value(n1) AS a,
  CAST(sum("end" - start - partial_wait) FILTER (WHERE NOT variant) AS BIGINT) // any_value(n2) AS b FROM t, sizes),
total AS (SELECT sum(on_gc)::DOUBLE AS a, sum(off_gc)::DOUBLE AS b FROM gc)
SELECT concat('Stage ', stage, ', gcTime') AS item, round(on_gc::DOUBLE, 8) AS "on", round(off_gc::DOUBLE, 8) AS "off" FROM gc
UNION ALL SELECT 'Total GC Time', a, b FROM total
UNION ALL SELECT 'GC Time Percentage', round(100 * total.a / net.a, 8), round(100 * total.b / net.b, 8) FROM total, net""",
)
def gc_report(spark, sf_dir):
    out = run_compare.gc_report(tasks(spark, sf_dir), *selected(spark, sf_dir, 0))
    return out.select("item", F.round("on", 8).alias("on"), F.round("off", 8).alias("off"))


@query(
    "gc_report_log",
    f"""WITH {GC}, kinds AS (SELECT unnest(['stage', 'total']) AS kind)
SELECT kind, CASE kind WHEN 'stage' THEN CAST(stage AS VARCHAR) ELSE 'all' END AS item, CAST(sum(on_gc) AS BIGINT) AS "on", CAST(sum(off_gc) AS BIGINT) AS "off"
FROM gc, kinds GROUP BY 1, 2""",
)
def gc_report_log(spark, sf_dir):
    """Two reports one after the other in one folder, read back together."""
    path = scratch_path(spark, "report-log")
    stages_ = cut_lineage(run_compare.compare_gc(tasks(spark, sf_dir), *selected(spark, sf_dir, 0)))
    sums = [F.sum("on_gc").cast("bigint").alias("on"), F.sum("off_gc").cast("bigint").alias("off")]
    append_report(stages_.groupBy(F.lit("stage").alias("kind"), F.col("stage").cast("string").alias("item")).agg(*sums), path)
    append_report(stages_.groupBy(F.lit("total").alias("kind"), F.lit("all").alias("item")).agg(*sums), path)
    return spark.read.schema("kind string, item string, `on` bigint, `off` bigint").option("header", True).csv(path)


@query("gc_statistics_file", f"""WITH {GC} SELECT CAST(stage AS VARCHAR) AS "StageId", format('{{:,}} MB', on_gc * 1000) AS "Barrier", format('{{:,}}', off_gc * 1000) AS "NoBarrier" FROM gc""")
def gc_statistics_file(spark, sf_dir):
    """A statistics file with header and number patterns, read back as text."""
    path = scratch_path(spark, "statistics")
    rows = run_compare.compare_gc(tasks(spark, sf_dir), *selected(spark, sf_dir, 0)).select(
        F.col("stage").alias("StageId"), (F.col("on_gc") * 1000).alias("Barrier"), (F.col("off_gc") * 1000).alias("NoBarrier")
    )
    write_statistics(rows, path, {"Barrier": "#,### MB", "NoBarrier": run_resources.USAGE_PATTERN}, ["StageId"])
    return spark.read.schema("StageId string, Barrier string, NoBarrier string").option("header", True).csv(path)


@query(
    "relative_times",
    f"""WITH {RUNS} SELECT s.run, stage, s.start - r.start AS start, completion - r.start AS completion FROM stages s JOIN run_table r ON s.run = r.run""",
)
def relative_times(spark, sf_dir):
    return run_stats.relative_times(*stages_and_runs(spark, sf_dir)).select("run", "stage", "start", "completion")


# ---- resource samples ---------------------------------------------------------------

METRIC_OF = {"1-URGENT": "cpu", "2-HIGH": "load", "3-MEDIUM": "network", "4-NOT SPECIFIED": "disk", "5-LOW": "cpu"}
SAMPLES = """samples AS (
  SELECT CASE WHEN o_custkey % 9 = 8 THEN 'master' ELSE concat('node-', o_custkey % 9) END AS host,
    CASE o_orderpriority WHEN '2-HIGH' THEN 'load' WHEN '3-MEDIUM' THEN 'network' WHEN '4-NOT SPECIFIED' THEN 'disk' ELSE 'cpu' END AS metric,
    CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS instance,
    epoch_ms(o_orderdate) // 1000 + o_orderkey % 3600 AS ts,
    CASE WHEN o_orderstatus = 'P' THEN 'nan'::DOUBLE ELSE floor(o_totalprice) % 100 END AS v1,
    floor(o_totalprice) % 1000 AS v2
  FROM orders),
good AS (SELECT * FROM samples WHERE host <> 'master')"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.lit("cpu")
    for priority, name in METRIC_OF.items():
        metric = F.when(F.col("o_orderpriority") == priority, name).otherwise(metric)
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 9 == 8, "master").otherwise(F.concat(F.lit("node-"), F.col("o_custkey") % 9)).alias("host"),
        metric.alias("metric"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("instance"),
        (F.unix_seconds(F.timestamp_millis(epoch_ms(F.col("o_orderdate")))) + F.col("o_orderkey") % 3600).alias("ts"),
        F.when(F.col("o_orderstatus") == "P", float("nan")).otherwise((F.floor("o_totalprice") % 100).cast("double")).alias("v1"),
        (F.floor("o_totalprice") % 1000).cast("double").alias("v2"),
    )


def _usage_sql(name: str, spans: str, ids: str, measures: dict[str, tuple[str, str, str]]) -> str:
    """CTEs ``<name>``: node value first, then the mean over nodes, per interval."""
    per = [f"{agg}({v}) FILTER (WHERE metric = '{metric}' AND NOT isnan(v1) AND NOT isnan(v2)) AS {m}" for m, (metric, v, agg) in measures.items()]
    return f"""{name}_node AS (SELECT {ids}, host, {', '.join(per)} FROM {spans} i
  JOIN good s ON s.ts BETWEEN i.start // 1000 AND i."end" // 1000 GROUP BY {ids}, host),
{name} AS (SELECT {ids}, {', '.join(f'avg({m}) AS {m}' for m in measures)} FROM {name}_node GROUP BY {ids})"""


_ALL = {"idle": ("cpu", "v1", "avg"), "load": ("load", "v1", "avg"), "download": ("network", "v1", "sum"), "upload": ("network", "v2", "sum")}
_SPANS = RUNS + ', spans AS (SELECT run, stage, start, completion AS "end" FROM stages WHERE task_count > 0), ' + SAMPLES
_REAL_SPANS = REAL_TRIMMED + ', spans AS (SELECT run, stage, start, completion AS "end" FROM stages WHERE task_count > 0 AND job > 0), ' + SAMPLES


@query(
    "stage_usage",
    f"""WITH {_SPANS}, {_usage_sql('used', 'spans', 'run, stage', _ALL)}
SELECT run, stage, {', '.join(f'round({m}, 7) AS {m}' for m in _ALL)} FROM spans LEFT JOIN used USING (run, stage)""",
)
def stage_usage(spark, sf_dir):
    out = run_resources.stage_usage(samples(spark, sf_dir), stages(spark, sf_dir), list(_ALL))
    return out.select("run", "stage", *[F.round(m, 7).alias(m) for m in _ALL])


def _report_sql(first: str, second: str, measures: dict[str, tuple[str, str, str]]) -> str:
    return f"""WITH {_REAL_SPANS}, valid_spans AS (SELECT spans.* FROM spans JOIN trimmed USING (run)),
{_usage_sql('used', 'valid_spans', 'run, stage', measures)},
{_usage_sql('whole', 'trimmed', 'run', measures)}
SELECT stage, concat('stage-', stage) AS name, round(avg({first}), 7) AS {first}, round(avg({second}), 7) AS {second} FROM used
WHERE {first} IS NOT NULL AND {second} IS NOT NULL GROUP BY stage
UNION ALL SELECT -1, 'App', round(avg({first}), 7), round(avg({second}), 7) FROM whole WHERE {first} IS NOT NULL AND {second} IS NOT NULL"""


_DISK = {"disk_read": ("disk", "v1", "sum"), "disk_write": ("disk", "v2", "sum")}
_NET = {"download": ("network", "v1", "sum"), "upload": ("network", "v2", "sum")}


@query("disk_report", _report_sql("disk_read", "disk_write", _DISK))
def disk_report(spark, sf_dir):
    out = run_resources.disk_report(samples(spark, sf_dir), *selected(spark, sf_dir))
    return out.select("stage", "name", *[F.round(c, 7).alias(c) for c in _DISK])


@query("network_report", _report_sql("download", "upload", _NET))
def network_report(spark, sf_dir):
    out = run_resources.network_report(samples(spark, sf_dir), *selected(spark, sf_dir))
    return out.select("stage", "name", *[F.round(c, 7).alias(c) for c in _NET])


def _series_sql(metric: str, cols: dict[str, str], keys: str) -> str:
    ok = " AND ".join(f"NOT isnan({e})" for e in cols.values())
    means = ", ".join(f"round(avg({e}), 7) AS {n}" for n, e in cols.items())
    rows = f"FROM good WHERE metric = '{metric}' AND {ok}"
    return f"WITH {SAMPLES} SELECT host, {keys}, {means} {rows} GROUP BY host, {keys} UNION ALL SELECT 'cluster', {keys}, {means} {rows} GROUP BY {keys}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("cpu_series", _series_sql("cpu", {"busy": "100 - v1"}, "ts"))
def cpu_series(spark, sf_dir):
    return _rounded(run_resources.cpu_series(samples(spark, sf_dir)))


@query("disk_series", _series_sql("disk", {"disk_read": "v1", "disk_write": "v2"}, "ts, instance"))
def disk_series(spark, sf_dir):
    return _rounded(run_resources.disk_series(samples(spark, sf_dir)))


@query("network_series", _series_sql("network", {"download": "v1", "upload": "v2"}, "ts"))
def network_series(spark, sf_dir):
    return _rounded(run_resources.network_series(samples(spark, sf_dir)))


_SUMMARY_STATS = ", ".join(
    f"CAST(sum({c}) AS BIGINT) // count(*) AS {c}" for c in ("mean", "shortest", "longest", "std", "p5", "p25", "median", "p75", "p95")
)


@query(
    "stage_summary",
    f"""WITH {_REAL_SPANS}, valid_spans AS (SELECT spans.* FROM spans JOIN run_table USING (run)),
{_usage_sql('used', 'valid_spans', 'run, stage', _ALL)},
d AS (SELECT run, stage, "end" - start AS duration FROM tasks),
s AS (SELECT run, stage, count(*) AS n, CAST(sum(duration) AS BIGINT) AS total, min(duration) AS shortest, max(duration) AS longest,
        list_sort(list(duration)) AS ds FROM d GROUP BY run, stage),
m AS (SELECT s.*, total // n AS mean FROM s),
v AS (SELECT d.run, d.stage, CAST(sum((duration - mean) * (duration - mean)) // any_value(n) AS BIGINT) AS variance
      FROM d JOIN m ON d.run = m.run AND d.stage = m.stage GROUP BY d.run, d.stage),
st AS (SELECT run, stage, n, total, shortest, longest, mean, CAST(round(sqrt(variance)) AS BIGINT) AS std, {_PCT} FROM m JOIN v USING (run, stage)),
io AS (SELECT run, stage, {_WAITS}, {_IO} FROM tasks GROUP BY run, stage),
x AS (SELECT * FROM st JOIN io USING (run, stage) JOIN used USING (run, stage) JOIN (SELECT run, stage, "end" - start AS runtime FROM spans) USING (run, stage)
      WHERE idle IS NOT NULL AND load IS NOT NULL AND upload IS NOT NULL AND download IS NOT NULL)
SELECT stage, concat('stage-', stage) AS name, CAST(sum(n) AS BIGINT) // count(*) AS task_count, {_SUMMARY_STATS},
  CAST(sum(total) AS BIGINT) // count(*) // 1000 AS task_time_s, CAST(sum(runtime) AS BIGINT) // count(*) // 1000 AS runtime_s,
  CAST(sum(fetch_wait) AS BIGINT) // count(*) // 1000 AS fetch_wait_s, CAST(sum(shuffle_write) AS BIGINT) // count(*) // 1000000000 AS shuffle_write_s,
  round(avg(100 - idle), 7) AS cpu, round(avg(load), 7) AS load, round(avg(upload), 7) AS upload, round(avg(download), 7) AS download,
  CAST(sum(partial_wait) AS BIGINT) // count(*) // 1000 AS partial_wait_s, CAST(sum(initial_read) AS BIGINT) // count(*) // 1000 AS initial_read_s,
  {', '.join(f"CAST(sum({m}_bytes) AS BIGINT) // count(*) // 1000000 AS {m}_mb" for m in ('memory', 'hadoop', 'network', 'disk'))}
FROM x GROUP BY stage""",
)
def stage_summary(spark, sf_dir):
    return summary(spark, sf_dir).withColumns({c: F.round(c, 7) for c in ("cpu", "load", "upload", "download")})


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = selected(spark, sf_dir, 0)
    # tasks of runs and stages that are left out are not worked on
    work = tasks(spark, sf_dir).join(kept.select(*run_stats.KEY), run_stats.KEY, "left_semi")
    used = run_resources.stage_usage(samples(spark, sf_dir), kept, list(_ALL))
    return run_resources.stage_summary(kept, run_stats.stage_stats(work, kept), run_stats.stage_io(work), used)


_SUMMARY_SQL = ORACLES["stage_summary"]
_MB = ", ".join(f"format('{{:,}} MB', {c}_mb) AS \"{h}\"" for c, h in (("memory", "MemoryInput"), ("hadoop", "HadoopInput"), ("network", "NetworkInput"), ("disk", "DiskInput")))


@query(
    "stage_summary_file",
    f"""WITH summary AS ({_SUMMARY_SQL}) SELECT CAST(stage AS VARCHAR) AS "StageId", name AS "Name", CAST(task_count AS VARCHAR) AS "TaskCount",
  {', '.join(f'CAST({c} AS VARCHAR) AS "{h}"' for h, c in list(run_resources.STAGE_SUMMARY_HEADER.items())[3:9])}, {_MB} FROM summary""",
)
def stage_summary_file(spark, sf_dir):
    """The file of thirteen columns, written with its number patterns and read back as text."""
    path = scratch_path(spark, "summary")
    write_statistics(run_resources.stage_summary_file(summary(spark, sf_dir)), path, run_resources.STAGE_SUMMARY_PATTERNS, ["StageId"])
    schema = ", ".join(f"{c} string" for c in run_resources.STAGE_SUMMARY_HEADER)
    return spark.read.schema(schema).option("header", True).csv(path)


_DAYS = """days AS (SELECT event_type AS stage, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day,
  CAST(floor(min(epoch(ts))) AS BIGINT) AS "from", CAST(floor(max(epoch(ts))) AS BIGINT) AS "to" FROM events GROUP BY 1, 2)"""


@query(
    "samples_in_intervals",
    f"""WITH {_DAYS}, p AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)
SELECT event_id, stage, day FROM p JOIN days ON p.sec >= days."from" AND p.sec <= days."to" """,
)
def samples_in_intervals(spark, sf_dir):
    """Row-level range join: events inside the daily activity interval of each type."""
    at = F.floor(epoch_ms(F.col("ts")) / 1000)
    points = table(spark, sf_dir, "events").select("event_id", "event_type", at.alias("at"))
    days = points.groupBy(F.col("event_type").alias("stage"), F.floor(F.col("at") / 86400).alias("day")).agg(
        F.min("at").alias("from"), F.max("at").alias("to")
    )
    return intervals.interval_join(points.drop("event_type"), days, "at", "from", "to", 86400).select("event_id", "stage", "day")


# ---- report, sample and event-log files ---------------------------------------------



@query(
    "run_report_scan",
    f"""WITH {RUNS} SELECT CAST(t.run AS VARCHAR) AS run, workload, variant, t.stage, s.name, s.job, s.failed, input_source,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(t."end" - t.start) AS BIGINT) AS task_time, CAST(sum(gc) AS BIGINT) AS gc, CAST(sum(input_bytes) AS BIGINT) AS input_bytes
FROM tasks t JOIN runs r ON t.run = r.run JOIN stages s ON s.run = t.run AND s.stage = t.stage
GROUP BY ALL""",
)
def run_report_scan(spark, sf_dir):
    """Write one report per run, read all reports back, fold the tasks."""
    path = scratch_path(spark, "reports")
    work = tasks(spark, sf_dir).withColumn("wait_periods", F.lit(None).cast(f"array<{reports.WAIT_SCHEMA}>"))
    reports.write_run_reports(runs(spark, sf_dir), stages(spark, sf_dir), work, path, compression="gzip")
    back = reports.read_run_reports(spark, path, glob="*.txt.gz")
    folded = back["tasks"].groupBy("run", "stage", "attempt", "input_source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("task_time"), F.sum("gc").alias("gc"),
        F.sum("input_bytes").alias("input_bytes"),
    )
    named = back["stages"].select("run", "stage", "attempt", "name", "job", "failed")
    return folded.join(named, ["run", "stage", "attempt"]).join(back["runs"].select("run", "workload", "variant"), "run").drop("attempt")


# folder names of the written metrics, in SQL
_FOLDER = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{names[0]}'" for m, names in sample_files.METRIC_FILES.items()) + " END"


@query(
    "sample_file_scan",
    f"""WITH {SAMPLES} SELECT host, concat({_FOLDER}, '-', instance) AS instance, metric, CAST(count(*) AS BIGINT) AS n, CAST(sum(ts) AS BIGINT) AS ts,
  CAST(sum(v1) AS BIGINT) AS v1, CAST(sum(v2) AS BIGINT) AS v2
FROM good WHERE NOT isnan(v1) GROUP BY ALL""",
)
def sample_file_scan(spark, sf_dir):
    path = scratch_path(spark, "samples")
    sample_files.write_samples(samples(spark, sf_dir), path)
    back = sample_files.read_samples(spark, path)
    return back.groupBy("host", "instance", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ts").alias("ts"), F.sum("v1").cast("bigint").alias("v1"), F.sum("v2").cast("bigint").alias("v2")
    )


# runs that follow each other: all samples of thirty days
_BLOCK = 30 * 86400
_BLOCK_RUNS = f"""{SAMPLES}, block_runs AS (SELECT ts // {_BLOCK} AS run, min(ts) * 1000 AS start, max(ts) * 1000 AS "end" FROM samples GROUP BY 1)"""
_FOUR = {"idle": ("cpu", "v1", "avg"), "load": ("load", "v1", "avg"), "download": ("network", "v1", "sum"), "disk_read": ("disk", "v1", "sum")}


def block_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy(F.floor(F.col("ts") / _BLOCK).alias("run")).agg(
        (F.min("ts") * 1000).alias("start"), (F.max("ts") * 1000).alias("end"))


@query(
    "sample_folder_usage",
    f"""WITH {_BLOCK_RUNS}, {_usage_sql('used', 'block_runs', 'run', _FOUR)}
SELECT run, {', '.join(f'round({m}, 7) AS {m}' for m in _FOUR)} FROM block_runs LEFT JOIN used USING (run)""",
)
def sample_folder_usage(spark, sf_dir):
    """From sample folders to the usage of each run."""
    path = scratch_path(spark, "samples")
    sample_files.write_samples(samples(spark, sf_dir), path)
    used = run_resources.run_usage(sample_files.read_samples(spark, path), block_runs(spark, sf_dir), list(_FOUR))
    return used.select("run", *[F.round(m, 7).alias(m) for m in _FOUR])


@query(
    "cpu_run_series",
    f"""WITH {_BLOCK_RUNS}, met AS (SELECT run, host, ts - start // 1000 AS "at", 100 - v1 AS busy FROM block_runs i
  JOIN good s ON s.ts BETWEEN i.start // 1000 AND i."end" // 1000 WHERE metric = 'cpu' AND NOT isnan(v1))
SELECT run, host, "at", round(avg(busy), 7) AS busy FROM met GROUP BY run, host, "at"
UNION ALL SELECT run, 'cluster', "at", round(avg(busy), 7) FROM met GROUP BY run, "at" """,
)
def cpu_run_series(spark, sf_dir):
    series = run_resources.run_series(samples(spark, sf_dir), block_runs(spark, sf_dir), "cpu", {"busy": busy_percent(F.col("v1"))})
    return _rounded(series)


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application, job, stage and task events of every run as event-log JSON lines."""
    event = lambda name, *cols: F.to_json(F.struct(F.lit(name).alias("Event"), *cols)).alias("value")
    app = F.concat(F.lit("app-"), F.col("run"))
    st = stages(spark, sf_dir)
    span = cut_lineage(run_stats.run_table(runs(spark, sf_dir), st.withColumn("failed", F.lit(False))))
    begun = span.select("run", event("SparkListenerApplicationStart", app.alias("App ID"), F.col("workload").alias("App Name"), F.col("start").alias("Timestamp")))
    ended = span.select("run", event("SparkListenerApplicationEnd", F.col("end").alias("Timestamp")))
    conf = span.select("run", event("SparkListenerEnvironmentUpdate", F.create_map(F.lit("spark.variant"), F.col("variant").cast("string")).alias("Spark Properties")))
    jobs = st.groupBy("run", "job").agg(F.collect_set("stage").alias("ids"), F.min("start").alias("at")).select(
        "run", event("SparkListenerJobStart", F.col("job").alias("Job ID"), F.col("ids").alias("Stage IDs"), F.col("at").alias("Submission Time"))
    )
    info = F.struct(
        F.col("stage").alias("Stage ID"), F.col("attempt").alias("Stage Attempt ID"), F.col("name").alias("Stage Name"),
        F.col("task_count").alias("Number of Tasks"), F.col("start").alias("Submission Time"), F.col("completion").alias("Completion Time"),
        F.when(F.col("failed"), "lost").alias("Failure Reason"),
    )
    done = st.select("run", event("SparkListenerStageCompleted", info.alias("Stage Info")))
    task = F.struct(
        F.xxhash64("task_id").alias("Task ID"), F.lit(0).alias("Index"), F.col("start").alias("Launch Time"), F.col("end").alias("Finish Time"),
        F.lit("1").alias("Executor ID"), F.col("host").alias("Host"), F.lit(False).alias("Failed"), F.lit(False).alias("Killed"),
    )
    metrics = F.struct(
        F.col("gc").alias("JVM GC Time"), F.struct(F.col("input_bytes").alias("Bytes Read")).alias("Input Metrics"),
        F.struct(F.col("fetch_wait").alias("Fetch Wait Time")).alias("Shuffle Read Metrics"),
        F.struct(F.col("shuffle_write").alias("Shuffle Write Time")).alias("Shuffle Write Metrics"),
    )
    ran = tasks(spark, sf_dir).select("run", event(
        "SparkListenerTaskEnd", F.col("stage").alias("Stage ID"), F.col("attempt").alias("Stage Attempt ID"), task.alias("Task Info"), metrics.alias("Task Metrics")
    ))
    lines = begun
    for part in (ended, conf, jobs, done, ran):
        lines = lines.unionByName(part)
    return lines


@query(
    "event_log_scan",
    f"""WITH {RUNS} SELECT concat('app-', t.run) AS run, workload, CASE WHEN variant THEN 'true' ELSE 'false' END AS variant, t.stage, s.job, s.failed, host,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(t."end" - t.start) AS BIGINT) AS task_time, CAST(sum(gc) AS BIGINT) AS gc,
  CAST(sum(fetch_wait) AS BIGINT) AS fetch_wait, CAST(sum(shuffle_write) AS BIGINT) AS shuffle_write
FROM tasks t JOIN runs r ON t.run = r.run JOIN stages s ON s.run = t.run AND s.stage = t.stage GROUP BY ALL""",
)
def event_log_scan(spark, sf_dir):
    """Event logs written in the listener's JSON form, one folder per application."""
    path = scratch_path(spark, "eventlog")
    lines = _event_lines(spark, sf_dir).withColumn("app", F.col("run"))
    logs = lines.select(F.concat(F.lit("eventlog_v2_"), "app").alias("log"), "value").hint("rebalance", "log")
    logs.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").partitionBy("log").text(path)
    back = eventlog.read_event_log(spark, path, "spark.variant")
    folded = back["tasks"].groupBy("run", "stage", "attempt", "host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("task_time"), F.sum("gc").alias("gc"),
        F.sum("fetch_wait").alias("fetch_wait"), F.sum("shuffle_write").alias("shuffle_write"),
    )
    return (
        folded.join(back["stages"].select("run", "stage", "attempt", "job", "failed"), ["run", "stage", "attempt"])
        .join(back["runs"].select("run", "workload", "variant"), "run").drop("attempt")
    )
