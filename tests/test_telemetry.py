import math

import pytest
from pyspark.sql import functions as F

from brookmill.functions.student import quantile, two_sided_p
from brookmill.operators import run_compare, run_resources, run_stats
from brookmill.sources import eventlog, reports, samples, sinks

TASKS = (
    "run string, stage int, attempt int, task_id string, task_index bigint, host string, executor string, start bigint, end bigint, gc bigint, fetch_wait bigint, "
    "initial_read bigint, partial_wait bigint, shuffle_write bigint, input_bytes bigint, input_source string, wait_periods array<struct<start:bigint,duration:bigint>>"
)
STAGES = "run string, stage int, attempt int, name string, job int, task_count int, start bigint, completion bigint, failed boolean"
RUNS = "run string, workload string, variant boolean, start bigint, end bigint"


def task(run, stage, i, start, duration, host="h1", source="Memory", waits=None):
    return (run, stage, 0, f"{run}-{stage}-{i}", i, host, "1", start, start + duration, 1, 2, 3, 4, 5, 10, source, waits)


def test_integer_mean_and_deviation(spark):
    tasks = spark.createDataFrame([task("r", 1, i, 0, d) for i, d in enumerate([1, 2, 2])], TASKS)
    stages = spark.createDataFrame([("r", 1, 0, "s", 1, 3, 0, 2, False)], STAGES)
    row = run_stats.stage_stats(tasks, stages).first()
    assert (row["mean"], row["variance"], row["std"], row["total"], row["shortest"], row["longest"]) == (1, 0, 0, 5, 1, 2)


def test_stage_stats_of_one_dominant_stage(spark):
    durations = [((i * 7919) % 1000) * 10**6 for i in range(1000)]
    tasks = spark.createDataFrame([task("r", 1, i, 5, d) for i, d in enumerate(durations)] + [task("r", 2, 0, 0, 9)], TASKS)
    stages = spark.createDataFrame([("r", 1, 0, "s", 1, 1000, 0, 2, False), ("r", 2, 0, "t", 1, 1, 0, 2, False)], STAGES)
    row = run_stats.stage_stats(tasks, stages).filter("stage = 1").first()
    ordered, m = sorted(durations), sum(durations) // 1000
    assert (row["p5"], row["median"], row["p95"]) == (ordered[50], ordered[500], ordered[950])
    assert row["variance"] == sum((d - m) ** 2 for d in durations) // 1000
    assert row["std"] == round(math.sqrt(row["variance"]))


def test_runs_with_a_failed_stage_are_left_out(spark):
    runs = spark.createDataFrame([("a", "w", True, 0, 0), ("b", "w", False, 0, 0), ("c", "w", False, 0, 0)], RUNS)
    stages = spark.createDataFrame(
        [("a", 1, 0, "s", 1, 2, 10, 30, False), ("a", 2, 0, "s", 1, 0, 0, 99, False), ("b", 1, 0, "s", 1, 2, 5, 9, False),
         ("b", 2, 0, "s", 1, 2, 5, 9, True), ("c", 1, 0, "s", 0, 2, 5, 9, False)], STAGES)
    got = {r["run"]: (r["start"], r["end"], r["runtime"]) for r in run_stats.run_table(runs, stages).collect()}
    assert got == {"a": (10, 30, 20), "c": (5, 9, 4)}
    assert [r["run"] for r in run_stats.run_table(runs, stages, run_stats.real_jobs()).collect()] == ["a"]


def test_host_timeline_fills_idle_hosts_seen_before(spark):
    stages = spark.createDataFrame([("r", 1, 0, "s", 1, 2, 0, 9, False), ("r", 2, 0, "s", 1, 1, 10, 19, False), ("r", 3, 0, "s", 1, 1, 20, 29, False)], STAGES)
    tasks = spark.createDataFrame([task("r", 1, 0, 1, 3, "a"), task("r", 2, 0, 11, 3, "b"), task("r", 3, 0, 21, 3, "a")], TASKS)
    got = {(r["stage"], r["host"]): (r["start"], r["end"], r["filler"]) for r in run_stats.host_timeline(tasks, stages).collect()}
    assert got == {(1, "a"): (1, 4, False), (2, "b"): (11, 14, False), (2, "a"): (10, 10, True), (3, "a"): (21, 24, False), (3, "b"): (20, 20, True)}


def test_student_values():
    assert quantile(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert quantile(0.975, 1) == pytest.approx(12.7062047364, abs=1e-7)
    assert quantile(0.025, 4.5) == pytest.approx(-quantile(0.975, 4.5))
    assert two_sided_p(2.2281388520, 10) == pytest.approx(0.05, abs=1e-9)
    assert two_sided_p(0.0, 3) == pytest.approx(1.0)
    assert math.isnan(quantile(0.975, 0.0))


def run_rows(spark, on, off):
    rows = [(f"a{i}", "w", True, 0, v, v) for i, v in enumerate(on)] + [(f"b{i}", "w", False, 0, v, v) for i, v in enumerate(off)]
    rows += [("x", "only-on", True, 0, 5, 5)]
    return spark.createDataFrame(rows, RUNS + ", runtime bigint")


def test_group_comparison(spark):
    table = run_rows(spark, [100, 110, 120, 130], [80, 82, 84, 86, 88])
    rows = run_compare.compare_report(table).collect()
    assert [r["Name"] for r in rows] == ["w"] and len(rows[0]) == 15
    row = rows[0]
    assert (row["Barrier"], row["NoBarrier"], row["BarrierSample"], row["NoBarrierSample"]) == (115.0, 84.0, 4, 5)
    assert row["SignificantDifferent"] and row["SpeedUp"] == pytest.approx(100 * 31 / 115)
    assert row["BarrierUpper"] == pytest.approx(115 + quantile(0.975, 3) * 12.909944487 / 2)
    v1, v2 = 500 / 3, 10.0
    a, b = v1 / 4, v2 / 5
    df = (a + b) ** 2 / (a * a / 3 + b * b / 4)
    s = math.sqrt(2 * ((3 * v1 + 4 * v2) / df) / (2 * 20 / 9))
    assert row["SpeedUpUpper"] == pytest.approx(100 * (31 + quantile(0.975, df) * s) / 115)
    legacy = run_compare.compare_runtimes(table, legacy_n=True).first()
    assert legacy["error"] == pytest.approx(math.sqrt(2 * legacy["mse"] / 10))


def test_equal_groups_are_not_significant(spark):
    row = run_compare.compare_report(run_rows(spark, [10, 20, 30], [11, 21, 28])).first()
    assert row["SignificantDifferent"] is False


def test_gc_divides_each_group_by_its_own_runs(spark):
    runs = spark.createDataFrame([("a", "w", True, 0, 0), ("b", "w", False, 0, 0), ("c", "w", False, 0, 0)], RUNS)
    stages = spark.createDataFrame([(r, s, 0, "s", j, 1, 0, 2, False) for r in "abc" for s, j in ((1, 1), (2, 0))], STAGES)
    tasks = spark.createDataFrame([task(r, s, i, 0, 10) for r, n in (("a", 4), ("b", 4), ("c", 2)) for s in (1, 2) for i in range(n)], TASKS)
    assert [tuple(r) for r in run_compare.compare_gc(tasks, stages, runs).collect()] == [(1, 4, 3)]
    share = run_compare.gc_share(tasks, stages, runs).first()
    assert (share["on_share"], share["off_share"]) == pytest.approx((100 * 4 / 24, 100 * 3 / 18))


def test_usage_takes_node_means_or_node_sums(spark):
    rows = [("n1", "cpu", "-", 1, 50.0, 0.0), ("n1", "cpu", "-", 2, 70.0, 0.0), ("n2", "cpu", "-", 2, 90.0, 0.0), ("n2", "cpu", "-", 9, 1.0, 0.0),
            ("master", "cpu", "-", 1, 0.0, 0.0), ("n3", "cpu", "-", 1, float("nan"), 0.0),
            ("n1", "disk", "a", 1, 10.0, 1.0), ("n1", "disk", "b", 2, 20.0, 1.0), ("n2", "disk", "a", 2, 6.0, 4.0)]
    s = spark.createDataFrame(rows, "host string, metric string, instance string, ts bigint, v1 double, v2 double")
    spans = spark.createDataFrame([("x", 1000, 2999), ("y", 20000, 30000)], "run string, start bigint, end bigint")
    got = {r["run"]: (r["idle"], r["disk_read"], r["disk_write"]) for r in run_resources.usage(s, spans, ["run"], ["idle", "disk_read", "disk_write"]).collect()}
    assert got == {"x": (75.0, 18.0, 3.0), "y": (None, None, None)}
    busy = {(r["host"], r["ts"]): r["busy"] for r in run_resources.cpu_series(s).collect()}
    assert busy[("cluster", 2)] == 20.0 and ("master", 1) not in busy
    assert run_resources.between_ms(s, 2000, 2500).count() == 4


def test_run_report_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([("a", "wc", True, 1, 9), ("b", "wc", False, 2, 8)], RUNS)
    stages = spark.createDataFrame([("a", 0, 0, "s", 1, 5, 1, 9, False), ("b", 0, 0, "s", 1, 1, 2, 8, True)], STAGES)
    tasks = spark.createDataFrame([task("a", 0, i, i, 3, waits=[(i, 7)]) for i in range(5)] + [task("b", 0, 0, 2, 1, source="Network")], TASKS)
    reports.write_run_reports(runs, stages, tasks, str(tmp_path), tasks_per_line=2)
    back = reports.read_run_reports(spark, str(tmp_path), glob="*.txt")
    assert back["tasks"].select(tasks.columns).exceptAll(tasks).isEmpty() and back["tasks"].count() == 6
    assert back["stages"].select(stages.columns).exceptAll(stages).isEmpty() and back["stages"].count() == 2
    assert {(r["run"], r["variant"], r["start"]) for r in back["runs"].collect()} == {("a", True, 1), ("b", False, 2)}
    assert run_stats.wait_intervals(back["tasks"]).count() == 5


def test_report_with_ordinal_read_method(spark, tmp_path):
    lines = ['{"name":"wc","id":"app-1","attempId":"1","start":1,"end":5,"barrier":true}', "1",
             '{"stageId":3,"stageAttemptId":0,"name":"map","taskCount":1,"startTime":1,"completionTime":4,"failed":false,"jobId":0,'
             '"tasks":[{"id":"0","index":0,"inputBytesRead":7,"inputSource":3,"host":"h","startTime":1,"endTime":3,"gcTime":0,"waitForParentPeriods":[]}]}']
    (tmp_path / "app-1-wc.json").write_text("\n".join(lines))
    (tmp_path / "notes.txt").write_text("ignored")
    back = reports.read_run_reports(spark, str(tmp_path))
    assert back["tasks"].first()["input_source"] == "Hadoop"
    run = back["runs"].first()
    assert (run["run"], run["stage_lines"]) == ("app-1", 1)


def test_samples_follow_the_folder_layout(spark, tmp_path):
    for host in ("node1", "master"):
        for place, name in (("disk-vda", "disk_octets"), ("cpu-0", "percent-idle")):
            folder = tmp_path / host / place
            folder.mkdir(parents=True)
            (folder / f"{name}.txt").write_text("header\n\n1460000000: 1.0e+01 2.0e+00\n1460000001: nan nan\n1460000002: 3\n")
    got = samples.read_samples(spark, str(tmp_path), "disk").orderBy("ts").collect()
    assert [(r["host"], r["instance"], r["ts"], r["v1"], r["v2"]) for r in got] == [
        ("node1", "disk-vda", 1460000000, 10.0, 2.0), ("node1", "disk-vda", 1460000002, 3.0, None)]


def test_written_samples_come_back_with_their_metric(spark, tmp_path):
    rows = [("n1", m, i, 100 + k, float(k), 2.0) for m in samples.METRIC_FILES for i in "ab" for k in range(3)] + [("master", "cpu", "a", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "host string, metric string, instance string, ts bigint, v1 double, v2 double")
    samples.write_samples(df, str(tmp_path / "s"))
    (tmp_path / "s" / "n1" / "swap").mkdir(parents=True)
    (tmp_path / "s" / "n1" / "swap" / "free").write_text("5: 1 2\n")
    back = samples.read_samples(spark, str(tmp_path / "s"))
    got = sorted((r["host"], r["metric"], r["instance"].split("-")[1], r["ts"], r["v1"], r["v2"]) for r in back.filter("metric IS NOT NULL").collect())
    assert got == sorted(r for r in rows if r[0] != "master")
    assert [r["metric_path"] for r in back.filter("metric IS NULL").collect()] == ["n1/swap/free"]
    assert samples.read_samples(spark, str(tmp_path / "s"), "load").count() == 6


def test_series_of_overlapping_runs(spark):
    s = spark.createDataFrame([(h, "cpu", "a", t, float(t), 0.0) for h in ("n1", "n2") for t in range(0, 100, 10)] + [("n1", "cpu", "b", 10, 30.0, 0.0), ("n1", "load", "a", 20, 1.0, 0.0)],
                              "host string, metric string, instance string, ts bigint, v1 double, v2 double")
    runs = spark.createDataFrame([("r", 10_000, 30_999), ("q", 0, 90_000), ("none", 200_000, 300_000)], "run string, start bigint, end bigint")
    got = {(r["run"], r["host"], r["at"]): r["v"] for r in run_resources.run_series(s, runs, "cpu", {"v": F.col("v1")}).collect()}
    assert {k: v for k, v in got.items() if k[0] == "r"} == {
        ("r", "n1", 0): 20.0, ("r", "n2", 0): 10.0, ("r", "cluster", 0): pytest.approx(50 / 3),
        **{("r", h, t): t + 10.0 for h in ("n1", "n2", "cluster") for t in (10, 20)}}
    assert sum(k[0] == "q" for k in got) == 30 and not any(k[0] == "none" for k in got)


def test_statistics_file_and_appended_report(spark, tmp_path):
    df = spark.createDataFrame([(2, 1234567.0, 0.5), (1, 12.345, 2.0)], "StageId int, Size double, Ratio double")
    sinks.write_statistics(df, str(tmp_path / "csv"), {"Size": "#,### MB", "Ratio": "#.##"}, ["StageId"])
    text = next((tmp_path / "csv").glob("part-*.csv")).read_text().splitlines()
    assert text == ["StageId,Size,Ratio", "1,12 MB,2", '2,"1,234,567 MB",0.5']
    for _ in range(2):
        sinks.append_report(df, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 4
    sinks.write_or_force(df, F.col("StageId").cast("string"), None)
    sinks.write_or_force(df, F.col("StageId").cast("string"), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 2


def test_own_event_log(spark, event_log_dir):
    """The log this very session writes: ids, counts and times must be consistent."""
    spark.range(0, 1000, 1, 3).groupBy((F.col("id") % 5).alias("k")).count().collect()
    found = eventlog.read_event_log(spark, f"file:{event_log_dir}", "spark.app.name")
    run = found["runs"].first()
    assert run["run"] == spark.sparkContext.applicationId and run["variant"] == "tests"
    stages, tasks = found["stages"], found["tasks"]
    assert stages.filter("job >= 0 AND completion >= start").count() > 0
    per = tasks.groupBy("run", "stage", "attempt").agg(F.count("*").alias("n"))
    both = stages.join(per, ["run", "stage", "attempt"]).filter("NOT failed").select("task_count", "n").collect()
    assert both and all(r["task_count"] == r["n"] for r in both)
    assert run_stats.stage_stats(tasks, stages).count() > 0


def test_selected_runs_leave_out_job_zero_and_extremes(spark):
    runs = spark.createDataFrame([(f"r{k:02d}", "w", True, 0, 0) for k in range(10)], "run string, workload string, variant boolean, start bigint, end bigint")
    rows = [(f"r{k:02d}", s, 0, "n", s, 1, 1_000 * s, 1_000 * s + 10 + k if s else 9_000, False) for k in range(10) for s in (0, 1, 2)]
    stages = spark.createDataFrame(rows, "run string, stage int, attempt int, name string, job int, task_count int, start bigint, completion bigint, failed boolean")
    got = {r["run"]: (r["start"], r["end"], r["runtime"]) for r in run_stats.selected_runs(runs, stages).collect()}
    assert got == {f"r{k:02d}": (1_000, 2_010 + k, 1_010 + k) for k in range(1, 10)}
    assert run_stats.selected_runs(runs, stages, percent=0).count() == 10
    assert {r["runtime"] for r in run_stats.run_table(runs, stages).collect()} == {9_000}


def test_usage_leaves_out_whole_lines_that_are_not_numbers(spark):
    samples = spark.createDataFrame([("h", "network", "a", 5, float("nan"), 7.0), ("h", "network", "a", 6, 2.0, 3.0)], "host string, metric string, instance string, ts bigint, v1 double, v2 double")
    spans = spark.createDataFrame([("x", 5_000, 6_000)], "run string, start bigint, end bigint")
    row = run_resources.usage(samples, spans, ["run"], ["download", "upload"]).first()
    assert (row["download"], row["upload"]) == (2.0, 3.0)
