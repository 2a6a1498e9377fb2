import os

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from brookmill.plans import all_queries, telemetry_queries
from brookmill.session import cut_by_kind
from brookmill.sources import eventlog, reports


@pytest.mark.parametrize("name", ["run_report_scan", "event_log_scan"])
def test_written_lines_are_compressed(spark, sf_dir, tmp_path, monkeypatch, name):
    monkeypatch.setattr(telemetry_queries, "scratch_path", lambda _, label: str(tmp_path / label))
    assert all_queries()[name](spark, sf_dir).count() > 0
    files = [f for _, _, names in os.walk(tmp_path) for f in names if f.startswith("part-")]
    assert files and all(f.endswith(".txt.gz") for f in files)


RUNS = "run bigint, workload string, start bigint, `end` bigint, variant boolean"
STAGES = "run bigint, stage int, attempt int, name string, task_count int, start bigint, completion bigint, failed boolean, job int"


def _report_tables(spark, stage_rows):
    runs = spark.createDataFrame([(r, "w", 0, 9, True) for r in (1, 2, 3)], RUNS)
    stages = spark.createDataFrame([(r, s, 0, f"stage-{s}", n, 1, 5, False, 1) for r, s, n in stage_rows], STAGES)
    tasks = spark.range(60).select(
        (F.col("id") % 2 + 1).alias("run"), F.when(F.col("id") < 58, (F.col("id") % 3).cast("int")).alias("stage"), F.lit(0).alias("attempt"),
        F.concat(F.lit("t"), "id").alias("task_id"), F.col("id").alias("task_index"),
        *[F.col("id").alias(c) for c in ("fetch_wait", "initial_read", "partial_wait", "shuffle_write", "input_bytes", "start", "end", "gc")],
        F.lit("1").alias("executor"), F.lit("h").alias("host"), F.lit("Disk").alias("input_source"),
        F.lit(None).cast(f"array<{reports.WAIT_SCHEMA}>").alias("wait_periods"),
    )
    return runs, stages, tasks


def _read_back(spark, folder):
    back = reports.read_run_reports(spark, folder, glob="*.txt")
    return {
        "runs": sorted(map(tuple, back["runs"].drop("path").collect()), key=repr),
        "stages": sorted(map(tuple, back["stages"].collect()), key=repr),
        "tasks": sorted(map(tuple, back["tasks"].collect()), key=repr),
    }


@pytest.mark.parametrize("stage_rows", [
    [(1, 0, 10), (1, 1, 10), (2, 0, 10), (2, 2, 10), (3, 0, 0), (1, None, 2)], [(1, 0, 10), (1, 0, 10), (2, 1, 10)],
])
def test_reports_of_small_stages_are_the_same_either_way(spark, tmp_path, monkeypatch, stage_rows):
    tables, found, used = _report_tables(spark, stage_rows), [], []
    for name in ("_lines_by_run", "_lines_by_chunk"):
        step = getattr(reports, name)
        monkeypatch.setattr(reports, name, lambda *a, name=name, step=step: used.append(name) or step(*a))
    for plain in (reports._plain, lambda *_: False):
        monkeypatch.setattr(reports, "_plain", plain)
        folder = str(tmp_path / str(len(found)))
        reports.write_run_reports(*tables, folder)
        found.append(_read_back(spark, folder))
    # repeated stages are written as before
    assert used == ["_lines_by_chunk" if (1, 0, 10) in stage_rows[1:] else "_lines_by_run", "_lines_by_chunk"]
    assert found[0] == found[1] and len(found[0]["runs"]) >= 3 and len(found[0]["tasks"]) > 0


def test_tasks_of_small_stages_are_moved_once(spark, tmp_path, monkeypatch):
    plans, write = [], DataFrameWriter.text

    def kept(self, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "text", kept)
    reports.write_run_reports(*_report_tables(spark, [(1, 0, 10), (2, 1, 10)]), str(tmp_path / "out"))
    # one exchange of everything by run, and one of the number of lines
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 2 and "Join" not in plans[0]


def test_a_kind_tells_its_own_size(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 5, "few").otherwise("many").alias("kind"), F.xxhash64("id").alias("x"))
    kind = cut_by_kind(rows, "kind")
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert kind("few").count() == 5 and kind("many").count() == 19_995
    assert 10 * size(kind("few")) < size(kind("many"))
    assert kind("none").count() == 0 and kind("none").columns == ["x"]


def test_event_logs_are_kept_in_two_parts(spark, sf_dir, monkeypatch):
    kinds = []
    monkeypatch.setattr(eventlog, "cut_by_kind", lambda df, kind: kinds.append({r[0] for r in df.select(kind).distinct().collect()}) or cut_by_kind(df, kind))
    assert all_queries()["event_log_scan"](spark, sf_dir).count() > 0
    assert kinds == [{"task", "other"}]


def test_log_of_a_path(spark):
    want = {
        "file:/a/log=eventlog_v2_app-1/part-0": "eventlog_v2_app-1", "file:/a/eventlog_v2_x/eventlog_v2_y/z": "eventlog_v2_x",
        "file:/a/eventlog_v2_part": "file:/a/eventlog_v2_part", "file:/a/b": "file:/a/b", "file:/eventlog_v2_/b": "file:/eventlog_v2_/b",
        "file:/eventlog_v2_/eventlog_v2_q/b": "eventlog_v2_q",
    }
    paths = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r["path"]: r["log"] for r in paths.select("path", eventlog._log_of(F.col("path")).alias("log")).collect()} == want
