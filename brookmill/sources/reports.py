"""Run reports: one application line, one count line, one JSON line per stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_by_kind

# fixed values: field names of the report
APP_SCHEMA = "name string, id string, attempId string, start bigint, end bigint, barrier boolean"
WAIT_SCHEMA = "struct<start:bigint,duration:bigint>"
TASK_SCHEMA = (
    "struct<id:string,index:bigint,fetchWaitTime:bigint,initialReadTime:bigint,waitForPartialOutputTime:bigint,"
    "shuffleWriteTime:bigint,inputBytesRead:bigint,inputSource:string,executor:string,host:string,"
    f"startTime:bigint,endTime:bigint,gcTime:bigint,waitForParentPeriods:array<{WAIT_SCHEMA}>>"
)
STAGE_SCHEMA = (
    "stageId int, stageAttemptId int, taskCount int, startTime bigint, completionTime bigint, "
    f"failed boolean, jobId int, tasks array<{TASK_SCHEMA}>"
)
# fixed values: read methods, by ordinal or by name
READ_METHODS = ["None", "Memory", "Disk", "Hadoop", "Network"]

LINES_PER_FILE = 1_000

TASK_COLUMNS = {
    "id": "task_id", "index": "task_index", "fetchWaitTime": "fetch_wait", "initialReadTime": "initial_read",
    "waitForPartialOutputTime": "partial_wait", "shuffleWriteTime": "shuffle_write", "inputBytesRead": "input_bytes",
    "executor": "executor", "host": "host", "startTime": "start", "endTime": "end", "gcTime": "gc",
    "waitForParentPeriods": "wait_periods",
}


def read_run_reports(spark: SparkSession, folder: str, glob: str = "*.json") -> dict[str, DataFrame]:
    """``runs``, ``stages`` and ``tasks`` of all reports below ``folder``.

    Lines carry their own kind (application, count or stage), so files are split and
    read by many tasks like any text; nothing depends on line order. Every line is parsed
    once, into a table that is split by kind on disk. A report is a file, or the files of
    a folder named ``run_id=...``.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
        .select("value", F.col("_metadata.file_path").alias("path")).filter(F.trim("value") != "")
    )
    parsed = lines.select(
        F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*/run_id=[^/]+)/", 1), F.lit("")), F.col("path")).alias("report"),
        F.trim("value").try_cast("int").alias("stage_lines"), F.from_json("value", f"{APP_SCHEMA}, {STAGE_SCHEMA}").alias("s"),
    ).select("report", "stage_lines", "s.*")
    tag = F.when(F.col("stage_lines").isNotNull(), "count").when(F.col("stageId").isNotNull(), "stage").otherwise("app")
    kind = cut_by_kind(parsed.withColumn("kind", tag), "kind")
    apps, counts = kind("app"), kind("count").groupBy("report").agg(F.max("stage_lines").alias("stage_lines"))
    runs = apps.drop("stage_lines").join(counts, "report", "left").select(
        F.col("id").alias("run"), F.col("name").alias("workload"), F.col("attempId").alias("attempt"),
        "start", "end", F.col("barrier").alias("variant"), "stage_lines", F.col("report").alias("path"),
    )
    # one small row a report, whose size a written table tells: the long lines stay where they are
    raw = kind("stage").drop("id").join(apps.select("report", F.col("id").alias("run")), "report").select("run", F.struct("*").alias("s"))
    stages = raw.select(
        "run", F.col("s.stageId").alias("stage"), F.col("s.stageAttemptId").alias("attempt"), F.col("s.name").alias("name"),
        F.col("s.taskCount").alias("task_count"), F.col("s.startTime").alias("start"),
        F.col("s.completionTime").alias("completion"), F.col("s.failed").alias("failed"), F.col("s.jobId").alias("job"),
    ).distinct()  # a stage may be spread over several lines
    code = F.col("t.inputSource").try_cast("int")
    source = F.when(code.isNotNull(), F.get(F.array(*[F.lit(m) for m in READ_METHODS]), code)).otherwise(F.col("t.inputSource"))
    tasks = raw.select("run", F.col("s.stageId").alias("stage"), F.col("s.stageAttemptId").alias("attempt"), F.explode("s.tasks").alias("t")).select(
        "run", "stage", "attempt", *[F.col(f"t.{k}").alias(v) for k, v in TASK_COLUMNS.items()], source.alias("input_source")
    )
    return {"runs": runs, "stages": stages, "tasks": tasks}


def write_run_reports(runs: DataFrame, stages: DataFrame, tasks: DataFrame, folder: str, tasks_per_line: int = 10_000, compression: str = "none") -> None:
    """One folder per run with the application line, the count line and the stage lines.

    A stage with more than ``tasks_per_line`` tasks is written as several lines of the
    same stage, so no row grows with the size of a stage, and a run with many lines as
    several files: its lines are dealt by run and stage line, so no task writes a whole run.
    Where no stage and no run is that large, tasks are moved once.
    ``compression`` is that of the text files, which are read back with it by their names.
    """
    task = F.struct(
        *[F.col(v).alias(k) for k, v in TASK_COLUMNS.items()],
        (F.array_position(F.array(*[F.lit(m) for m in READ_METHODS]), F.col("input_source")) - 1).cast("int").alias("inputSource"),
    )
    key = ["run", "stage", "attempt"]
    head = F.to_json(F.struct(
        F.col("workload").alias("name"), F.col("run").cast("string").alias("id"), F.lit("1").alias("attempId"), "start", "end",
        F.col("variant").alias("barrier"),
    ))
    body = F.to_json(F.struct(
        F.col("stage").alias("stageId"), F.col("attempt").alias("stageAttemptId"), "name", F.col("task_count").alias("taskCount"),
        F.col("start").alias("startTime"), F.col("completion").alias("completionTime"), "failed", F.col("job").alias("jobId"), "tasks",
    ))
    write = _lines_by_run if _plain(stages, key, tasks_per_line) else _lines_by_chunk
    lines = write(runs.select("run", head.alias("value")), stages, tasks.select(*key, "task_id", task.alias("task")), body, key, tasks_per_line)
    (
        lines.sortWithinPartitions("run_id", "_deal")
        .select("run_id", "value").write.mode("overwrite").option("compression", compression).partitionBy("run_id").text(folder)
    )


def _plain(stages: DataFrame, key: list[str], tasks_per_line: int) -> bool:
    """Whether each stage is one line of its own and each run fits a file."""
    each = stages.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max("task_count").alias("task_count"))
    a_run = each.groupBy("run").agg(F.sum("rows").alias("lines"), F.max("rows").alias("rows"), F.max("task_count").alias("task_count"))
    return a_run.filter((F.col("lines") > LINES_PER_FILE) | (F.col("rows") > 1) | (F.col("task_count") > tasks_per_line)).isEmpty()


def _lines_by_run(heads: DataFrame, stages: DataFrame, tasks: DataFrame, body: Column, key: list[str], tasks_per_line: int) -> DataFrame:
    """All that belongs to a run is moved once, to the task that writes its file."""
    info = F.struct("name", "task_count", "start", "completion", "failed", "job")
    counts = stages.groupBy("run").agg(F.count(F.lit(1)).cast("string").alias("value"))
    # tasks of a null key meet no stage
    tagged = lambda df, deal: df.withColumn("_deal", F.lit(deal))
    parts = [
        tagged(heads, 0), tagged(counts, 0),
        tagged(stages.select(*key, info.alias("info")), 1), tagged(tasks.dropna(subset=key).drop("task_id"), 1),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    met = rows.repartition("run").groupBy(*key, "_deal").agg(
        F.collect_list("value").alias("value"), F.first("info", ignorenulls=True).alias("info"), F.collect_list("task").alias("tasks"))
    told = met.filter((F.col("_deal") == 0) | F.col("info").isNotNull()).select(*key, "_deal", "value", "info.*", F.when(F.size("tasks") > 0, F.col("tasks")).alias("tasks"))
    # the application line before the count line, and both before the stages
    line = F.when(F.col("_deal") == 0, F.sort_array("value", asc=False)).otherwise(F.array(body))
    return told.select(F.col("run").alias("run_id"), "_deal", F.explode(line).alias("value"))


def _lines_by_chunk(heads: DataFrame, stages: DataFrame, tasks: DataFrame, body: Column, key: list[str], tasks_per_line: int) -> DataFrame:
    """Large stages as several lines, large runs as several files; stages may repeat."""
    dealt = lambda col: F.pmod(F.xxhash64(col), F.ceil(F.greatest("task_count", F.lit(1)) / tasks_per_line))
    chunks = (
        tasks.join(stages.select(*key, "task_count"), key).withColumn("_chunk", dealt("task_id"))
        .groupBy(*key, "_chunk").agg(F.collect_list("task").alias("tasks"))
    )
    # a stage of one line meets its tasks by all that they are grouped by, so they are not moved for that
    one_line = lambda rows: rows.withColumn("_chunk", dealt("stage")).join(chunks, [*key, "_chunk"], "left")
    several = stages.filter(F.col("task_count") > tasks_per_line).select(*key).distinct()
    if several.isEmpty():
        met, counted = one_line(stages), stages.select("run")
    else:
        single, many = stages.join(several, key, "left_anti"), stages.join(several, key, "left_semi")
        met = one_line(single).unionByName(many.join(chunks, key, "left"))
        # only these need their tasks to be counted
        counted = single.select("run").unionByName(many.join(chunks.select(*key, "_chunk"), key, "left").select("run"))
    bodies = met.select("run", F.xxhash64("stage", "attempt", "_chunk").alias("_deal"), body.alias("value"))
    first = lambda df: df.withColumn("_deal", F.lit(0).cast("bigint"))
    counts = first(counted.groupBy("run").agg(F.count(F.lit(1)).alias("n")).select("run", F.col("n").cast("string").alias("value")))
    # so many files a run as its lines fill; the first file has the head
    files = counts.select("run", F.ceil(F.col("value").cast("bigint") / LINES_PER_FILE).alias("_files"))
    lines = first(heads).unionByName(counts).unionByName(bodies).join(files, "run", "left")
    part = F.pmod(F.col("_deal"), F.coalesce("_files", F.lit(1)))
    return lines.withColumn("run_id", F.col("run")).withColumn("_part", part).repartition("run_id", "_part")
