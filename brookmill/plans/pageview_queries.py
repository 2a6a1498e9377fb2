"""Page-view metrics over ``events``, as batch tables and as real streams.

URL is the event type, status 404 for errors, zip code the last digit of the user.
Windows are hours and days, because the events span a month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.units import instant
from ..session import scratch_path
from ..sources.sinks import write_text
from ..sources.text_formats import page_view_line
from ..streaming import endless, pageviews as pv
from .registry import query, table

VIEWS = """views AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, ts, event_type AS url,
  CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status, user_id % 10 AS zip_code, user_id FROM events)"""


def spread(slide: int, length: int) -> str:
    """CTE ``w``: one row per view and window, by epoch arithmetic."""
    return f"""{VIEWS}, w AS (
  SELECT v.*, (t // {slide} - k) * {slide} AS window_start, (t // {slide} - k) * {slide} + {length} AS window_end
  FROM views v, range(0, {-(-length // slide)}) r(k) WHERE t < (t // {slide} - k) * {slide} + {length})"""


HOUR = 3600


def as_views(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", instant(F.col("ts")).alias("ts"), F.col("event_type").alias("url"),
        F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"),
        (F.col("user_id") % 10).alias("zip_code"), "user_id",
    )


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_views(table(spark, sf_dir, "events"))


def view_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table read as a file stream (a glob, since it is one file)."""
    schema = table(spark, sf_dir, "events").schema
    return as_views(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"))


PARTS = 4


def view_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The views as a stream that comes in several batches, and the lateness that covers
    one of them: each batch holds a part of the time, in no order."""
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min(F.unix_micros(instant(F.col("ts")))).alias("a"), F.max(F.unix_micros(instant(F.col("ts")))).alias("z")).first()
    span = ((ends["z"] or 0) - (ends["a"] or 0)) // PARTS + 1
    part = F.coalesce(F.floor((F.unix_micros(instant(F.col("ts"))) - F.lit(ends["a"] or 0)) / span), F.lit(0))
    folder, files = scratch_path(spark, "view-files"), max(1, events.rdd.getNumPartitions())
    for k in range(PARTS):  # files are read in the order in which they were written
        events.filter(part == k).repartition(files).write.parquet(f"{folder}/part={k}")
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")
    return as_views(live), f"{span // 1_000_000 + 1} seconds"


def latest(spark: SparkSession, sf_dir: str, metric, keys: list[str]) -> DataFrame:
    """A windowed metric of the stream in update mode: the newest version of each row."""
    live, delay = view_files(spark, sf_dir)
    folder = scratch_path(spark, "versions")
    result = metric(pv.with_lateness(live, delay))
    endless.write_updates(result, folder, scratch_path(spark, "stream-state")).awaitTermination()
    return endless.read_latest(spark, folder, ["window_start", "window_end", *keys], result.columns)


def flat(df: DataFrame) -> DataFrame:
    return df.select(*pv.window_seconds(), *[c for c in df.columns if c != "window"])


def finish(result: DataFrame, start) -> DataFrame:
    """Run a stream to the end of its input and read what it wrote."""
    spark = result.sparkSession
    folder = scratch_path(spark, "stream")
    start(result, folder, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(folder)


PAGE_COUNTS = f"WITH {spread(HOUR, HOUR)} SELECT window_start, window_end, url, CAST(count(*) AS BIGINT) AS views FROM w GROUP BY ALL"
SLIDING = f"WITH {spread(2 * HOUR, 10 * HOUR)} SELECT window_start, window_end, url, CAST(count(*) AS BIGINT) AS views FROM w GROUP BY ALL"
ERRORS = f"""WITH {spread(2 * HOUR, 30 * HOUR)}, e AS (SELECT window_start, window_end, zip_code, CAST(count(*) AS BIGINT) AS views,
  CAST(count(*) FILTER (WHERE status <> 200) AS BIGINT) AS errors FROM w GROUP BY ALL)
SELECT *, round(errors / views, 8) AS error_rate, errors / views > 0.05 AS is_alert, CASE WHEN errors / views > 0.05 THEN '**' ELSE '' END AS mark FROM e"""
ACTIVE = f"WITH {spread(2 * HOUR, 15 * HOUR)} SELECT window_start, window_end, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM w GROUP BY ALL"


@query("page_counts", PAGE_COUNTS)
def page_counts(spark, sf_dir):
    return flat(pv.page_counts(views(spark, sf_dir), "1 hour"))


@query("sliding_page_counts", SLIDING)
def sliding_page_counts(spark, sf_dir):
    return flat(pv.sliding_page_counts(views(spark, sf_dir), "10 hours", "2 hours"))


def _errors(df: DataFrame) -> DataFrame:
    return flat(pv.error_rates(df, "30 hours", "2 hours")).withColumn("error_rate", F.round("error_rate", 8))


@query("error_rate", ERRORS)
def error_rate(spark, sf_dir):
    return _errors(views(spark, sf_dir))


@query("active_users", ACTIVE)
def active_users(spark, sf_dir):
    return flat(pv.active_users(views(spark, sf_dir), "15 hours", "2 hours"))


@query("metric_dispatch", PAGE_COUNTS)
def metric_dispatch(spark, sf_dir):
    return flat(pv.metric("pageCounts", views(spark, sf_dir), "1 hour"))


@query(
    "popular_users",
    f"""WITH {spread(24 * HOUR, 24 * HOUR)}
SELECT event_id, user_id, c_name AS name, window_start, window_end FROM w JOIN customer ON user_id = c_custkey
QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY ts, event_id) <= 10""",
)
def popular_users(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    seen = pv.popular_users(views(spark, sf_dir), users, "1 day", 10, ["ts", "event_id"])
    return seen.select("event_id", "user_id", "name", *pv.window_seconds())


@query(
    "parse_page_views",
    """SELECT CASE WHEN event_type = 'signup' THEN NULL ELSE event_type END AS url,
  event_type = 'signup' AS malformed, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""",
)
def parse_page_views(spark, sf_dir):
    """Two lines per text row; sign-ups lose their status and must come out malformed."""
    whole = views(spark, sf_dir).withColumn("status", F.when(F.col("url") == "signup", "?").otherwise(F.col("status").cast("string")))
    rows = whole.select(F.concat(page_view_line(), F.lit("\n")).alias("value"))
    parsed = pv.parse_page_views(rows, keep_malformed=True)
    url = F.when(~F.col("malformed"), F.col("url"))
    return parsed.groupBy(url.alias("url"), "malformed").agg(F.count(F.lit(1)).alias("n"))


@query("stream_page_counts", PAGE_COUNTS)
def stream_page_counts(spark, sf_dir):
    return latest(spark, sf_dir, lambda v: flat(pv.page_counts(v, "1 hour")), ["url"])


@query("stream_sliding_page_counts", SLIDING)
def stream_sliding_page_counts(spark, sf_dir):
    return latest(spark, sf_dir, lambda v: flat(pv.sliding_page_counts(v, "10 hours", "2 hours")), ["url"])


@query("stream_error_rate", ERRORS)
def stream_error_rate(spark, sf_dir):
    return latest(spark, sf_dir, _errors, ["zip_code"])


@query("stream_active_users", ACTIVE)
def stream_active_users(spark, sf_dir):
    """Append mode: windows appear once the watermark has passed their end; a closing row
    lets the last ones come out."""
    live, delay = view_files(spark, sf_dir)
    folder, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    with endless.keyed_state(spark):
        endless.run_and_close(
            live, lambda v: endless.active_users_live(v, "15 hours", "2 hours"), lambda r: pv.write_batches(r, folder, state), delay, "15 hours")
    return spark.read.parquet(folder).select("window_start", "window_end", "users")


@query(
    "stream_named_views",
    "SELECT user_id, c_name AS name, CAST(count(*) AS BIGINT) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL",
)
def stream_named_views(spark, sf_dir):
    """Stream-static join, one output folder per batch."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    out = finish(pv.named_views(view_stream(spark, sf_dir), users), pv.write_batches)
    return out.groupBy("user_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_popular_users",
    f"""WITH b AS (SELECT min(epoch_us(ts)) AS a, (max(epoch_us(ts)) - min(epoch_us(ts))) // {PARTS} + 1 AS span FROM events),
n AS (SELECT (epoch_us(ts) - a) // span AS batch_id, event_id, user_id, c_name AS name, epoch_us(ts) AS us FROM b, events JOIN customer ON user_id = c_custkey)
SELECT CAST(batch_id AS INTEGER) AS batch_id, event_id, user_id, name FROM n
QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY us, event_id) <= 10""",
)
def stream_popular_users(spark, sf_dir):
    """The first ten named views of each batch; a batch is a part of the time here."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    live, _ = view_files(spark, sf_dir)
    first = lambda r, folder, state: pv.write_first_rows(r, folder, state, order=["ts", "event_id"])
    return finish(pv.named_views(live, users), first).select("batch_id", "event_id", "user_id", "name")


@query(
    "stream_text_lines",
    "SELECT event_type AS url, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type",
)
def stream_text_lines(spark, sf_dir):
    """Page-view lines written as text, read as a stream, parsed and counted."""
    folder = scratch_path(spark, "view-lines")
    write_text(views(spark, sf_dir), page_view_line(), folder)
    parsed = pv.parse_page_views(pv.read_page_view_lines(spark, folder))
    counts = parsed.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
    return finish(counts, pv.write_latest)
