"""Page-view metrics over ``(ts, url, status, zip_code, user_id)``.

Every metric is one function that serves a batch table and a stream alike. Windows are
in event time and aligned to the epoch. On a stream, call :func:`with_lateness` first:
rows later than the given delay are dropped, and state of closed windows is released.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

ERROR_RATE_LIMIT = 0.05


def read_page_views(spark: SparkSession, folder: str, schema: str, **options) -> DataFrame:
    """A stream of the Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def read_page_view_lines(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of text rows (each may hold several lines)."""
    return spark.readStream.options(**options).text(folder)


def parse_page_views(rows: DataFrame, keep_malformed: bool = False) -> DataFrame:
    """``url, status, zip_code, user_id`` from ``url<TAB>status<TAB>zip<TAB>user`` lines.

    A text row is split at newlines first. Malformed lines are dropped, or kept with
    ``malformed`` true so that they can be counted.
    """
    lines = rows.select(F.explode(F.split("value", "\n")).alias("line")).filter(F.col("line") != "")
    part = F.split("line", "\t")
    cols = [F.get(part, 0).alias("url")] + [
        F.get(part, i).try_cast("int").alias(name) for i, name in ((1, "status"), (2, "zip_code"), (3, "user_id"))
    ]
    parsed = lines.select(*cols, (F.size(part) != 4).alias("_odd"))
    bad = F.col("_odd") | F.col("status").isNull() | F.col("zip_code").isNull() | F.col("user_id").isNull()
    parsed = parsed.withColumn("malformed", bad).drop("_odd")
    return parsed if keep_malformed else parsed.filter(~F.col("malformed")).drop("malformed")


def with_lateness(views: DataFrame, delay: str = "0 seconds") -> DataFrame:
    return views.withWatermark("ts", delay)


def page_counts(views: DataFrame, every: str = "1 second") -> DataFrame:
    """Views per URL in each tumbling window."""
    return views.groupBy(F.window("ts", every).alias("window"), "url").agg(F.count(F.lit(1)).alias("views"))


def sliding_page_counts(views: DataFrame, length: str = "10 seconds", slide: str = "2 seconds") -> DataFrame:
    """Views per URL in each sliding window; URLs without a view have no row."""
    return views.groupBy(F.window("ts", length, slide).alias("window"), "url").agg(F.count(F.lit(1)).alias("views"))


def error_rates(
    views: DataFrame, length: str = "30 seconds", slide: str = "2 seconds", limit: float = ERROR_RATE_LIMIT,
    float_compare: bool = False,
) -> DataFrame:
    """Share of non-200 answers per zip code, flagged when above ``limit``.

    ``float_compare`` compares in single precision, where exactly 5 % counts as above.
    """
    errors = F.sum((F.col("status") != 200).cast("bigint"))
    rate = errors / F.count(F.lit(1))
    out = views.groupBy(F.window("ts", length, slide).alias("window"), "zip_code").agg(
        F.count(F.lit(1)).alias("views"), errors.alias("errors"), rate.alias("error_rate")
    )
    shown = F.col("error_rate").cast("float").cast("double") if float_compare else F.col("error_rate")
    return out.withColumn("is_alert", shown > limit).withColumn("mark", F.when(F.col("is_alert"), "**").otherwise(""))


# fixed values: seconds per interval unit
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def interval_seconds(text: str) -> int:
    """``'15 seconds'`` -> 15, ``'2 hours'`` -> 7200."""
    count, unit = text.split()
    return int(count) * UNIT_SECONDS[unit.rstrip("s")]


def active_users(views: DataFrame, length: str = "15 seconds", slide: str = "2 seconds") -> DataFrame:
    """Distinct users in each sliding window, exactly, in two keyed steps.

    Users are first made unique per window (a keyed state that spreads over tasks), then
    counted; no window ever holds its user set in one place. On a stream the second step
    groups by the event time of the closed window, which append mode supports.
    """
    seen = views.groupBy(F.window("ts", length, slide).alias("window"), "user_id").agg(F.count(F.lit(1)).alias("_n"))
    if not views.isStreaming:
        return seen.groupBy("window").agg(F.count(F.lit(1)).alias("users"))
    # one slot per window end: slots are shifted so that they close together with the window
    shift = interval_seconds(length) % interval_seconds(slide)
    closed = F.window(F.window_time("window"), slide, slide, f"{shift} seconds")
    return seen.groupBy(closed.alias("closed")).agg(F.count(F.lit(1)).alias("users"), F.first("window").alias("window")).drop("closed")


def active_users_estimate(views: DataFrame, length: str = "15 seconds", slide: str = "2 seconds", error: float = 0.02) -> DataFrame:
    """As :func:`active_users` with a fixed-size sketch per window."""
    return views.groupBy(F.window("ts", length, slide).alias("window")).agg(F.approx_count_distinct("user_id", error).alias("users"))


def named_views(views: DataFrame, users: DataFrame) -> DataFrame:
    """Views of known users with their names (stream-static inner join)."""
    return views.join(users, "user_id")


def popular_users(views: DataFrame, users: DataFrame, every: str = "1 second", limit: int = 10, order: list[str] | None = None) -> DataFrame:
    """Batch form: the first ``limit`` named views of each tumbling window."""
    named = named_views(views, users).withColumn("window", F.window("ts", every))
    rank = F.row_number().over(W.partitionBy("window").orderBy(*(order or ["ts", "user_id"])))
    return named.withColumn("rank", rank).filter(F.col("rank") <= limit)


# fixed values: names by which a metric can be asked for
METRICS: dict[str, Callable[..., DataFrame]] = {
    "pageCounts": page_counts,
    "slidingPageCounts": sliding_page_counts,
    "errorRatePerZipCode": error_rates,
    "activeUserCount": active_users,
    "popularUsersSeen": named_views,
}


def metric(name: str, views: DataFrame, *args, **kwargs) -> DataFrame:
    if name not in METRICS:
        raise ValueError(f"invalid metric {name!r}; choose one of {', '.join(METRICS)}")
    return METRICS[name](views, *args, **kwargs)


def window_seconds(col: str = "window") -> list[Column]:
    return [F.unix_seconds(F.col(f"{col}.start")).alias("window_start"), F.unix_seconds(F.col(f"{col}.end")).alias("window_end")]


def _start(writer, checkpoint: str, live: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=live) if live else writer.trigger(availableNow=True)).start()


def write_batches(result: DataFrame, folder: str, checkpoint: str, mode: str = "append", live: str | None = None) -> StreamingQuery:
    """One folder of Parquet files per batch: ``folder/batch_id=<n>``.

    A batch that is run again replaces its own folder, so a restart leaves no doubles.
    ``live`` is a trigger interval; without it the stream ends when its input is read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return _start(result.writeStream.outputMode(mode).foreachBatch(write), checkpoint, live)


def write_first_rows(result: DataFrame, folder: str, checkpoint: str, limit: int = 10, live: str | None = None, order: list[str] | None = None) -> StreamingQuery:
    """At most ``limit`` rows of each batch, with the time of the batch: the first in
    ``order``, or any without it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        first = (batch.orderBy(*order) if order else batch).limit(limit)
        first.withColumn("batch_time", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return _start(result.writeStream.outputMode("append").foreachBatch(write), checkpoint, live)


def write_latest(result: DataFrame, folder: str, checkpoint: str, live: str | None = None) -> StreamingQuery:
    """The complete result table, replaced after every batch.

    Complete mode keeps the state of all windows: right for bounded inputs and a bounded
    set of keys. For an endless stream use :func:`with_lateness` and :func:`write_batches`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    return _start(result.writeStream.outputMode("complete").foreachBatch(write), checkpoint, live)
