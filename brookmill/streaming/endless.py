"""Page-view metrics on streams without an end, in bounded state.

* :func:`active_users_live` keeps the open windows that users were seen in, a group of users
  at a time, and gives them up by event-time timers.
* :func:`write_updates` stores every change of a windowed result as a version of its row;
  :func:`read_latest` answers with the newest version of each key, and
  :func:`compact` folds old versions into one table.
* :func:`run_and_close` lets a stream read its input, then closes the windows that are
  still open with a row whose time lies past them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

from ..session import scratch_path
from .pageviews import _start, interval_seconds

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


USER_GROUPS = 1 << 10
NO_USER = -1  # the group of closing rows


def _packed(windows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(windows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


class OpenWindows(StatefulProcessor):
    """How many users of a group are seen for the first time in each sliding window.

    State is one table of (user, window start) per group of users, never more than
    ``length / slide`` entries a user plus those within the lateness. A timer at the end of
    the last window frees the state of a group that has gone; earlier ends are dropped
    whenever the group is seen again. Rows that come when all their windows have closed add
    nothing. A batch calls once for a group, not for a user.
    """

    def __init__(self, length: int, slide: int):
        self.length, self.slide = length * 1000, slide * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getValueState("windows", "held binary, timer bigint")

    def _seen(self, frame: pd.DataFrame, watermark: int) -> pd.DataFrame:
        """Distinct (user, start) of the windows over the rows that are still open."""
        frame = frame[frame["t"].notna()].astype({"t": "int64"})
        first, parts = frame["t"] // self.slide * self.slide, []
        for back in range(0, self.length, self.slide):
            start = first - back
            over = (start > frame["t"] - self.length) & (start + self.length > watermark)
            parts.append(pd.DataFrame({"user": frame["user"], "start": start})[over].drop_duplicates())
        return pd.concat(parts, ignore_index=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == NO_USER:
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        seen = [self._seen(frame, watermark) for frame in rows]
        packed, timer = self.windows.get() or (None, None)
        if packed is not None:
            held = pa.ipc.open_stream(bytes(packed)).read_pandas()
            seen.insert(0, held[held["start"] + self.length > watermark])
        known = len(seen[0]) if packed is not None else 0
        both = pd.concat(seen, ignore_index=True)
        fresh = ~both.duplicated()
        new = both["start"][known:][fresh[known:]].value_counts()
        if new.empty:
            return
        held = both[fresh]
        last = int(held["start"].max()) + self.length
        if last != timer:
            if timer is not None and timer > watermark:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last)
        self.windows.update((_packed(held), last))
        starts = new.index.to_numpy()
        yield pd.DataFrame({
            "closes": pd.to_datetime((starts + self.length) * 1000 - 1, unit="us", utc=True),
            "window_start": starts // 1000,
            "users": new.to_numpy(),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, timer = self.windows.get() or (None, None)
        # rows of the same batch may have opened further windows
        if timer is not None and timer <= timerValues.getCurrentWatermarkInMs():
            self.windows.clear()
        return iter(())

    def close(self) -> None:
        pass


def active_users_live(views: DataFrame, length: str = "15 seconds", slide: str = "2 seconds", groups: int = USER_GROUPS) -> DataFrame:
    """``window_start, window_end, users``: distinct users in each sliding window, once it
    has closed. ``views`` is a stream with a watermark on ``ts``; rows without a user, as
    closing rows, or without a time count for nothing. Start the query inside :func:`keyed_state`.

    Users are dealt to ``groups`` by hash (a state each, so many users want more groups; the
    number belongs to the checkpoint). The first sights of a group's users in a window are a
    row with the window's last moment as its time, so adding them up is a tumbling aggregate
    that closes together with the window.
    """
    long, step = interval_seconds(length), interval_seconds(slide)
    whole = isinstance(views.schema["user_id"].dataType, IntegralType)
    user = F.coalesce(F.col("user_id").cast("bigint" if whole else "string"), F.lit(0 if whole else ""))
    group = F.when(F.col("user_id").isNull(), NO_USER).otherwise(F.pmod(F.xxhash64(user), F.lit(groups)))
    rows = views.select("ts", F.unix_millis("ts").alias("t"), user.alias("user"), group.cast("int").alias("users_of"))
    seen = rows.groupBy("users_of").transformWithStateInPandas(
        OpenWindows(long, step), "closes timestamp, window_start bigint, users bigint", "Append", "EventTime", eventTimeColumnName="closes")
    slot = F.window("closes", slide, slide, f"{long % step} seconds")
    counted = seen.groupBy(slot.alias("slot")).agg(F.sum("users").alias("users"))
    end = F.unix_seconds("slot.end")
    return counted.select((end - long).alias("window_start"), end.alias("window_end"), "users")


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started in here keep their state in a store that holds timers and lists."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def last_event_time(query: StreamingQuery) -> dt.datetime | None:
    """The latest event time that the query has told of in its recent progress."""
    told = [p["eventTime"].get("max") for p in query.recentProgress if p.get("eventTime")]
    return max((dt.datetime.fromisoformat(t.replace("Z", "+00:00")) for t in told if t), default=None)


def run_and_close(views: DataFrame, metric: Callable[[DataFrame], DataFrame], start: Callable[[DataFrame], StreamingQuery],
                  delay: str, length: str) -> None:
    """Let ``metric`` of a stream read all its input, then close what is still open.

    ``start`` starts a query that ends when its input is read, each time with the same
    sink and checkpoint. The closing row holds nothing but a time past the last window
    and the lateness; it comes as a second source, so the views' own files stay as they are.
    """
    spark = views.sparkSession
    folder = scratch_path(spark, "closing")
    none = spark.createDataFrame([], views.schema)
    none.write.parquet(folder)
    both = views.unionByName(spark.readStream.schema(views.schema).parquet(folder)).withWatermark("ts", delay)
    query = start(metric(both))
    query.awaitTermination()
    last = last_event_time(query)
    if last is None:  # no view, no window
        return
    past = last + dt.timedelta(seconds=2 * interval_seconds(length) + interval_seconds(delay) + 1)
    moment = F.lit(past.timestamp()).cast("timestamp")
    row = spark.range(1).select(*[(moment if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in views.schema])
    row.coalesce(1).write.mode("append").parquet(folder)
    start(metric(both)).awaitTermination()


def write_updates(result: DataFrame, folder: str, checkpoint: str, live: str | None = None) -> StreamingQuery:
    """Rows that a batch has changed, as versions: ``folder/version=<batch>``.

    Update mode behind a watermark: a batch writes only what it has changed, state of
    closed windows is released, and a batch that is run again replaces its own version.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/version={batch_id}")

    return _start(result.writeStream.outputMode("update").foreachBatch(write), checkpoint, live)


def _bases(spark: SparkSession, folder: str) -> list[int]:
    """Versions up to which whole tables have been folded, the newest last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_folded")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    held = [s.getPath() for s in fs.listStatus(path)]
    done = [p.getName() for p in held if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(name.split("-")[1]) for name in done)


def read_latest(spark: SparkSession, folder: str, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The newest version of each key. Versions are map-side combined, so a key that
    changes in every batch costs one row per task."""
    rows = spark.read.parquet(folder)  # folders with a leading underscore are no versions
    bases = _bases(spark, folder)
    if bases:
        base = spark.read.parquet(f"{folder}/_folded/upto-{bases[-1]}").withColumn("version", F.lit(bases[-1]))
        rows = rows.filter(F.col("version") > bases[-1]).unionByName(base)
    rest = [c for c in (columns or rows.columns) if c not in (*keys, "version")]
    newest = F.max_by(F.struct(*rest), "version").alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def compact(spark: SparkSession, folder: str, keys: Sequence[str]) -> int:
    """Fold all versions so far into one table, and drop what it replaces.

    The folded table counts once its writer has finished; before that, readers use the
    versions. A live query goes on meanwhile: later versions are newer than the fold.
    """
    upto = spark.read.parquet(folder).agg(F.max("version").alias("v")).first()["v"]
    bases = _bases(spark, folder)
    if upto is None or (bases and bases[-1] >= upto):
        return bases[-1] if bases else -1
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    latest = read_latest(spark, folder, keys)
    latest.write.mode("overwrite").parquet(f"{folder}/_folded/upto-{upto}")
    for version in [s.getPath().getName() for s in fs.listStatus(path(""))]:
        # the newest version stays, so that the folder never looks empty
        if version.startswith("version=") and int(version.split("=")[1]) < upto:
            fs.delete(path(version), True)
    for base in bases:
        fs.delete(path(f"_folded/upto-{base}"), True)
    return upto
