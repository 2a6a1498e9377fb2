"""Exported resource samples: ``<host>/<instance>/<metric file>`` with ``epoch: v1 [v2]`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: which folder and file of a host holds which metric
METRIC_PATHS = {
    "cpu": r"cpu[^/]*/percent-idle",
    "disk": r"disk-[^/]*/disk_octets",
    "network": r"interface-[^/]*/if_octets",
    "load": r"load[^/]*/load",
}

# folder and file names of a written metric; the instance stands behind the folder's name
METRIC_FILES = {"cpu": ("cpu", "percent-idle"), "disk": ("disk", "disk_octets"), "network": ("interface", "if_octets"), "load": ("load", "load")}

_NAMED = r"(?:[^/=]+=)?([^/]+)"
# a metric file may itself be a folder of part files
_PLACE = f"{_NAMED}/{_NAMED}/{_NAMED}" + r"(?:/part-[^/]*)?$"


def read_samples(spark: SparkSession, root: str, metric: str | None = None, skip_hosts: str = "master") -> DataFrame:
    """``host, instance, metric_path, metric, ts bigint, v1 double, v2 double``.

    Host and instance are the two folders above the file (``key=value`` names are
    accepted). The metric follows from folder and file name by ``METRIC_PATHS`` and is null
    for other files. Hosts matching ``skip_hosts`` and lines with ``nan`` are left out.
    """
    part = F.split(F.trim(F.regexp_extract("value", r":(.*)$", 1)), r"\s+")
    rows = spark.read.option("recursiveFileLookup", "true").text(root).select("value", F.col("_metadata.file_path").alias("path"))
    rows = rows.filter(F.col("value").rlike(r"^\s*\d+:") & ~F.lower("value").contains("nan"))
    # only the last four parts of a path can match; a search from its start would try every place in it, for every line
    rows = rows.withColumn("path", F.substring_index("path", "/", -4))
    name = lambda k: F.regexp_extract("path", _PLACE, k)
    placed = rows.select("value", name(1).alias("host"), name(2).alias("instance"), F.concat_ws("/", name(2), name(3)).alias("_file"),
                         F.concat_ws("/", name(1), name(2), name(3)).alias("metric_path"))
    found = F.coalesce(*[F.when(F.col("_file").rlike(f"^{pattern}"), m) for m, pattern in METRIC_PATHS.items()])
    placed = placed.withColumn("metric", found).filter(~F.col("host").rlike(skip_hosts))
    if metric:
        placed = placed.filter(F.col("metric") == metric)
    return placed.select(
        "host", "instance", "metric_path", "metric",
        F.trim(F.regexp_extract("value", r"^([^:]*):", 1)).cast("bigint").alias("ts"),
        F.get(part, 0).try_cast("double").alias("v1"),
        F.get(part, 1).try_cast("double").alias("v2"),
    )


def write_samples(samples: DataFrame, root: str) -> None:
    """One folder per host, instance and metric file, as :func:`read_samples` reads them.

    Samples of one file are dealt to as many tasks as they fill, in no order.
    """
    folder, file = (F.coalesce(*[F.when(F.col("metric") == m, names[k]) for m, names in METRIC_FILES.items()]) for k in range(2))
    rows = samples.select("host", F.concat_ws("-", folder, "instance").alias("instance"), file.alias("file"), sample_line().alias("value"))
    rows.hint("rebalance", "host", "instance", "file").write.mode("overwrite").partitionBy("host", "instance", "file").text(root)


def sample_line() -> Column:
    """``ts: v1 v2`` of a sample row."""
    return F.concat(F.col("ts").cast("string"), F.lit(": "), F.concat_ws(" ", F.col("v1").cast("string"), F.col("v2").cast("string")))
