"""Mileage over itineraries derived from ``lineitem``.

Each line is an itinerary of its order: it starts at flight ``l_partkey`` and takes
``l_linenumber`` legs, ``l_suppkey`` flights apart. Flights are the parts, worth
``p_size`` miles; ids past the last part are unknown flights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import mileage
from ..session import scratch_path, shuffle_partitions
from ..sources import text_formats as tf
from ..sources.sinks import write_or_force, write_text
from .registry import query, table

LEGS = """itineraries AS (SELECT row_number() OVER () AS itinerary, * FROM lineitem),
legs AS (
  SELECT itinerary, l_orderkey AS passenger, unnest(range(0, l_linenumber)) * l_suppkey + l_partkey AS flight
  FROM itineraries),
flat AS (
  SELECT passenger, CAST(sum(p_size) AS BIGINT) AS miles FROM legs JOIN part ON flight = p_partkey GROUP BY passenger),
whole AS (
  SELECT itinerary, passenger, sum(p_size) AS miles FROM legs LEFT JOIN part ON flight = p_partkey
  GROUP BY itinerary, passenger HAVING count(*) = count(p_partkey)),
complete AS (SELECT passenger, CAST(sum(miles) AS BIGINT) AS miles FROM whole GROUP BY passenger)"""


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem", spread=True)
    hops = F.sequence(F.lit(0), F.col("l_linenumber") - 1)
    flights = F.transform(hops, lambda i: F.col("l_partkey") + i * F.col("l_suppkey"))
    passengers = lines.select(F.col("l_orderkey").alias("passenger"), flights.alias("flights"))
    scores = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("flight"), F.col("p_size").cast("bigint").alias("score"))
    return passengers, scores


@query("mileage_flat", f"WITH {LEGS} SELECT passenger, miles FROM flat")
def mileage_flat(spark, sf_dir):
    return mileage.mileage_flat(*inputs(spark, sf_dir))


@query("mileage_loop", f"WITH {LEGS} SELECT passenger, miles FROM complete")
def mileage_loop(spark, sf_dir):
    return mileage.mileage_loop(*inputs(spark, sf_dir))


@query("mileage_loop_fixed", f"WITH {LEGS} SELECT passenger, miles FROM complete")
def mileage_loop_fixed(spark, sf_dir):
    return mileage.mileage_fixed_rounds(*inputs(spark, sf_dir))


@query(
    "mileage_total",
    f"""WITH {LEGS}
SELECT 'flat' AS variant, CAST(sum(miles) AS BIGINT) AS total_miles FROM flat
UNION ALL SELECT 'fixed', CAST(sum(miles) AS BIGINT) FROM complete""",
)
def mileage_total(spark, sf_dir):
    given = inputs(spark, sf_dir)
    tagged = lambda df, name: mileage.mileage_total(df).select(F.lit(name).alias("variant"), "total_miles")
    return tagged(mileage.mileage_flat(*given), "flat").unionByName(tagged(mileage.mileage_fixed_rounds(*given), "fixed"))


@query("mileage_update", f"WITH {LEGS} SELECT passenger, flat.miles + complete.miles AS miles FROM flat JOIN complete USING (passenger)")
def mileage_update(spark, sf_dir):
    """A running state of miles, to which one update per passenger is added."""
    given = inputs(spark, sf_dir)
    return mileage.update_scores(mileage.mileage_flat(*given), mileage.mileage_fixed_rounds(*given).withColumnRenamed("miles", "score"))


@query(
    "mileage_forced",
    f"WITH {LEGS} SELECT concat(passenger, ' ', miles) AS value, CAST(count(*) AS BIGINT) AS n FROM flat GROUP BY 1",
)
def mileage_forced(spark, sf_dir):
    """The result evaluated without output, then written as text and read back."""
    result, line = mileage.mileage_flat(*inputs(spark, sf_dir)), F.concat_ws(" ", "passenger", "miles")
    path = scratch_path(spark, "forced")
    for where in (None, path):
        write_or_force(result, line, where)
    return tf.read_lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "passenger_file_scan",
    f"WITH {LEGS} SELECT passenger, flight, CAST(count(*) AS BIGINT) AS n FROM legs GROUP BY passenger, flight",
)
def passenger_file_scan(spark, sf_dir):
    path = scratch_path(spark, "passengers")
    write_text(inputs(spark, sf_dir)[0], tf.passenger_line(), path)
    return mileage.legs(tf.read_passengers(spark, path, partitions=shuffle_partitions(spark))).groupBy("passenger", "flight").agg(F.count(F.lit(1)).alias("n"))


@query("flight_file_scan", "SELECT p_partkey AS flight, CAST(p_size AS BIGINT) AS score FROM part")
def flight_file_scan(spark, sf_dir):
    path = scratch_path(spark, "flights")
    write_text(inputs(spark, sf_dir)[1], tf.flight_line(), path)
    return tf.read_flights(spark, path, partitions=shuffle_partitions(spark))


@query("mileage_partitioned_file", f"WITH {LEGS} SELECT passenger, miles FROM flat")
def mileage_partitioned_file(spark, sf_dir):
    """Hash-partitioned by passenger, sorted inside partitions, written and read back."""
    path = scratch_path(spark, "miles")
    result = mileage.partitioned_result(mileage.mileage_flat(*inputs(spark, sf_dir)), shuffle_partitions(spark))
    write_text(result, F.concat_ws(" ", "passenger", "miles"), path)
    part = F.split("value", " ")
    return tf.read_lines(spark, path, at_most=shuffle_partitions(spark)).select(part[0].cast("bigint").alias("passenger"), part[1].cast("bigint").alias("miles"))
