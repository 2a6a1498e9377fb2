"""Miles per passenger from itineraries ``(passenger, flights array)`` and flight scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .text_ops import hash_sorted_partitions


def legs(passengers: DataFrame) -> DataFrame:
    """One row per flight taken; repeated flights stay repeated."""
    return passengers.select("passenger", F.explode("flights").alias("flight"))


def mileage_flat(passengers: DataFrame, scores: DataFrame) -> DataFrame:
    """Sum of known scores per passenger; unknown flights are skipped one by one."""
    return legs(passengers).join(scores, "flight").groupBy("passenger").agg(F.sum("score").alias("miles"))


def mileage_loop(passengers: DataFrame, scores: DataFrame, fold_every: int = 8) -> DataFrame:
    """Walk all itineraries one flight per round until none is active.

    An itinerary that meets an unknown flight is lost as a whole. The state columns ride
    through the score join, so a passenger with several itineraries is not multiplied;
    the itineraries are added up at the end. Rounds are bounded by the longest itinerary,
    and finished ones are folded every few rounds, so the plan does not grow with it.
    """
    active = passengers.filter(F.size("flights") > 0).withColumn("miles", F.lit(0).cast("bigint"))
    finished = active.select("passenger", "miles").limit(0)
    for i in range(longest_itinerary(passengers)):
        moved = cut_lineage(
            active.withColumn("flight", F.get("flights", F.lit(i))).join(scores, "flight").select(
                "passenger", "flights", (F.size("flights") - (i + 1)).alias("left"), (F.col("miles") + F.col("score")).alias("miles")
            )
        )
        finished = finished.unionByName(moved.filter("left = 0").select("passenger", "miles"))
        if (i + 1) % fold_every == 0:
            finished = cut_lineage(finished.groupBy("passenger").agg(F.sum("miles").alias("miles")))
        active = moved.filter("left > 0")
        if active.isEmpty():  # the rest met unknown flights
            break
    return finished.groupBy("passenger").agg(F.sum("miles").alias("miles"))


def longest_itinerary(passengers: DataFrame) -> int:
    return passengers.agg(F.max(F.size("flights")).alias("n")).first()["n"] or 0


def mileage_fixed_rounds(passengers: DataFrame, scores: DataFrame, cut_every: int = 8) -> DataFrame:
    """The same answer with the number of rounds known up front and no action per round.

    Itineraries that are already complete pass through with a key that spreads them and
    matches nothing, so each round is one left join on a chain without branches.
    """
    state = passengers.filter(F.size("flights") > 0).withColumn("miles", F.lit(0).cast("bigint"))
    table = scores.select(F.col("flight"), F.lit(True).alias("flying"), "score")
    for i in range(longest_itinerary(passengers)):
        leg = F.get("flights", F.lit(i))
        state = (
            state.withColumn("flying", F.size("flights") > i)
            .withColumn("flight", F.coalesce(leg, F.xxhash64("passenger", "flights")))
            .join(table, ["flight", "flying"], "left")
            .filter(~F.col("flying") | F.col("score").isNotNull())
            .select("passenger", "flights", (F.col("miles") + F.coalesce("score", F.lit(0))).alias("miles"))
        )
        if cut_every and (i + 1) % cut_every == 0:
            state = cut_lineage(state)
    return state.groupBy("passenger").agg(F.sum("miles").alias("miles"))


def update_scores(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Add per-passenger updates to a running ``miles`` state (one update per passenger)."""
    return state.join(updates, "passenger").select("passenger", (F.col("miles") + F.col("score")).alias("miles"))


def mileage_total(miles: DataFrame) -> DataFrame:
    return miles.agg(F.coalesce(F.sum("miles"), F.lit(0)).alias("total_miles"))


def partitioned_result(miles: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash-partitioned by passenger and sorted inside each partition, ready to write."""
    return hash_sorted_partitions(miles, "passenger", partitions)
