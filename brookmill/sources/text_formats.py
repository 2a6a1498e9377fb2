"""Readers and writers of the line-based record formats.

Every reader takes ``mode``: ``fail`` raises on a row that does not parse, ``drop``
leaves it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import fields


def read_lines(
    spark: SparkSession, path: str, partitions: int | None = None, at_most: int | None = None, line_end: str | None = None
) -> DataFrame:
    """``value string``; ``partitions`` rebalances the rows evenly, ``at_most`` merges
    input splits without a shuffle.

    Lines end at ``\\n``, ``\\r`` or ``\\r\\n`` unless ``line_end`` names one mark.
    """
    reader = spark.read.option("lineSep", line_end) if line_end else spark.read
    lines = reader.text(path)
    if at_most:
        lines = lines.coalesce(at_most)
    return lines.repartition(partitions) if partitions else lines


def checked(df: DataFrame, valid: Column, mode: str, what: str) -> DataFrame:
    valid = F.coalesce(valid, F.lit(False))
    if mode == "drop":
        return df.filter(valid)
    if mode != "fail":
        raise ValueError(f"mode must be 'fail' or 'drop', not {mode!r}")
    return df.filter(F.when(valid, True).otherwise(F.raise_error(F.concat(F.lit(f"bad {what}: "), F.col("value"))).cast("boolean")))


def read_edges(spark: SparkSession, path: str, is_canonical: bool = False, mode: str = "fail") -> DataFrame:
    """``src bigint, dst bigint`` from white-space separated pairs; ``#`` lines are comments."""
    part = F.split(F.trim("value"), r"\s+")
    src, dst = F.get(part, 0).try_cast("bigint"), F.get(part, 1).try_cast("bigint")
    lines = read_lines(spark, path).filter(~F.col("value").startswith("#"))
    edges = checked(lines, src.isNotNull() & dst.isNotNull(), mode, "edge").select(src.alias("src"), dst.alias("dst"))
    if is_canonical:
        edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return edges


def _numbers(text: Column, mark: str) -> Column:
    return F.transform(fields(text, mark), lambda x: F.trim(x).try_cast("double"))


def _complete(vector: Column) -> Column:
    return (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())


def read_points(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """``features array<double>`` from space-separated numbers."""
    vector = _numbers(F.col("value"), " ")
    return checked(read_lines(spark, path), _complete(vector), mode, "point").select(vector.alias("features"))


def read_labeled_points(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """``label double, features array<double>`` from ``(1.0,[0.1,0.2])``."""
    pattern = r"^\(([^,\[\]]+),\[([^\]]*)\]\)$"
    label = F.regexp_extract("value", pattern, 1).try_cast("double")
    vector = _numbers(F.regexp_extract("value", pattern, 2), ",")
    return checked(read_lines(spark, path), label.isNotNull() & _complete(vector), mode, "labeled point").select(
        label.alias("label"), vector.alias("features")
    )


def read_ratings(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """``user int, product int, rating double`` from ``3,7,0.25``."""
    part = fields(F.col("value"), ",")
    cols = [F.get(part, 0).try_cast("int"), F.get(part, 1).try_cast("int"), F.get(part, 2).try_cast("double")]
    valid = cols[0].isNotNull() & cols[1].isNotNull() & cols[2].isNotNull()
    return checked(read_lines(spark, path), valid, mode, "rating").select(
        cols[0].alias("user"), cols[1].alias("product"), cols[2].alias("rating")
    )


def read_passengers(spark: SparkSession, path: str, partitions: int | None = None, mode: str = "fail") -> DataFrame:
    """``passenger bigint, flights array<bigint>`` from ``1 4|9|4``."""
    part = fields(F.col("value"), " ")
    passenger = F.get(part, 0).try_cast("bigint")
    flights = F.transform(fields(F.get(part, 1), "|"), lambda x: x.try_cast("bigint"))
    return checked(read_lines(spark, path, partitions), passenger.isNotNull() & _complete(flights), mode, "passenger").select(
        passenger.alias("passenger"), flights.alias("flights")
    )


def read_flights(spark: SparkSession, path: str, partitions: int | None = None, mode: str = "fail") -> DataFrame:
    """``flight bigint, score bigint`` from ``4 310``."""
    part = fields(F.col("value"), " ")
    flight, score = F.get(part, 0).try_cast("bigint"), F.get(part, 1).try_cast("bigint")
    return checked(read_lines(spark, path, partitions), flight.isNotNull() & score.isNotNull(), mode, "flight").select(
        flight.alias("flight"), score.alias("score")
    )


def edge_line() -> Column:
    return F.concat_ws(" ", "src", "dst")


def point_line() -> Column:
    return F.array_join(F.col("features").cast("array<string>"), " ")


def labeled_point_line() -> Column:
    return F.concat(F.lit("("), F.col("label").cast("string"), F.lit(",["), F.array_join(F.col("features").cast("array<string>"), ","), F.lit("])"))


def rating_line() -> Column:
    return F.concat_ws(",", "user", "product", "rating")


def passenger_line() -> Column:
    return F.concat(F.col("passenger").cast("string"), F.lit(" "), F.array_join(F.col("flights").cast("array<string>"), "|"))


def flight_line() -> Column:
    return F.concat_ws(" ", "flight", "score")


def page_view_line() -> Column:
    return F.concat_ws("\t", "url", "status", "zip_code", "user_id")
