"""Writers. Output folders are replaced without a check, as a re-run expects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.units import pattern_number


def write_text(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def force(df: DataFrame) -> None:
    """Evaluate every row and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_or_force(df: DataFrame, line: Column, path: str | None) -> None:
    """Text output, or plain evaluation when no path is given."""
    if path:
        write_text(df, line, path)
    else:
        force(df)


def formatted(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Render numeric columns with decimal patterns such as ``#.##`` or ``#,### MB``."""
    return df.select(*[pattern_number(F.col(c), patterns[c]).alias(c) if c in patterns else F.col(c) for c in df.columns])


def write_statistics(df: DataFrame, path: str, patterns: dict[str, str] | None = None, order: list[str] | None = None) -> None:
    """One CSV file with a header. For grouped statistics: rows per stage or workload."""
    rows = formatted(df, patterns or {})
    # an exchange of finished rows, so that one task does not do what led to them
    rows = rows.orderBy(*order).coalesce(1) if order else rows.repartition(1)
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_report(df: DataFrame, path: str) -> None:
    """Add the rows of a report to the reports already in the folder."""
    df.write.mode("append").option("header", True).csv(path)
