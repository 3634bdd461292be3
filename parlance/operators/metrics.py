"""Aggregates in one pass over their table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_where(**predicates: Column) -> list[Column]:
    """One conditional count for each name."""
    return [F.count_if(F.coalesce(p, F.lit(False))).alias(name) for name, p in predicates.items()]


def rounded(c: Column, places: int = 2) -> Column:
    """Half up on the binary value, the same way in any engine."""
    return F.floor(c * 10**places + 0.5) / 10**places


def share(part: Column, whole: Column) -> Column:
    """Percent with two places; 0 for an empty whole."""
    return F.when(whole > 0, rounded(part * 100 / whole)).otherwise(F.lit(0.0))


def total(c: Column) -> Column:
    """A sum that is 0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def zero_filled_days(df: DataFrame, ts: str, first: str, days: int) -> DataFrame:
    """``day, n`` for each of ``days`` days from ``first``."""
    calendar = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.date_add(F.lit(first).cast("date"), days - 1))).alias("d")
    )
    counted = df.groupBy(F.to_date(ts).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counted, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))
