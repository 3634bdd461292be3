"""Mutations as functions of tables: folds of change logs, merges, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(log: DataFrame, key: str, order: list[str], sets: list[str], adds: list[str], unset: dict[str, str] | None = None) -> DataFrame:
    """State after a log: the last value that is not null of each set column, the sum of each added one.

    ``unset`` names, for a set column, a boolean column: a row where it holds takes the
    value away unless it sets one.  Rows count in the order of ``order``, whatever order they arrive in.
    """
    at, unset = F.struct(*order), unset or {}
    touched = lambda c: F.col(c).isNotNull() | (F.coalesce(F.col(unset[c]), F.lit(False)) if c in unset else F.lit(False))
    last = [F.max_by(F.struct(c), F.when(touched(c), at))[c].alias(c) for c in sets]
    return log.groupBy(key).agg(*last, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in adds])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row for each key of either table; values of ``new`` win where it has any."""
    columns = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full")
    return joined.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns])


def update(df: DataFrame, where: Column, **values) -> DataFrame:
    """Rows with new values where a predicate holds."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, x if isinstance(x, Column) else F.lit(x)).otherwise(F.col(c)) for c, x in values.items()})


def without(df: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Rows that match no row of ``gone``; missing values match nothing."""
    return df.join(gone.select(*on).distinct(), on, "left_anti")


def get_or_create(old: DataFrame, asked: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each key of either table; ``column`` of ``asked`` wins where it has a value.

    ``created`` says that the row is new, ``patched`` that its value changed.
    """
    both = old.select(key, F.col(column).alias("was"), F.lit(True).alias("there")).join(asked.select(key, F.col(column).alias("wanted")), key, "full")
    changed = F.col("there") & F.col("wanted").isNotNull() & ~F.col("was").eqNullSafe(F.col("wanted"))
    return both.select(key, F.coalesce("wanted", "was").alias(column), F.col("there").isNull().alias("created"), F.coalesce(changed, F.lit(False)).alias("patched"))
