"""Lookups of related rows, set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.sources.work import stored


def latest(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in the order given."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= keep).drop("__r")


def with_default(df: DataFrame, other: DataFrame, on, value: str, default) -> DataFrame:
    """Left join that fills missing values of one column."""
    return df.join(other, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def counts_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def signed_in(convs: DataFrame, visitors: DataFrame) -> DataFrame:
    """Conversations whose visitor left details; a semi join, so each stays once."""
    known = visitors.filter(F.col("email").isNotNull()).select(F.col("id").alias("visitor"))
    return convs.join(known, "visitor", "left_semi")


#: Rows up to which :func:`by_key` broadcasts a table, and rows of a key from which it is hot.
SMALL, HOT = 500_000, 100_000


def by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with a table of one row for each ``key``, however many rows share a key.

    A table of ``SMALL`` rows at most is broadcast.  Beyond that keys of ``HOT`` rows or
    more (one for ``HOT`` rows at most) are looked up by a broadcast of theirs alone, and
    the others by a shuffle.
    """
    if right.limit(SMALL + 1).count() <= SMALL:
        return left.join(F.broadcast(right), key, "left")
    hot = stored(left.groupBy(key).count().filter(F.col("count") >= HOT).select(key), "hot")
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    return left.join(F.broadcast(hot), key, "left_semi").join(few, key, "left").unionByName(rest)
