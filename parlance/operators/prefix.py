"""Running totals within keys, without a task that holds a whole key.

A window over a key sorts all its rows in one task; a tenant with a third of all rows
makes that task grow with the table.  :func:`running` scans in two levels instead: rows
are range-partitioned by key and order, so a large key spans many parts; each part sums
its own rows; the sums of a key's parts are scanned (a row for each part); and what lies
before a part is added to its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.sources.work import stored

PART = "prefix__part"


def ordered_parts(df: DataFrame, keys: list[str], order: list[Column], name: str = "parts") -> DataFrame:
    """``df`` stored in parts by ranges of key and order; ``PART`` numbers them upwards.

    Equal keys and order values share a part, so ``order`` should end with columns that
    tell rows apart.  The table lies in the shared folder: its parts stay as they are.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *order).withColumn(PART, F.spark_partition_id()), name)


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality of all columns; nulls are equal to each other."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def carried(parts: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """For parts in which a key goes on: the key's sums over all parts before.

    At most one key goes on in a part, so there are no more rows than parts.
    """
    each = parts.groupBy(*keys, PART).agg(*[f.alias(c) for c, f in sums.items()])
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    first = F.row_number().over(W.partitionBy(*keys).orderBy(PART))
    scanned = each.withColumns({"prefix__first": first, **{c: F.sum(c).over(before) for c in sums}})
    return scanned.filter("prefix__first > 1").drop("prefix__first")


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running totals: for each name, the sum of its expression over the key's rows so far.

    The row itself is included.  Nulls count as nothing and a null key is a key like
    others.  Rows that ``order`` cannot tell apart count in any order.  Two shuffles; the
    table of what parts carry has a row for each part at most, and is broadcast.
    """
    parts = ordered_parts(df.withColumns({c: F.coalesce(x, F.lit(0)) for c, x in sums.items()}), keys, order, "running")
    so_far = W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = parts.withColumns({c: F.sum(c).over(so_far) for c in sums})
    more = carried(parts, keys, {c: F.sum(c) for c in sums}).withColumnsRenamed({c: f"prefix__{c}" for c in sums})
    both = local.join(F.broadcast(more), same(local, more, [*keys, PART]), "left")
    return both.select(*[(local[c] + F.coalesce(more[f"prefix__{c}"], F.lit(0))).alias(c) if c in sums else local[c] for c in local.columns if c != PART])
