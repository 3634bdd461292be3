"""Copies that are checked: parts, checksums without order, and a list of finished parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.sources.work import hadoop_path

PART = "copy__part"


def sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and an order-free checksum of each part: the sum of the rows' hashes."""
    return df.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("checksum"))


def in_parts(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.withColumn(PART, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


def compared(source: DataFrame, path: str, key: str, parts: int = 64) -> DataFrame:
    """``part, source, copied, complete`` for each part of ``source`` against the copy below ``path``.

    The copy is read back from its files; rows of files that cannot be read are missing.
    """
    spark = source.sparkSession
    there = sums(in_parts(source, key, parts), source.columns)
    at, files = hadoop_path(spark, f"{path}/rows")
    schema = in_parts(source, key, parts).schema
    copy = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(f"{path}/rows") if files.exists(at) else spark.createDataFrame([], schema)
    here = sums(copy, source.columns).select(PART, F.col("rows").alias("copied"), F.col("checksum").alias("sum"))
    same = (F.col("rows") == F.col("copied")) & (F.col("checksum") == F.col("sum"))
    both = there.join(here, PART, "full")
    return both.select(F.col(PART).alias("part"), F.coalesce("rows", F.lit(0)).alias("source"), F.coalesce("copied", F.lit(0)).alias("copied"), F.coalesce(same, F.lit(False)).alias("complete"))


def finished(spark, path: str) -> set[int]:
    """Parts that an earlier run has copied and checked."""
    at, files = hadoop_path(spark, f"{path}/done")
    return {int(f.getPath().getName()) for f in files.listStatus(at)} if files.exists(at) else set()


def copy(source: DataFrame, path: str, key: str, parts: int = 64, tries: int = 3, recheck: bool = False) -> DataFrame:
    """Copies ``source`` below ``path`` part by part, and returns the last comparison.

    Parts on the list of finished ones are left alone; ``recheck`` throws the list away and
    compares them too.  Parts that are missing or differ are deleted and written again,
    ``tries`` times at most; then they are reported as not complete.  A part holds the rows
    of some keys, so the driver sees one line for each of ``parts`` parts.
    """
    spark = source.sparkSession
    done = set() if recheck else finished(spark, path)
    report = {r["part"]: r for r in compared(source, path, key, parts).collect()} if recheck or not done else None
    wanted = sorted(p for p, r in report.items() if not r["complete"]) if report is not None else sorted(set(range(parts)) - done)
    for _ in range(tries):
        if wanted:
            for p in wanted:
                at, files = hadoop_path(spark, f"{path}/rows/{PART}={p}")
                files.delete(at, True)
            some = in_parts(source, key, parts).filter(F.col(PART).isin(wanted))
            some.repartition(len(wanted), PART).write.mode("append").partitionBy(PART).parquet(f"{path}/rows")
        report = {r["part"]: r for r in compared(source, path, key, parts).collect()}
        for p in range(parts):
            at, files = hadoop_path(spark, f"{path}/done/{p}")
            if p not in report or report[p]["complete"]:
                files.mkdirs(at)
            else:
                files.delete(at, True)
        wanted = sorted(p for p, r in report.items() if not r["complete"])
        if not wanted:
            break
    return compared(source, path, key, parts)
