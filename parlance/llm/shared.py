"""Helpers that several operators of this package need."""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share.

    ``spark.checkpoint.dir`` names that folder.  Only where it is unset in local mode
    (tests) a temporary folder of this machine serves instead; on a cluster that is an
    error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a plan of its own.

    Later stages read files that survive the loss of any executor, and nothing
    before them runs twice.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a table that :func:`stored` returned, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for a context."""
    context = spark.sparkContext
    if not getattr(context, "_parlance_shipped", False):
        top = Path(__file__).resolve().parents[1]
        target = f"{tempfile.mkdtemp(prefix='parlance-')}/{top.name}"
        context.addPyFile(shutil.make_archive(target, "zip", top.parent, top.name))
        context._parlance_shipped = True


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Words of ``text``: maximal runs of anything but blanks; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column cast to ``kind``, or nulls where the table lacks it."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


#: Rows up to which :func:`lookup` broadcasts a table, and rows of a key from which it is hot.
SMALL, HOT = 500_000, 100_000


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with a table that has one row for each ``key``, however many rows share a key.

    The table is broadcast if it has ``SMALL`` rows at most.  Beyond that the keys with
    ``HOT`` rows or more are looked up by a broadcast of theirs alone (one for ``HOT`` rows at most), the
    others by a shuffle.
    """
    if right.limit(SMALL + 1).count() <= SMALL:
        return left.join(F.broadcast(right), key, "left")
    hot = stored(left.groupBy(key).count().filter(F.col("count") >= HOT).select(key), "hot")
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    return left.join(F.broadcast(hot), key, "left_semi").join(few, key, "left").unionByName(rest)


#: Bins of a unit in which :func:`lowest` looks for ranks.
BINS = 1000


def lowest(found: DataFrame, key: str, value: str, share: float) -> dict:
    """For each ``key``: rows with a value, the place ``share`` * (rows - 1), and the values of the ranks around it.

    One pass counts bins, another one ranks inside of the bins that hold these ranks, so
    no task sees all values.  ``found`` is read twice and should be stored.
    """
    found = found.select(F.col(key).alias("key"), F.col(value).alias("value")).filter("value is not null").withColumn("bin", F.floor(F.col("value") * BINS))
    counts: dict = {}
    for r in found.groupBy("key", "bin").count().orderBy("key", "bin").collect():
        counts.setdefault(r["key"], []).append((r["bin"], r["count"]))
    wanted, places = [], {}
    for k, bins in counts.items():
        n, before = sum(n for _, n in bins), 0
        places[k] = n, share * (n - 1)
        ranks = {math.floor(places[k][1]), math.ceil(places[k][1])}
        for b, many in bins:
            wanted += [(k, b, rank - before, rank) for rank in ranks if before <= rank < before + many]
            before += many
    if not wanted:
        return {}
    kind = found.schema["key"].dataType.simpleString()
    asked = found.sparkSession.createDataFrame(wanted, f"key {kind}, bin long, inside long, rank long")
    values = found.join(F.broadcast(asked.select("key", "bin").distinct()), ["key", "bin"]).groupBy("key", "bin", "value").count()
    upto = values.withColumn("upto", F.sum("count").over(W.partitionBy("key", "bin").orderBy("value")))
    held: dict = {}
    for r in upto.join(F.broadcast(asked), ["key", "bin"]).filter("upto > inside and upto - count <= inside").collect():
        held.setdefault(r["key"], {})[r["rank"]] = r["value"]
    return {k: (n, x, held[k]) for k, (n, x) in places.items()}
