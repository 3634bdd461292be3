"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) a temporary folder of this machine
    serves instead; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="parlance-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later reads survive lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as Spark reaches them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Deletes a table that :func:`stored` returned, once nothing reads it any more."""
    at, files = hadoop_path(df.sparkSession, df.stored_at)
    files.delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for a context."""
    context = spark.sparkContext
    if not getattr(context, "_parlance_shipped", False):
        top = Path(__file__).resolve().parents[1]
        target = f"{tempfile.mkdtemp(prefix='parlance-')}/{top.name}"
        context.addPyFile(shutil.make_archive(target, "zip", top.parent, top.name))
        context._parlance_shipped = True
