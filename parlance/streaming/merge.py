"""A table that streams merge into: buckets of Parquet, versions, batches that count once.

Rows lie in buckets by a hash of their key.  A merge reads and rewrites the buckets that
its batch touches; the others stay where older versions put them.  A version is one line
of the log: the folder of each bucket, and the number of the batch.  It counts when its
file is there, which the file system creates once or not at all, so readers see whole
versions, a failed merge leaves nothing, and a batch that is sent again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.state import fold
from parlance.sources.work import hadoop_path

BUCKET = "merge__bucket"


class MergeTable:
    """``path``: its folder; ``schema``: columns with ``key`` among them; ``merge``: old and new rows to the table's rows.

    ``merge`` gets the old rows of the touched buckets and the batch, both whole for each
    key that they hold, and returns one row for each key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.merge_rows, self.buckets = spark, path.rstrip("/"), schema, key, merge, buckets

    def versions(self) -> list[int]:
        at, files = hadoop_path(self.spark, f"{self.path}/log")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in files.listStatus(at) if f.getPath().getName().endswith(".json")) if files.exists(at) else []

    def entry(self, version: int | None = None) -> dict:
        """The log's line of a version, by default the last; an empty table before the first."""
        found = self.versions() if version is None else [version]
        if not found:
            return {"version": 0, "batches": {}, "buckets": {}}
        at, files = hadoop_path(self.spark, f"{self.path}/log/{found[-1]}.json")
        stream = files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        return self._rows(self.entry(version)["buckets"])

    def _rows(self, buckets: dict[str, str]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in buckets.values()])

    def merge(self, batch: DataFrame, number: int, writer: str = "stream") -> bool:
        """Merges a batch; false if ``writer`` has merged this number or a later one before.

        To be given to ``foreachBatch``, whose numbers grow and come again after a failure.
        """
        last = self.entry()
        if last["batches"].get(writer, -1) >= number:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        batch = batch.persist()  # read for its buckets and again for its rows
        try:
            touched = [str(r[0]) for r in batch.select(bucket.alias(BUCKET)).distinct().collect()]  # as many as buckets at most
            old = self._rows({b: last["buckets"][b] for b in touched if b in last["buckets"]})
            folder = f"data/{last['version'] + 1}-{uuid.uuid4().hex}"
            new = self.merge_rows(old, batch).select(*self.schema.names).withColumn(BUCKET, bucket)
            new.repartition(max(1, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        finally:
            batch.unpersist()
        buckets = {**last["buckets"], **{b: f"{folder}/{BUCKET}={b}" for b in self._written(folder)}}
        for b in touched:  # a merge may have removed all rows of a bucket
            if buckets.get(b) == last["buckets"].get(b):
                buckets.pop(b, None)
        self._commit({"version": last["version"] + 1, "batches": {**last["batches"], writer: number}, "buckets": buckets})
        return True

    def _written(self, folder: str) -> list[str]:
        at, files = hadoop_path(self.spark, f"{self.path}/{folder}")
        return [f.getPath().getName().split("=")[1] for f in files.listStatus(at) if f.isDirectory()]

    def _commit(self, entry: dict) -> None:
        """Writes the log's line aside and renames it: the rename fails if another writer was first."""
        at, files = hadoop_path(self.spark, f"{self.path}/log/{entry['version']}.json")
        aside, _ = hadoop_path(self.spark, f"{self.path}/log/.{uuid.uuid4().hex}")
        stream = files.create(aside, False)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        if files.exists(at) or not files.rename(aside, at):
            files.delete(aside, False)
            raise RuntimeError(f"version {entry['version']} of {self.path} is there already")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the log's lines before the last ``keep`` versions, and folders that none of these reads."""
        versions = self.versions()
        used = {p.split("/")[1] for v in versions[-keep:] for p in self.entry(v)["buckets"].values()}
        at, files = hadoop_path(self.spark, f"{self.path}/data")
        for v in versions[:-keep]:
            files.delete(hadoop_path(self.spark, f"{self.path}/log/{v}.json")[0], False)
        for f in files.listStatus(at) if files.exists(at) else []:
            if f.getPath().getName() not in used:
                files.delete(f.getPath(), True)


def folding(key: str, order: list[str], sets: list[str], adds: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge of change logs: added columns grow by their sums, set ones take the last value that is not null.

    The batch has the key, the set and added columns, and ``order``; the table has the
    key, the set and added columns.
    """

    def merge(old: DataFrame, log: DataFrame) -> DataFrame:
        new = fold(log, key, order, sets, adds).alias("n")
        both = old.alias("o").join(new, key, "full")
        return both.select(
            key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in sets],
            *[(F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"n.{c}"), F.lit(0))).alias(c) for c in adds],
        )

    return merge
