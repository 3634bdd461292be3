"""Visitors who connect, as a stream: open conversations again, new ones while a plan has room."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.lookups import by_key
from parlance.operators.prefix import running
from parlance.streaming.merge import MergeTable

C = F.col
#: Columns of the table in which an owner's requests for new conversations are counted.
QUOTA = T.StructType([T.StructField("userId", T.LongType()), T.StructField("asked", T.LongType())])


def connecting(quota: MergeTable, rooms: Callable[[], DataFrame], opened: Callable[[], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over visitors (``id, userId``); outcomes go below ``path``.

    ``rooms`` (``userId, room``) and ``opened`` (``id, userId, open_id, said``) are read
    anew for each batch, so a changed plan counts from the next batch on.  Places among an
    owner's new conversations go on from the count of earlier batches, by a two-level
    scan: an owner with most visitors is not one task.  A batch first writes its outcomes,
    over those of an attempt that failed, then its counts; when it comes again
    after that, nothing changes.
    """

    def connect(batch: DataFrame, number: int) -> None:
        if quota.entry()["batches"].get("connect", -1) >= number:
            return
        came = batch.select("id", "userId").join(opened(), ["id", "userId"], "left")
        again = came.filter("open_id is not null").select(
            C("id").alias("visitor"), C("open_id").alias("conversation"), F.lit("reused").alias("outcome"), (~F.coalesce("said", F.lit(False))).alias("welcome")
        )
        new = came.filter("open_id is null").select("id", "userId")
        room = rooms().join(quota.read(), "userId", "left").select("userId", (C("room") - F.coalesce("asked", F.lit(0))).alias("room"))
        placed = by_key(running(new, ["userId"], [C("id").asc()], {"place": F.lit(1).cast("long")}), room, "userId")
        fits = F.coalesce(C("place") <= C("room"), F.lit(False))
        made = placed.select(C("id").alias("visitor"), F.lit(None).cast("long").alias("conversation"), F.when(fits, "created").otherwise("limit").alias("outcome"), fits.alias("welcome"))
        again.unionByName(made).write.mode("overwrite").parquet(f"{path}/batch={number}")
        quota.merge(new.groupBy("userId").agg(F.count(F.lit(1)).alias("asked"), F.lit(number).alias("seq")), number, "connect")

    return connect
