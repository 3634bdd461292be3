"""Timers and expiring state by ``transformWithState``.

Unlike a timeout of a group, a timer is registered and deleted one by one, its state
lives in RocksDB beside the checkpoint, and the state can be read as a table while the
stream is down.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from parlance.streaming.messages import HANDOFF_SECONDS

#: The state store that timers, maps and expiry need.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTCOMES = "conversation_id long, outcome string, since timestamp"
DUE = StructType([StructField("due", LongType())])


def with_rocks(spark: SparkSession) -> None:
    """Streams of this session keep their state in RocksDB."""
    spark.conf.set(*ROCKS)


class HandOffs(StatefulProcessor):
    """One open request for a person in each conversation, with a timer for the apology."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", DUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else None
        armed, out = due, []
        for at, kind in self._in_order(rows):
            if due is not None and at > due:
                out.append(self._row(key, "apology", due))
                due = None
            if kind == "request" and due is None:
                due = at + self.wait
            elif kind == "accept" and due is not None:
                out.append(self._row(key, "accepted", due))
                due = None
        if armed is not None and armed != due:
            self.handle.deleteTimer(armed)
        if due is not None and armed != due:
            self.handle.registerTimer(due)
        if due is None:
            self.due.clear()
        else:
            self.due.update((due,))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.due.exists() and self.due.get()[0] == due:
            self.due.clear()
            yield self._frame([self._row(key, "apology", due)])

    def close(self) -> None:
        pass

    @staticmethod
    def _in_order(rows: Iterator[pd.DataFrame]) -> list[tuple[int, str]]:
        """Time in milliseconds and kind, by time and sequence."""
        every = pd.concat(list(rows)).sort_values(["ts", "seq"])
        return list(zip(every["ts"].astype("datetime64[ms]").astype("int64").tolist(), every["kind"].tolist(), strict=True))

    def _row(self, key, outcome: str, due: int) -> tuple:
        return int(key[0]), outcome, pd.Timestamp(due - self.wait, unit="ms")

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"conversation_id": pd.Series([r[0] for r in rows], dtype="int64"), "outcome": pd.Series([r[1] for r in rows], dtype=object), "since": pd.Series([r[2] for r in rows], dtype="datetime64[ms]")})


def handoff_timers(events: DataFrame, seconds: float = HANDOFF_SECONDS) -> DataFrame:
    """Outcomes of requests for a person: accepted in time, or an apology when the timer runs out.

    ``events`` has ``conversation_id, kind`` (``request`` or ``accept``), ``seq`` and the
    event time ``ts`` with a watermark.  While a request is open, others are not counted.
    A timer that an acceptance makes idle is deleted; others run out as the watermark passes.
    """
    with_rocks(events.sparkSession)
    return events.groupBy("conversation_id").transformWithStateInPandas(HandOffs(seconds), OUTCOMES, "Append", "EventTime")


def open_requests(spark: SparkSession, checkpoint: str, seconds: float = HANDOFF_SECONDS) -> DataFrame:
    """``conversation_id, since``: requests still open in the state behind a checkpoint, read as a table."""
    with_rocks(spark)
    state = spark.read.format("statestore").option("stateVarName", "due").load(checkpoint)
    since = F.timestamp_millis(F.col("value.due") - F.lit(int(seconds * 1000)))
    return state.select(F.col("key.conversation_id").alias("conversation_id"), since.alias("since"))


class BlockList(StatefulProcessor):
    """Addresses that an owner has blocked, each for a time after its block."""

    def __init__(self, hold: timedelta):
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocked = handle.getMapState("blocked", "ip string", "since long", int(self.hold.total_seconds() * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("seq")
        out = []
        for ip, kind, seq in zip(every["ip"], every["kind"], every["seq"], strict=True):
            if kind == "block":
                self.blocked.updateValue((ip,), (int(seq),))
            else:
                out.append((int(key[0]), ip, int(seq), bool(self.blocked.containsKey((ip,)))))
        if out:
            yield pd.DataFrame(out, columns=["userId", "ip", "seq", "refused"]).astype({"userId": "int64", "seq": "int64", "refused": "bool"})

    def close(self) -> None:
        pass


def refused_connections(events: DataFrame, hold: timedelta = timedelta(hours=24)) -> DataFrame:
    """Each connection, and whether its address is blocked; a block goes ``hold`` after it came in, by processing time.

    ``events`` has ``userId, ip, kind`` (``block`` or ``connect``) and ``seq``.  Expired
    entries are taken out by the state store.
    """
    with_rocks(events.sparkSession)
    return events.groupBy("userId").transformWithStateInPandas(BlockList(hold), "userId long, ip string, seq long, refused boolean", "Update", "ProcessingTime")
