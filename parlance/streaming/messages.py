"""Message streams: state, timers, expiry, throttling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds that a visitor waits for a person before the apology.
HANDOFF_SECONDS = 20
LIMIT, LIMIT_WINDOW = 50, "60 seconds"


def conversation_state(messages: DataFrame) -> DataFrame:
    """Running state of each conversation: messages, unread ones, started or not, last text.

    ``messages`` has ``conversation_id, sender_type, message, seq``.  A row of
    sender ``seen`` resets the unread count.  Rows of one batch count by ``seq``.
    """
    schema = "conversation_id long, messages long, unread long, started boolean, last_message string, last_seq long"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, unread, started, last, seq = state.get if state.exists else (0, 0, False, None, -1)
        rows = pd.concat(list(parts)).sort_values("seq")
        seen, visitor = rows["sender_type"].eq("seen"), rows["sender_type"].eq("visitor")
        # visitors' messages behind the last row that resets them
        unread = int(visitor[~seen[::-1].cummax()[::-1]].sum()) + (0 if seen.any() else unread)
        said = rows[~seen]
        if len(said):
            started = bool(started or visitor[~seen].iloc[0 if n else 1 :].any())
            n, last, seq = n + len(said), said["message"].iloc[-1], int(said["seq"].iloc[-1])
        state.update((n, unread, started, last, seq))
        yield pd.DataFrame([(key[0], n, unread, started, last, seq)], columns=["conversation_id", "messages", "unread", "started", "last_message", "last_seq"])

    return messages.groupBy("conversation_id").applyInPandasWithState(
        step, schema, "messages long, unread long, started boolean, last_message string, last_seq long", "update", GroupStateTimeout.NoTimeout
    )


def handoffs(events: DataFrame, seconds: int = HANDOFF_SECONDS) -> DataFrame:
    """Requests for a person: one timer for each conversation, cleared by an acceptance.

    ``events`` has ``conversation_id, kind`` (``request`` or ``accept``) and the
    event time ``ts`` with a watermark.  A row goes out when a request is accepted
    or its time is over.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "apology")], columns=["conversation_id", "outcome"])
            return
        due = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(parts)).sort_values("ts").itertuples():
            at = int(r.ts.timestamp() * 1000)
            if due is not None and at > due:
                out.append((key[0], "apology"))
                due = None
            if r.kind == "request" and due is None:
                due = at + seconds * 1000
            elif r.kind == "accept" and due is not None:
                out.append((key[0], "accepted"))
                due = None
        if due is None:
            state.remove() if state.exists else None
        else:
            state.update((due,))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["conversation_id", "outcome"])

    return events.groupBy("conversation_id").applyInPandasWithState(
        step, "conversation_id long, outcome string", "due long", "append", GroupStateTimeout.EventTimeTimeout
    )


def limited(requests: DataFrame, limit: int = LIMIT, window: str = LIMIT_WINDOW) -> DataFrame:
    """Addresses above the limit in fixed windows; ``requests`` has ``ip, ts``."""
    counts = requests.groupBy("ip", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select("ip", F.col("w.start").alias("start"), "requests", (F.col("requests") > limit).alias("limited"))


def not_expired(blocked: DataFrame, now: Column) -> DataFrame:
    """Blocks that still hold."""
    return blocked.filter(F.col("expiresAt") > now)


def throttled(progress: DataFrame, seconds: float = 2.0) -> DataFrame:
    """The progress rows of each job that are sent: the first, the last, and others two seconds apart.

    ``progress`` has ``job, ts, current, total``; rows of a batch count by ``ts``.  A job's
    state goes when its last row (``current`` equal to ``total``) is sent.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "current"])
        sent = state.get[0] if state.exists else None
        keep = []
        for at, current, total in zip(rows["ts"].astype("int64") // 10**3, rows["current"], rows["total"], strict=True):
            keep.append(sent is None or at - sent >= seconds * 10**6 or current == total)
            sent = at if keep[-1] else sent
        if (rows["current"] == rows["total"]).any():
            state.remove() if state.exists else None
        else:
            state.update((int(sent),))
        yield rows[keep][["job", "ts", "current", "total"]]

    spaced = progress.withColumn("ts", F.col("ts").cast("timestamp"))
    return spaced.groupBy("job").applyInPandasWithState(
        step, "job long, ts timestamp, current long, total long", "sent long", "append", GroupStateTimeout.NoTimeout
    )


def rooms(events: DataFrame) -> DataFrame:
    """Each event for the rooms it goes to: its user's, and its agent's if it names one."""
    user = F.concat(F.lit("user"), F.col("userId").cast("string"))
    agent = F.concat(user, F.lit("-agent"), F.col("agentId").cast("string"))
    return events.withColumn("room", F.explode(F.array_compact(F.array(user, agent))))
