"""Streams run to their end over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.lookups import by_key
from parlance.operators.prefix import running
from parlance.plans.registry import query
from parlance.plans.rules import CONNECT, limits
from parlance.sources.views import Views
from parlance.sources.work import hadoop_path, scratch_dir, stored
from parlance.streaming.connects import QUOTA, connecting
from parlance.streaming.merge import MergeTable, folding
from parlance.streaming.messages import conversation_state, rooms, throttled
from parlance.streaming.timers import handoff_timers, open_requests

C = F.col
#: Seconds of a hand-off and between progress rows in the queries, whose events lie hours apart.
PATIENCE, SPACING = 2 * 86400, 86400


def table_stream(v: Views, name: str) -> DataFrame:
    """A table's files as a stream: those of its folder, or the one file of its name."""
    path = f"{v.sf_dir}/{name}.parquet"
    at, files = hadoop_path(v.spark, path)
    reader = v.spark.readStream.schema(getattr(v, name).schema)
    return reader.parquet(path) if files.getFileStatus(at).isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(v.sf_dir)


def drained(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """The rows that a stream writes until its input ends.

    Each batch is written as Parquet with its number below ``folder``, by default a new one
    in the shared folder; the checkpoint lies beside them.  In complete mode the last batch is
    the result.
    """
    spark = stream.sparkSession
    folder = folder or scratch_dir(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.filter(C("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


@query("stream_event_windows", """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS slot, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY time_bucket(INTERVAL 6 HOUR, ts), event_type""")
def stream_event_windows(v: Views):
    """Tumbling windows of a file stream, available rows only."""
    stream = table_stream(v, "events")
    counted = stream.withColumn("ts", C("ts").cast("timestamp")).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))
    shown = counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("slot"), "event_type", "n", "total")
    return drained(shown, "complete")


@query("room_fanout", """SELECT room, count(*) AS events FROM (SELECT 'user' || userId AS room FROM convs UNION ALL SELECT 'user' || userId || '-agent' || agentId FROM convs) GROUP BY room""")
def room_fanout(v: Views):
    return rooms(v.convs.select("userId", "agentId")).groupBy("room").agg(F.count(F.lit(1)).alias("events"))


@query("session_windows", """SELECT user_id, count(*) AS events, min(event_id) AS first_event FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, session""")
def session_windows(v: Views):
    """Sessions with a gap of twelve hours."""
    s = v.events.withColumn("ts", C("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "12 hours"))
    return s.agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event")).select("user_id", "events", "first_event")


@query("stream_conversation_state", """SELECT conversation_id, count(*) AS messages, count(*) FILTER (WHERE sender_type = 'visitor') AS unread, coalesce(bool_or(sender_type = 'visitor' AND r > 1), false) AS started, arg_max(message, turn) AS last_message
 FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS r FROM msgs) GROUP BY conversation_id""")
def stream_conversation_state(v: Views):
    """State of each conversation after all available messages of a file stream."""
    stream = table_stream(v, "conversations")
    sender = F.when(C("role") == "user", "visitor").when(C("role") == "assistant", "ai").otherwise("system")
    rows = stream.select(C("conv_id").alias("conversation_id"), sender.alias("sender_type"), C("text").alias("message"), C("turn").cast("long").alias("seq"))
    last = drained(conversation_state(rows), "update").groupBy("conversation_id").agg(F.max_by(F.struct("messages", "unread", "started", "last_message"), "messages").alias("s"))
    return last.select("conversation_id", "s.*")


# events as requests for a person (clicks) and acceptances (purchases); each request's end and the next request after it
SESSIONS = f"""WITH RECURSIVE e AS (SELECT user_id AS c, epoch_us(ts) // 1000 AS ms, event_type = 'click' AS asks, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('click', 'purchase')),
 ends AS (SELECT a.c, a.r, a.ms, min(b.r) AS stop, arg_min(b.ms <= a.ms + {PATIENCE * 1000}, b.r) AS accepted FROM e a LEFT JOIN e b ON b.c = a.c AND b.r > a.r AND (b.ms > a.ms + {PATIENCE * 1000} OR NOT b.asks) WHERE a.asks GROUP BY a.c, a.r, a.ms),
 links AS (SELECT x.c, x.r, x.ms, x.stop, x.accepted, min(n.r) AS following FROM ends x LEFT JOIN e n ON n.c = x.c AND n.asks AND n.r >= x.stop + CASE WHEN x.accepted THEN 1 ELSE 0 END GROUP BY ALL),
 s AS (SELECT * FROM links WHERE (c, r) IN (SELECT c, min(r) FROM e WHERE asks GROUP BY c) UNION ALL SELECT l.* FROM s JOIN links l ON l.c = s.c AND l.r = s.following),
 judged AS (SELECT c AS conversation_id, make_timestamp_ms(ms) AS since, CASE WHEN accepted THEN 'accepted' WHEN stop IS NOT NULL OR ms + {PATIENCE * 1000} <= (SELECT max(ms) FROM e) - 3600000 THEN 'apology' ELSE 'open' END AS outcome FROM s)"""


def handoff_events(v: Views) -> DataFrame:
    """Requests for a person and acceptances, as a stream with a watermark of an hour."""
    rows = table_stream(v, "events").filter(C("event_type").isin("click", "purchase"))
    kind = F.when(C("event_type") == "click", "request").otherwise("accept")
    return rows.select(C("user_id").alias("conversation_id"), kind.alias("kind"), C("event_id").alias("seq"), C("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")


@query("stream_handoffs", SESSIONS + " SELECT conversation_id, outcome, strftime(since, '%Y-%m-%d %H:%M:%S') AS since FROM judged WHERE outcome <> 'open'")
def stream_handoffs(v: Views):
    """Outcomes of requests for a person, by registered timers that an acceptance deletes."""
    done = drained(handoff_timers(handoff_events(v), PATIENCE), "append")
    return done.select("conversation_id", "outcome", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("replay_pending", SESSIONS + " SELECT conversation_id, visitor, strftime(since, '%Y-%m-%d %H:%M:%S') AS since FROM judged JOIN convs ON convs.id = conversation_id WHERE outcome = 'open' AND aiChat")
def replay_pending(v: Views):
    """Requests still open when the stream stopped, out of its state, while the conversation is with the AI."""
    folder = scratch_dir(v.spark, "stream")
    drained(handoff_timers(handoff_events(v), PATIENCE), "append", folder)
    waiting = open_requests(v.spark, f"{folder}/checkpoint", PATIENCE)
    asked = waiting.join(v.convs.filter("aiChat").select(C("id").alias("conversation_id"), "visitor"), "conversation_id")
    return asked.select("conversation_id", "visitor", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("stream_throttle", f"""WITH RECURSIVE p AS (SELECT user_id AS job, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS current, count(*) OVER (PARTITION BY user_id) AS total FROM events),
 links AS (SELECT a.*, min(b.current) AS following FROM p a LEFT JOIN p b ON b.job = a.job AND b.current > a.current AND (b.us - a.us >= {SPACING * 1000000} OR b.current = b.total) GROUP BY ALL),
 s AS (SELECT * FROM links WHERE current = 1 UNION ALL SELECT l.* FROM s JOIN links l ON l.job = s.job AND l.current = s.following) SELECT job, current, total FROM s""")
def stream_throttle(v: Views):
    """Progress rows that are sent: the first and last of each job, and others a day apart.

    A user's events are the steps of a job, numbered before the stream begins.
    """
    sizes = v.events.groupBy(C("user_id").alias("job")).agg(F.count(F.lit(1)).alias("total"))
    steps = running(v.events.select(C("user_id").alias("job"), C("ts").cast("timestamp").alias("ts"), "event_id"), ["job"], [C("ts").asc(), C("event_id").asc()], {"current": F.lit(1).cast("long")})
    numbered = stored(by_key(steps, sizes, "job").select("job", "ts", "current", "total"), "progress")
    stream = v.spark.readStream.schema(numbered.schema).parquet(numbered.stored_at)
    return drained(throttled(stream, SPACING), "append").select("job", "current", "total")


def in_slices(df: DataFrame, column: str, slices: int) -> str:
    """A folder with ``df`` in so many files' groups, one after the other in the order of ``column``."""
    folder = scratch_dir(df.sparkSession, "slices")
    low, high = df.agg(F.min(column), F.max(column)).first()
    for k in range(slices):
        part = df.filter(F.least(F.lit(slices - 1), F.floor((C(column) - F.lit(low)) * slices / F.lit(max(1, (high or 0) - (low or 0) + 1)))) == k)
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


@query("merge_usage", "SELECT user_id, arg_max(event_type, event_id) AS last_event, sum(cast(floor(value) AS BIGINT))::BIGINT AS tokens, count(*) AS requests FROM events GROUP BY user_id")
def merge_usage(v: Views):
    """Usage of each user in a table that a stream of four batches merges into; the third is sent twice."""
    log = v.events.select("user_id", "event_id", C("event_type").alias("last_event"), F.floor("value").cast("long").alias("tokens"), F.lit(1).cast("long").alias("requests"))
    folder = in_slices(log, "event_id", 4)
    schema = log.drop("event_id").schema
    table = MergeTable(v.spark, scratch_dir(v.spark, "merge"), schema, "user_id", folding("user_id", ["event_id"], ["last_event"], ["tokens", "requests"]), 16)

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch, number)
        if number == 2:
            table.merge(batch, number)

    stream = v.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", scratch_dir(v.spark, "merge-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return table.read()


@query("stream_visitor_connect", CONNECT)
def stream_visitor_connect(v: Views):
    """Visitors who connect in three batches; plans and open conversations are read anew for each."""
    folder = in_slices(v.visitors.select("id", "userId"), "id", 3)
    path = scratch_dir(v.spark, "connects")
    used = v.convs.groupBy("userId").agg(F.count(F.lit(1)).alias("used"))
    room = F.coalesce("max_queries", F.lit(1000)) - F.coalesce("used", F.lit(0))
    owners = v.visitors.select("userId").distinct()
    rooms_now = lambda: owners.join(limits(v).select("userId", "max_queries"), "userId", "left").join(used, "userId", "left").select("userId", room.alias("room"))
    said = v.msgs.select(C("conversation_id").alias("open_id")).distinct().withColumn("said", F.lit(True))
    open_now = lambda: v.convs.filter("status = 'open'").groupBy(C("visitor").alias("id"), "userId").agg(F.max("id").alias("open_id")).join(said, "open_id", "left")
    quota = MergeTable(v.spark, f"{path}/quota", QUOTA, "userId", folding("userId", ["seq"], [], ["asked"]), 16)
    stream = v.spark.readStream.schema("id long, userId long").option("maxFilesPerTrigger", 1).parquet(folder)
    step = connecting(quota, rooms_now, open_now, f"{path}/rows")
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{path}/rows").drop("batch")


@query("stream_unread", """SELECT conversation_id, count(*) AS messages, count(*) FILTER (WHERE sender_type = 'visitor' AND turn > coalesce(seen, -1)) AS unread FROM msgs LEFT JOIN (SELECT conversation_id, max(turn) AS seen FROM msgs WHERE turn % 3 = 2 GROUP BY conversation_id) USING (conversation_id) GROUP BY conversation_id""")
def stream_unread(v: Views):
    """Unread messages of each conversation; a person looks at it behind every third message, which makes all before it read."""
    sender = F.when(C("role") == "user", "visitor").when(C("role") == "assistant", "ai").otherwise("system")
    said = F.struct(sender.alias("sender_type"), C("text").alias("message"), (C("turn") * 2).cast("long").alias("seq"))
    seen = F.when(C("turn") % 3 == 2, F.struct(F.lit("seen").alias("sender_type"), F.lit(None).cast("string").alias("message"), (C("turn") * 2 + 1).cast("long").alias("seq")))
    rows = table_stream(v, "conversations").select(C("conv_id").alias("conversation_id"), F.inline(F.array_compact(F.array(said, seen))))
    last = drained(conversation_state(rows), "update").groupBy("conversation_id").agg(F.max_by(F.struct("messages", "unread"), "last_seq").alias("s"))
    return last.select("conversation_id", "s.messages", "s.unread")
