"""Merge table, checked copies, timers, expiry, connects: replays, restarts, damage."""

import glob
import os
import time
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from parlance.operators import copying
from parlance.sources.work import scratch_dir
from parlance.streaming.connects import QUOTA, connecting
from parlance.streaming.merge import MergeTable, folding
from parlance.streaming.timers import handoff_timers, open_requests, refused_connections

LOG = "user long, seq long, mode string, n long"


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], "user long, mode string, n long").schema
    return MergeTable(spark, f"{tmp_path}/table", schema, "user", folding("user", ["seq"], ["mode"], ["n"]), 4)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_table(spark, table):
    log = [(k % 7, k, None if k % 3 else f"m{k}", k) for k in range(60)]
    for number, low in enumerate(range(0, 60, 20)):
        batch = spark.createDataFrame(log[low : low + 20], LOG)
        assert table.merge(batch, number) and not table.merge(batch, number)
        assert not table.merge(batch, number - 1)
    want = defaultdict(lambda: [None, 0])
    for user, _, mode, n in log:
        want[user] = [mode if mode is not None else want[user][0], want[user][1] + n]
    assert rows(table.read()) == sorted((u, *x) for u, x in want.items())
    # versions are whole and stay; another writer counts for itself
    assert table.versions() == [1, 2, 3]
    first = defaultdict(int)
    for user, _, _, n in log[:20]:
        first[user] += n
    assert {r.user: r.n for r in table.read(1).collect()} == dict(first)
    assert table.merge(spark.createDataFrame([(100, 1, "x", 1)], LOG), 0, "other") and {r.user for r in table.read().collect()} == {*want, 100}
    before = table.entry(3)["buckets"]
    assert sum(before[b] != p for b, p in table.entry(4)["buckets"].items() if b in before) <= 1
    table.vacuum(1)
    assert table.versions() == [4] and {r.user for r in table.read().collect()} == {*want, 100}


def test_a_failed_merge_leaves_nothing(spark, table):
    table.merge(spark.createDataFrame([(1, 1, "a", 5)], LOG), 0)
    was = rows(table.read())
    good, table.merge_rows = table.merge_rows, lambda old, new: new.select("user", "mode", F.raise_error(F.lit("no")).cast("long").alias("n"))
    with pytest.raises(Exception, match="no"):
        table.merge(spark.createDataFrame([(1, 2, "b", 5)], LOG), 1)
    assert rows(table.read()) == was
    table.merge_rows = lambda old, new: old.join(new, "user", "left_anti")  # all rows of a bucket go
    table.merge(spark.createDataFrame([(1, 2, "b", 5)], LOG), 1)
    assert table.read().count() == 0
    table.merge_rows = good
    entry = table.entry()
    with pytest.raises(RuntimeError):
        table._commit({**entry, "version": entry["version"]})


def test_checked_copy(spark, tmp_path):
    """Damaged, missing and foreign rows are found by part and mended; finished parts are left alone."""
    path = f"{tmp_path}/copy"
    source = spark.createDataFrame([(k, f"t{k}" if k % 5 else None, [k * 0.5]) for k in range(300)] + [(7, "again", None)], "id long, title string, v array<double>")
    report = {r.part: r for r in copying.copy(source, path, "id", 6).collect()}
    assert len(report) == 6 and all(r.complete and r.source == r.copied for r in report.values())
    files = sorted(glob.glob(f"{path}/rows/{copying.PART}=2/*.parquet"))
    written = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/rows/{copying.PART}=[013]/*.parquet")}
    for crc in glob.glob(f"{path}/rows/*/.*.crc"):
        os.remove(crc)
    with open(files[0], "r+b") as f:
        f.truncate(os.path.getsize(files[0]) // 2)
    for f in glob.glob(f"{path}/rows/{copying.PART}=4/*.parquet"):
        os.remove(f)
    spark.createDataFrame([(10_000, "foreign", None)], source.schema).withColumn(copying.PART, F.lit(5)).write.mode("append").partitionBy(copying.PART).parquet(f"{path}/rows")
    bad = {r.part for r in copying.compared(source, path, "id", 6).collect() if not r.complete}
    assert bad == {2, 4, 5}
    assert all(r.complete for r in copying.copy(source, path, "id", 6, recheck=True).collect())
    assert written and all(os.path.getmtime(f) == t for f, t in written.items())
    back = spark.read.parquet(f"{path}/rows").select(*source.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, source.collect()))
    assert copying.finished(spark, path) == set(range(6))


def run(stream, checkpoint, out, mode="append"):
    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def test_timers_over_restarts(spark, tmp_path):
    """The stream stops after each file: open requests are in the state, timers go on, deleted ones stay silent."""
    source, checkpoint, out = f"{tmp_path}/in", f"{tmp_path}/checkpoint", f"{tmp_path}/out"
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    files = [
        [(1, "request", 0), (2, "request", 1), (3, "accept", 2), (5, "request", 3)],
        [(1, "accept", 15), (1, "request", 16), (2, "request", 12), (5, "accept", 14)],
        [(4, "request", 40)],
        [(1, "accept", 100), (6, "accept", 101)],
    ]
    waiting = []
    for n, part in enumerate(files):
        df = spark.createDataFrame([(c, k, n * 10 + i, at(s)) for i, (c, k, s) in enumerate(part)], "conversation_id long, kind string, seq long, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("conversation_id long, kind string, seq long, ts timestamp").parquet(source).withWatermark("ts", "0 seconds")
        run(handoff_timers(stream), checkpoint, out)
        waiting.append({r.conversation_id for r in open_requests(spark, checkpoint).collect()})
    got = sorted((r.conversation_id, r.outcome, r.since.second) for r in spark.read.parquet(out).collect())
    assert got == [(1, "accepted", 0), (1, "apology", 16), (2, "apology", 1), (4, "apology", 40), (5, "accepted", 3)]
    assert waiting == [{1, 2, 5}, {1, 2}, {4}, set()]


def test_blocks_expire(spark, tmp_path):
    """A block holds while it is young; another owner's does not count."""
    source, checkpoint, seen = f"{tmp_path}/in", f"{tmp_path}/checkpoint", {}
    schema = "userId long, ip string, kind string, seq long"

    def keep(batch, number):
        seen.update({r.seq: r.refused for r in batch.collect()})

    def send(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        # with state that expires by processing time a stream always has another batch: it runs until its rows are there
        stream = refused_connections(spark.readStream.schema(schema).parquet(source), timedelta(seconds=25))
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(processingTime="1 second").start()
        until = time.time() + 60
        while not {r[3] for r in rows if r[2] == "connect"} <= set(seen) and time.time() < until:
            time.sleep(0.2)
        query.stop()

    send((1, "a", "connect", 1), (1, "a", "block", 2), (1, "a", "connect", 3), (2, "a", "connect", 4))
    began = time.time()
    send((1, "a", "connect", 5), (1, "b", "connect", 6))
    assert time.time() - began < 20
    time.sleep(max(0, 27 - (time.time() - began)))
    send((1, "a", "connect", 7))
    assert seen == {1: False, 3: True, 4: False, 5: True, 6: False, 7: False}


def test_connects_with_changing_plans(spark, tmp_path):
    """Places go on over batches, a changed plan counts from the next one, a batch sent again changes nothing."""
    quota = MergeTable(spark, f"{tmp_path}/quota", QUOTA, "userId", folding("userId", ["seq"], [], ["asked"]), 2)
    room = {"n": 3}
    rooms = lambda: spark.createDataFrame([(1, room["n"]), (2, 100)], "userId long, room long")
    opened = lambda: spark.createDataFrame([(5, 1, 50, True), (6, 1, 60, None)], "id long, userId long, open_id long, said boolean")
    connect = connecting(quota, rooms, opened, f"{tmp_path}/rows")
    batches = [[(1, 1), (2, 1), (5, 1)], [(3, 1), (4, 1), (6, 1), (7, 2), (8, 3)], [(9, 1), (10, 1)]]
    for number, people in enumerate(batches):
        if number == 2:
            room["n"] = 5
        batch = spark.createDataFrame(people, "id long, userId long")
        connect(batch, number)
        connect(batch, number)
    got = {r.visitor: (r.conversation, r.outcome, r.welcome) for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    new, full = (None, "created", True), (None, "limit", False)
    assert got == {1: new, 2: new, 5: (50, "reused", False), 3: new, 4: full, 6: (60, "reused", True), 7: new, 8: full, 9: new, 10: full}
    assert {r.userId: r.asked for r in quota.read().collect()} == {1: 6, 2: 1, 3: 1}


def test_scratch_folders_differ(spark):
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
