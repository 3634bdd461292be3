"""Trie of conversation prefixes by prefix doubling.

Blocks of turns whose lengths are powers of two get dense names: a block of twice the
length is named by the names of its halves, so blocks of all lengths are named in
logarithmically many rounds.  A prefix of ``d`` turns is the blocks of the binary digits
of ``d``, longest first; prefixes are named in rounds too, by their number of ones: the
prefix without the last block, and that block.  Equal prefixes have equal names, and
nodes are groups of names.

No task holds a conversation or a node: turns are numbered by a two-level scan, halves
meet in groups of two rows, names go back by :func:`~parlance.llm.shared.lookup` (hot ones
apart), and sums over subtrees are sums over the rows of nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.prefix import running

from .shared import lookup, scratch_dir, ship_package, stored

#: Each conversation is rebuilt on the first of its group of so many ids, with fewer than so many of its turns.
GROUP, HEADS = 20, 4
#: Ids in a piece of a node's list.
PIECE = 4096


def dense_names(rows: DataFrame, columns: list[str], name: str = "name") -> DataFrame:
    """``key`` (a struct of the columns) and its number, from 0 without gaps, for each distinct one.

    A name is the place within its part behind the rows of the parts before; the driver
    sees one count for each part.
    """
    spark = rows.sparkSession
    found = stored(rows.select(F.struct(*columns).alias("key")).distinct().withColumn("at", F.monotonically_increasing_id()), "names")
    part, total, before = F.shiftright("at", 33).cast("int").alias("part"), 0, []
    for p, n in found.groupBy(part).count().sort("part").collect():
        before.append((p, total))
        total += n
    table = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    place = F.col("at").bitwiseAND(F.lit(2**33 - 1))
    return found.withColumn("part", F.shiftright("at", 33).cast("int")).join(table, "part").select("key", (F.col("before") + place).alias(name))


def named(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the columns replaced by ``name``, stored."""
    keyed = rows.withColumn("key", F.struct(*columns))
    return stored(lookup(keyed, dense_names(rows, columns), "key").drop("key", *columns), "named")


def numbered(df: DataFrame) -> DataFrame:
    """``conv, pos, turn_key, words``: the turns of each conversation in order, from 1.

    Null turns come first; equal turn numbers follow the digest of role and text.  Null
    roles and texts are empty.  Rows without ``conv_id`` belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = df.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("turn_key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return running(stored(slim, "turns"), ["conv"], [F.col("turn").asc_nulls_first(), F.col("turn_key")], {"pos": F.lit(1).cast("long")}).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns, and ``conv`` of all conversations.

    The first of a group gives its first turns, of which conversation c takes crc32(c) mod
    4 (all if it has fewer, none if it is absent), in place of as many of its own.
    """
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    first = F.col("conv") - F.col("conv") % GROUP
    lengths = stored(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "lengths")
    firsts = lengths.filter(first == F.col("conv")).select(F.col("conv").alias("first"), F.col("n").alias("n_first"))
    asked = lengths.select("conv", first.alias("first"), heads.alias("h")).join(firsts, "first", "left")
    short = asked.select("conv", (F.col("h") - F.least("h", F.coalesce("n_first", F.lit(0)))).alias("short")).filter("short > 0")
    given = turns.filter((F.col("pos") < HEADS) & (first == F.col("conv"))).select(F.col("conv").alias("first"), "pos", "turn_key", "words")
    taken = asked.join(given, "first").filter("pos <= h").select("conv", "pos", "turn_key", "words")
    own = lookup(turns.filter(F.col("pos") > heads), stored(short, "short"), "conv")
    own = own.select("conv", (F.col("pos") - F.coalesce("short", F.lit(0))).alias("pos"), "turn_key", "words")
    return stored(taken.unionByName(own), "rebuilt"), lengths.select("conv")


def prefix_names(turns: DataFrame) -> DataFrame:
    """``conv, d, name`` for each turn: the name of the conversation's first ``d`` turns.

    Two prefixes of one length have the same name if and only if their turns are equal.
    """
    longest = turns.agg(F.max("pos")).first()[0] or 0
    blocks = named(turns.select("conv", (F.col("pos") - 1).alias("i"), "turn_key"), ["turn_key"])
    levels = [blocks]
    while 2 ** len(levels) <= longest:
        half = lambda k: F.max(F.when(F.col("i") % 2 == k, F.col("name")))
        halves = levels[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(half(0).alias("l"), half(1).alias("r"))
        levels.append(named(halves.filter("r is not null"), ["l", "r"]))
    # a block at an even place ends exactly one prefix: the one whose last one-digit it is
    at = lambda k, c: (c * 2**k).alias
    ends = [b.filter("i % 2 = 0").select("conv", at(k, F.col("i") + 1)("d"), at(k, F.col("i"))("before"), F.col("name").alias("r")) for k, b in enumerate(levels)]
    last = ends[0]
    for e in ends[1:]:
        last = last.unionByName(e)
    # a round reads the rows of its number of ones alone
    last = _by_ones(last)
    found = [stored(last.filter("ones = 1").select("conv", "d", F.col("r").alias("name")), "prefixes")]
    for k in range(2, max(longest.bit_count(), longest.bit_length() - 1) + 1):
        shorter = found[-1].select("conv", F.col("d").alias("before"), F.col("name").alias("l"))
        pairs = last.filter(F.col("ones") == k).join(shorter, ["conv", "before"]).select("conv", "d", F.col("d").alias("length"), "l", "r")
        found.append(named(pairs, ["length", "l", "r"]))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _by_ones(ends: DataFrame) -> DataFrame:
    """``ends`` stored in a folder for each number of ones in ``d``."""
    path = scratch_dir(ends.sparkSession, "ends")
    ends.withColumn("ones", F.bit_count("d")).write.partitionBy("ones").parquet(path)
    return ends.sparkSession.read.schema(T.StructType([*ends.schema.fields, T.StructField("ones", T.IntegerType())])).parquet(path)


def list_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ascending ids of each ``d, name``.

    Rows are sorted by ranges of node and id, so a large node spans many parts; each part
    makes pieces of ``PIECE`` ids.  A digest can only be made from front to back: one task
    reads the pieces of a node, one after the other, and keeps none.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())],
                names=["d", "name", "first", "ids"],
            )

        for batch in batches:
            for d, name, conv in zip(*(batch[c].to_pylist() for c in ("d", "name", "conv")), strict=True):
                if (d, name) != node or len(ids) == PIECE:
                    if ids:
                        yield piece()
                    node, ids = (d, name), []
                ids.append(conv)
        if ids:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for d, name, ids in zip(*(batch[c].to_pylist() for c in ("d", "name", "ids")), strict=True):
                if (d, name) == node:
                    state.update(b"," + ids.encode())
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (d, name), hashlib.sha256(ids.encode())
            yield _digest_rows(done)
        if node:
            yield _digest_rows([(*node, state.hexdigest())])

    cut = rows.select("d", "name", "conv").repartitionByRange(n, "d", "name", "conv").sortWithinPartitions("d", "name", "conv")
    joined = stored(cut.mapInArrow(pieces, "d long, name long, first long, ids string"), "pieces")
    gathered = joined.repartitionByRange(n, "d", "name").sortWithinPartitions("d", "name", "first")
    return stored(gathered.mapInArrow(digests, "d long, name long, ends_sha256 string"), "digests")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    d, name, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(name, pa.int64()), pa.array(digest, pa.string())], names=["d", "name", "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``turns`` (``conv, pos, turn_key, words``).

    ``convs`` lists all conversations, with turns or without.  Without any there is no
    row; else the root is there, of depth 0.

    A node's conversation is its member with the smallest id, which then is that of all
    its later prefixes that no smaller conversation shares.  So each node belongs to one
    conversation, and a sum over a subtree is the sum, over the conversations through the
    node, of what belongs to them from there on: a running total from the last turn back.
    """
    ship_package(turns.sparkSession)
    key = F.struct(F.col("d"), F.col("name"))
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("pos")).withColumn("last", F.lit(1).cast("long"))
    facts = turns.join(lengths, ["conv", "pos"], "left").select("conv", F.col("pos").alias("d"), "words", F.coalesce("last", F.lit(0)).alias("last"))
    rows = stored(prefix_names(turns).join(facts, ["conv", "d"]), "members")
    whole = rows.groupBy("d", "name").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"), F.sum("last").alias("ended"))
    owned = whole.select("conv", "d", ((F.col("n") - 1) * F.col("words")).alias("saved"), (F.col("ended") == F.col("n")).cast("long").alias("leaf"))
    owned = stored(owned, "owned")
    totals = running(rows.join(owned, ["conv", "d"], "left").drop("words", "last"), ["conv"], [F.col("d").desc()], {"saved": F.col("saved"), "leaf": F.col("leaf")})
    nodes = totals.groupBy("d", "name").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    nodes = stored(nodes, "nodes")
    above = rows.select("conv", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    children = nodes.join(above, ["conv", "d"], "left").withColumn("up", F.when(F.col("d") > 1, F.struct((F.col("d") - 1).alias("d"), F.col("parent").alias("name"))))
    children = stored(children.drop("parent"), "children")
    counts = children.filter("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("n_children")).select("up.*", "n_children")
    reps = nodes.select(key.alias("up"), F.col("conv").alias("parent_conv_id"))
    ends = list_digests(rows.filter("last = 1").select("d", "name", "conv").unionByName(_turnless(turns, convs)))
    some = lookup(children, reps, "up").drop("up").join(counts, ["d", "name"], "left")

    smallest, n_convs = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    saved, leaves = owned.agg(F.sum("saved"), F.sum("leaf")).first()
    root = [(0, 0, smallest, n_convs, leaves or 1, saved or 0, None, nodes.filter("d = 1").count())] if n_convs else []
    every = some.withColumn("parent_conv_id", F.when(F.col("d") == 1, F.lit(smallest)).otherwise(F.col("parent_conv_id")))
    every = every.select("d", "name", "conv", "n_convs", "n_leaves", "saved_tokens", "parent_conv_id", "n_children")
    every = every.unionByName(turns.sparkSession.createDataFrame(root, every.schema))
    none = hashlib.sha256(b"").hexdigest()
    return every.join(ends, ["d", "name"], "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def _turnless(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Conversations without a turn end at the root."""
    return convs.join(turns.filter("pos = 1"), "conv", "left_anti").select(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name"), "conv")


def op13_prefix_doubling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all rebuilt conversations.

    Rows without ``conv_id`` belong to no conversation; a null turn comes first, null roles
    and texts are empty; repeated rows and equal turn numbers stay, one after the other, in
    the order of their digests; very long texts are compared by SHA-256; an empty table
    gives no rows; other columns are not read.
    """
    return prefix_trie(*rebuilt(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
