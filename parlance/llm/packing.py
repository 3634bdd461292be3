"""Best-fit packing planned over a histogram of lengths.

Documents are tokenized where they lie; only slim rows (id, piece, length,
checksum) go on.  Best-fit decreasing then runs over the counts of each length,
at most ``SEQUENCE`` of them, not over documents: a run of equal sequences is one
entry of the plan however many sequences it stands for.  Pieces take the planned
places by their rank within their length.  Ranks are counted in parts of a length,
with about a share of one in ``PARTS`` of all pieces, so one common length is no single
task; pieces that fill a sequence take one each and need no rank.

Defined cases: a null text is empty and has one token, the id 0 at its end; the
tokenizer's special strings in a text are their ids, as the plain call gives them;
equal lengths are ranked by doc_id (nulls first) and piece, repeated rows follow
one another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ship_package, stored

SEQUENCE = 2048
#: The id that ends every document.
END = 0
#: Parts that all pieces are ranked in, besides one for each length, and their pieces at least.
PARTS, PART_ROWS = 4096, 256
#: Files of the public tokenizer: the same vocabulary in two formats; only the first names the special strings.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encoders: dict = {}


def encoder(file: str = TOKENIZER, ranks: str = RANKS) -> Callable[[str], list[int]]:
    """Texts to ids as ``tokenizers`` gives them for ``file`` (without added ids at the ends).

    The rank file holds the vocabulary of ``file`` and gives equal ids (a test compares
    them); it is five times faster on words that are not in the vocabulary.
    """
    if file not in _encoders:
        import public_tokenizers
        import tiktoken

        named = [f if "/" in f else public_tokenizers.path(f) for f in (file, ranks)]
        with open(named[0], encoding="utf-8") as text:
            special = {t["content"]: t["id"] for t in json.load(text)["added_tokens"]}
        with open(named[1], "rb") as lines:
            order = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        made = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens=special)
        _encoders[file] = lambda text: made.encode(text, allowed_special="all", disallowed_special=())
    return _encoders[file]


def piece_rows(doc_id: int | None, ids: np.ndarray, size: int) -> list[tuple]:
    """(doc_id, piece, start, length, crc32) of a document's pieces.

    A document longer than ``size`` is cut so that all pieces but the first are
    full.
    """
    n = len(ids)
    cuts = [0, *range(n % size or size, n, size), n] if n > size else [0, n]
    return [
        (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
    ]


def tokenized_pieces(docs: DataFrame, file: str = TOKENIZER, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents, in the schema ``PIECES``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END)
                rows += piece_rows(doc_id, np.array(ids, dtype="<u4"), size)
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns ``(length, first rank, ranks, first sequence, offset)``: pieces of
    ``length`` with ranks from ``first rank`` on take one sequence each, from
    ``first sequence`` on, at ``offset``.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left: runs of (first sequence, sequences)
    places: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(first: int, n: int, room: int) -> int:
            """Pieces into up to ``n`` sequences with this room; returns how many it used."""
            nonlocal left, rank
            used, each = 0, room // length
            for runs, items in ((min(n, left // each), each), (1, left % each)):
                if runs and items and used < n and runs * items <= left:
                    for k in range(items):
                        places.append((length, rank, runs, first + used, size - room + k * length))
                        rank += runs
                    left -= runs * items
                    if room > items * length:
                        free.setdefault(room - items * length, []).append((first + used, runs))
                    used += runs
            return used

        for room in sorted(r for r in free if r >= length):
            while left and free.get(room):
                first, n = free[room].pop()
                if (used := fill(first, n, room)) < n:
                    free.setdefault(room, []).append((first + used, n - used))
        if left:
            sequences += fill(sequences, left, size)
    return places


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds ``sequence_id, offset`` to rows of ``PIECES``."""
    spark = pieces.sparkSession
    whole = pieces.filter(F.col("length") == size).select(
        "*", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    pieces = pieces.filter(F.col("length") < size)
    # at most `size` lengths, whatever the input
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.createDataFrame(
        plan(histogram, size) or [(0, 0, 0, 0, 0)],
        "length long, first_rank long, ranks long, first_sequence long, offset long",
    )
    share = max(PART_ROWS, sum(histogram.values()) // PARTS)
    parts = spark.createDataFrame([(n, k // share + 1) for n, k in histogram.items()] or [(0, 1)], "length long, parts long")
    pieces = pieces.join(F.broadcast(parts), "length")
    pieces = pieces.withColumn("salt", F.expr("pmod(xxhash64(doc_id, piece), parts)")).drop("parts")
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(
        "length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("rank_start")
    )
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    # starts has `size` and PARTS rows at most and the plan a few for each length: both bounded by parameters
    ranked = pieces.withColumn("r", F.row_number().over(within) - 1).join(F.broadcast(starts), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank_start") + F.col("r")).drop("salt", "r", "rank_start")
    p = F.broadcast(places.alias("p"))
    on = (
        (F.col("d.length") == F.col("p.length"))
        & (F.col("d.rank") >= F.col("p.first_rank"))
        & (F.col("d.rank") < F.col("p.first_rank") + F.col("p.ranks"))
    )
    placed = ranked.alias("d").join(p, on).select(
        *[F.col(f"d.{c}") for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
        (F.col("p.first_sequence") + F.col("d.rank") - F.col("p.first_rank")).alias("sequence_id"),
        F.col("p.offset").alias("offset"),
    )
    return placed.unionByName(whole)


def pack_documents(docs: DataFrame, size: int = SEQUENCE, file: str = TOKENIZER) -> DataFrame:
    """Pieces of all documents with their places; tokenized once."""
    return pack(stored(tokenized_pieces(docs, file, size), "pieces"), size)


def op9_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
