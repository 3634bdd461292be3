"""Approximate search by cosine with an inverted file: cells of an index, of which a question probes a few.

Centroids are fitted on a bounded sample; every point is assigned to the nearest one.
Parts of the points meet parts of the questions, both of bounded size, so a cell with a third of
all points is many blocks and no task holds a cell; neither pairs of points nor pairs of
question and cell are rows.  How many cells a question probes is measured: a bounded sample of questions is answered
exactly, and the smallest number of cells that holds the asked share of their true
neighbours is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.lookups import by_key
from parlance.operators.nearest import nearest_in_task
from parlance.sources.work import ship_package, stored

#: Vectors that centroids are fitted on and questions that are answered exactly, at most about so many; cells; rounds of the fit.
SAMPLE, ASKED, MOST_CELLS, ROUNDS = 20_000, 256, 4096, 10
#: Components of a block of points; blocks of points, or as many questions, that share a task at most; tasks that the work is cut into at least.
BLOCK, TOGETHER, TASKS = 2**16, 128, 25


@dataclass
class Index:
    """Stored points with their cells: ``id, vector``, the columns of ``within``, ``cell``."""

    points: DataFrame
    centroids: np.ndarray
    within: list[str]
    probes: int = 1


def directed(vectors: DataFrame, key: str, within: list[str]) -> DataFrame:
    """``key``, the columns of ``within``, and the vector, as it is.

    Vectors that are null, empty, or without a finite length above 0 have no direction and are left out.
    """
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select(F.col(key), *within, "vector", length.alias("length")).filter("length > 0 AND length < double('Infinity')").drop("length")


def some(df: DataFrame, key: str, n: int, rows: int, use: str) -> DataFrame:
    """About ``rows`` of ``n`` rows, by a hash of the key and the use: the same ones in every run, others for each use."""
    return df.filter(F.xxhash64(key, F.lit(use)) / F.lit(2.0**64) + 0.5 <= rows / max(n, 1))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A list column of equal lengths as an array."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(rows, -1) if rows else np.empty((0, 0))


def unit(column: pa.Array, rows: int) -> np.ndarray:
    """The same, each vector divided by its length."""
    x = matrix(column, rows)
    return x / np.linalg.norm(x, axis=1)[:, None] if rows else x


def fit_centroids(points: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means; the first centroids are points at equal distances in the sample's order, empty cells keep theirs."""
    centroids = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)] if len(points) else points
    for _ in range(ROUNDS if len(points) else 0):
        cell = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, points)
        length = np.linalg.norm(sums, axis=1)
        centroids = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centroids)
    return centroids


def build(vectors: DataFrame, within: list[str] | None = None, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of ``vectors`` (``id, vector`` and the columns of ``within``, inside which questions look).

    About the root of the number of points is the number of cells.  All vectors have one length.
    """
    ship_package(vectors.sparkSession)
    within = within or []
    rows = directed(vectors, "id", within)
    n = rows.count()
    table = some(rows, "id", n, sample, "fit").sort(F.xxhash64("id")).select("vector").toArrow()
    centroids = fit_centroids(unit(table.column("vector").combine_chunks(), table.num_rows), cells or max(1, min(MOST_CELLS, round(n**0.5))))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (matrix(batch["vector"], batch.num_rows) @ shared.value.T).argmax(axis=1) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "cell"])

    return Index(stored(rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])), "cells"), centroids, within)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best scores of each row, ties to the smaller id, best first."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, -k, axis=1)[:, -k]
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep]


def blocked(rows: DataFrame, keys: list[str], width: int, name: str) -> DataFrame:
    """Rows of ``keys`` gathered into blocks of about ``BLOCK`` components: ``slot``, and ``name`` (structs of id and vector)."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) * width / BLOCK).cast("long").alias("slots")).filter("slots > 1")
    key = F.struct(*keys)
    placed = by_key(rows.withColumns({"key": key, "at": F.xxhash64(F.monotonically_increasing_id())}), stored(sizes.select(key.alias("key"), "slots"), "slots"), "key").drop("key")
    slot = F.pmod(F.col("at"), F.coalesce("slots", F.lit(1)))
    return placed.groupBy(*keys, slot.alias("slot")).agg(F.collect_list(F.struct("id", "vector")).alias(name))


def tune(index: Index, questions: DataFrame, k: int, recall: float, asked: int = ASKED) -> Index:
    """The index with as many probes as ``recall`` of the true ``k`` nearest need, on a sample of questions.

    ``questions`` has ``id, vector`` and the columns of ``within``.  One pass over the
    points answers the sample exactly; a neighbour is found with p probes if its cell is among the
    p nearest of the question.  It is another sample than the one that centroids are fitted on, whose
    points lie nearer to their centroids than others.
    """
    rows = directed(questions, "id", index.within)
    chosen = some(rows, "id", rows.count(), asked, "ask").dropDuplicates(["id"]).limit(4 * asked).toArrow()
    if not chosen.num_rows:
        return Index(index.points, index.centroids, index.within, len(index.centroids) or 1)
    q = unit(chosen.column("vector").combine_chunks(), chosen.num_rows)
    owner = list(zip(*(chosen.column(c).to_pylist() for c in index.within), strict=True)) if index.within else [()] * len(q)
    shared = index.points.sparkSession.sparkContext.broadcast((q, owner))
    within = index.within

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, owner = shared.value
        held: list[np.ndarray] = []  # question, score, id, cell
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = np.round(q @ unit(batch["vector"], batch.num_rows).T, 5)
            if within:
                names = {o: i for i, o in enumerate(dict.fromkeys(owner))}
                own = np.array([names.get(o, -1) for o in zip(*(batch[c].to_pylist() for c in within), strict=True)])
                scores = np.where(np.array([names[o] for o in owner])[:, None] == own[None, :], scores, -2.0)
            ids = np.asarray(batch["id"].to_numpy(zero_copy_only=False))
            row, column = best(scores, ids, k)
            held.append(np.stack([row, scores[row, column], ids[column], np.asarray(batch["cell"])[column]]))
            if len(held) > 16:
                held = [kept(np.concatenate(held, axis=1), k)]
        rows = kept(np.concatenate(held, axis=1), k) if held else np.empty((4, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0].astype(int)), pa.array(rows[1], pa.float64()), pa.array(rows[2].astype(np.int64)), pa.array(rows[3].astype(np.int32), pa.int32())], names=["q", "score", "id", "cell"]
        )

    found = index.points.mapInArrow(nearest, "q long, score double, id long, cell int").filter("score > -2")
    true = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k).select("q", "cell").collect()
    place = np.empty((len(q), len(index.centroids)), int)
    np.put_along_axis(place, np.argsort(-(q @ index.centroids.T), axis=1, kind="stable"), np.arange(len(index.centroids))[None, :], axis=1)
    ranks = sorted(int(place[r["q"], r["cell"]]) for r in true)
    need = ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else 1
    return Index(index.points, index.centroids, index.within, need)


def kept(rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best of each question among ``question, score, id, cell``."""
    rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
    first = np.searchsorted(rows[0], rows[0])
    return rows[:, np.arange(rows.shape[1]) - first < k]


def search(index: Index, questions: DataFrame, k: int) -> DataFrame:
    """``q, id, score, rank``: the ``k`` nearest points that the probed cells hold, for each question.

    ``questions`` has ``id, vector`` and the columns of ``within``.  Scores are cosines,
    rounded to five places; ties go to the smaller id.  Questions whose cells hold fewer than
    ``k`` points ask all points that they may find instead.
    """
    asking = directed(questions, "id", index.within)
    found = stored(probed(index, asking, k), "hits")
    full = found.filter(F.col("rank") == k).select("q")
    few = stored(asking.select("id").join(full, F.col("id") == F.col("q"), "left_anti").distinct(), "short")
    if few.isEmpty():
        return found
    flat = Index(index.points.withColumn("cell", F.lit(0)), index.centroids[:1], index.within)
    rest = stored(probed(flat, asking.join(few, "id", "left_semi"), k), "rest")
    return found.join(few, found["q"] == few["id"], "left_anti").unionByName(rest)


def exact(points: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``q, id, score, rank``: the ``k`` nearest of all points for each question, as SQL orders them.

    Both have ``id, vector``.  A score is NaN, and so first, where a vector has no finite length
    above 0; it is null, and so last, where one is null or empty.
    """
    ship_package(points.sparkSession)
    n, width = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    cells = np.zeros((max(1, n * width // BLOCK), max(1, width)))
    points = points.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(len(cells))).cast("int").alias("cell"))
    return probed(Index(points, cells, [], len(cells)), questions.select("id", "vector"), k)


def probed(index: Index, questions: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest points, or as many as there are, in the probed cells.

    Points and questions are dealt into parts, and a part of the ones meets a part of the others
    in a task.  So a vector is shuffled once for each part of the other side, however many cells
    are probed.  The parts grow with the tables up to ``TOGETHER`` blocks.
    """
    points, within, centroids = index.points, index.within, index.centroids
    width = centroids.shape[1] if centroids.size else 1
    if within:
        p, q = (rows.groupBy(*within).agg(F.count(F.lit(1)).alias(name)) for rows, name in ((points, "p"), (questions, "q")))
        sizes = stored(p.join(q, within), "sizes")
    else:
        sizes = points.sparkSession.createDataFrame([(points.count(), questions.count())], "p long, q long")
    work, rows = sizes.agg(F.coalesce(F.sum(F.col("p").cast("double") * F.col("q")), F.lit(0.0)), F.coalesce(F.sum(F.greatest("p", "q")), F.lit(0))).first()
    most = max(1, int(min(max((work / TASKS) ** 0.5, BLOCK / width), BLOCK * TOGETHER / width)))
    parts = [F.ceil(F.col(c) / most).cast("long").alias(f"{c}_parts") for c in ("p", "q")]
    large = stored(sizes.filter(F.greatest("p", "q") > most / 4).select(*within, *parts), "large")
    shared_tasks = max(1, -(-rows // most))
    tasks = shared_tasks + (large.agg(F.sum(F.col("p_parts") * F.col("q_parts"))).first()[0] or 0)
    few = None if within else large.first()

    def dealt(df: DataFrame, own: str, at: F.Column, other: str) -> DataFrame:
        """``df`` with the task of each row: one part by ``at``, all parts of the other side."""
        one, mark = F.lit(1).cast("long"), F.xxhash64(*within) if within else F.lit(0).cast("long")
        if within:
            df = df.join(F.broadcast(large), within, "left")
        else:
            df = df.withColumns({c: F.lit(few[c] if few else 1).cast("long") for c in ("p_parts", "q_parts")})
        df = df.withColumns({
            "task": F.when(F.col("p_parts").isNull(), F.pmod(mark, F.lit(shared_tasks))).otherwise(F.pmod(mark, F.lit(2**40)) + shared_tasks),
            own: F.pmod(at, F.coalesce(f"{own}_parts", one)),
            other: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"{other}_parts", one) - 1)),
        }).drop("p_parts", "q_parts")
        return df.repartition(min(8 * tasks, 2000), "task", "p", "q")

    blocks = blocked(points, [*within, "cell"], width, "points")
    held = dealt(blocks, "p", F.col("cell") + F.col("slot"), "q")
    asking = dealt(questions, "q", F.xxhash64("id"), "p")
    shared = questions.sparkSession.sparkContext.broadcast(centroids)
    probes = min(index.probes, len(centroids))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        return nearest_in_task(asked, held, within, shared.value, probes, k)

    keys = ["task", "p", "q"]
    found = asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, "q long, id long, score double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def with_payload(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Hits with all other columns of the points; a point that many questions find is looked up apart."""
    return by_key(hits, points, "id")
