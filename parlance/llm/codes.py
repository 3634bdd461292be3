"""Codes of vectors by product quantisation, codebooks fitted by filtering Lloyd rounds.

Every task cuts its vectors into blocks and builds a kd-tree over each part of a block's
vectors, with the bounding box, the sum and the count of every node.  The trees are
stored once; each round walks them from the roots with the entries of a codebook: an
entry is struck out where no point of a node's box can be nearer to it than to the entry
nearest to the middle of the box, and a node that keeps one entry is assigned whole, by
its sum and count.  Only sums and counts of entries leave a task, and the driver holds
the codebooks (256 entries) alone.

All figures are integers and all comparisons are exact: float64 products where they fit
into 53 bits, Python integers elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column_or_null, lookup, ship_package, stored

#: Scale of components, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of a block, and points from which a node of its trees is split.
BLOCK, LEAF = 4096, 16
#: Boxes times entries times components that are compared at once.
CELLS = 2**18
#: Bits of integers that are coded; wider vectors get no code.
WIDEST = 50


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v``: vectors without null or non-finite components, as integers."""
    cells = F.col("embedding").cast("array<double>")
    whole = F.forall(cells, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wide = F.exists(cells, lambda x: F.abs(x) * scale >= 2.0**WIDEST)
    exact = F.transform(cells, lambda x: F.floor(x * scale).cast("long"))
    rows = vectors.select(column_or_null(vectors, "vec_id", "long").alias("vec_id"), column_or_null(vectors, "label", "string").alias("label"), "embedding")
    return rows.filter(F.coalesce(whole, F.lit(False))).select("vec_id", "label", F.when(~wide, exact).alias("v"))


def halvings(n: int) -> list[np.ndarray]:
    """Bounds of the nodes of each level of a tree of ``n`` points, from the root down."""
    levels = [np.array([0, n])]
    while (sizes := np.diff(levels[-1])).max() > LEAF:
        levels.append(np.union1d(levels[-1], (levels[-1][:-1] + sizes // 2)[sizes > LEAF]))
    return levels


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A kd-tree: the points' order, and the box and the sum of every node, level by level.

    A node is halved at the median of its widest side while it has more than ``LEAF``
    points; counts are differences of bounds.
    """
    order, levels = np.arange(len(points), dtype=np.int32), halvings(len(points))
    for upper, lower in zip(levels, levels[1:], strict=False):
        for middle in np.setdiff1d(lower, upper):
            k = np.searchsorted(upper, middle)
            a, b = upper[k - 1], upper[k]
            own = points[order[a:b]]
            side = int((own.max(axis=0) - own.min(axis=0)).argmax())
            order[a:b] = order[a:b][np.argpartition(own[:, side], middle - a)]
    points = points[order]
    nodes = [np.stack([f.reduceat(points, bounds[:-1]) for f in (np.minimum, np.maximum, np.add)], axis=1) for bounds in levels]
    return order, np.concatenate(nodes)


def tree(points: np.ndarray, order: np.ndarray, nodes: np.ndarray) -> dict:
    """A stored tree with its levels: bounds, boxes, sums, and each node's parent in the level above."""
    levels, at, above = [], 0, None
    for bounds in halvings(len(points)):
        own = nodes[at : at + len(bounds) - 1]
        parent = np.searchsorted(above, bounds[:-1], side="right") - 1 if above is not None else np.zeros(1, np.int64)
        levels.append((bounds, own[:, 0], own[:, 1], own[:, 2], parent))
        at, above = at + len(own), bounds
    return {"order": order, "points": points[order], "levels": levels}


def exact_kind(points_bound: int, book: np.ndarray) -> type:
    """float64 where squared distances stay exact in it, else Python integers."""
    most = max(points_bound, int(np.abs(book).max()) if book.size else 0)
    return np.float64 if 16 * book.shape[1] * (most + 1) ** 2 < 2**53 else object


def distances(points: np.ndarray, book: np.ndarray, kind: type) -> np.ndarray:
    """Squared distances without the points' own squares: |z|^2 - 2 x z."""
    x, z = points.astype(kind), book.astype(kind)
    return (z * z).sum(axis=1)[None, :] - 2 * x.dot(z.T)


def assign(found: dict, book: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point (ties to the lower index), and sums and counts of entries.

    ``book`` holds distinct or equal entries alike; of equal ones the first gets all.
    """
    kind = exact_kind(bound, book)
    points, z = found["points"], book.astype(kind)
    nearest = np.full(len(points), -1)
    sums, counts = np.zeros(book.shape, object if kind is object else np.int64), np.zeros(len(book), np.int64)
    alive = np.ones((1, len(book)), bool)  # entries of the nodes that are not assigned yet
    open_ = np.zeros(1, np.int64)
    last = len(found["levels"]) - 1
    numbers = np.arange(len(book))
    for k, (bounds, low, high, total, parent) in enumerate(found["levels"]):
        if k:
            at = np.searchsorted(open_, parent).clip(max=len(open_) - 1)
            here = np.flatnonzero(open_[at] == parent)
            alive, open_ = alive[at[here]], here
        for some in np.array_split(np.arange(len(open_)), -(-len(open_) * book.size // CELLS) or 1):
            node = open_[some]
            lo, hi = low[node].astype(kind), high[node].astype(kind)
            # nearest to the middle, all figures doubled: |2z - (lo + hi)|^2 without its constant part
            to_middle = 4 * (z * z).sum(axis=1)[None, :] - 4 * (lo + hi).dot(z.T)
            to_middle = np.where(alive[some], to_middle, np.inf if kind is np.float64 else 2**300)
            best = to_middle.argmin(axis=1)
            # the corner that lies farthest towards z: there z beats the best entry if anywhere
            step = z[None, :, :] - z[best][:, None, :]
            corner = np.where(step > 0, hi[:, None, :], lo[:, None, :])
            ahead = ((z[None, :, :] - corner) ** 2).sum(axis=2) - ((z[best][:, None, :] - corner) ** 2).sum(axis=2)
            beaten = (ahead > 0) | ((ahead == 0) & (numbers[None, :] > best[:, None]))
            alive[some] &= ~beaten.astype(bool)
        alone = alive.sum(axis=1) == 1
        for node, entry in zip(open_[alone], alive[alone].argmax(axis=1), strict=True):
            a, b = bounds[node], bounds[node + 1]
            nearest[a:b] = entry
            sums[entry] += total[node]
            counts[entry] += b - a
        alive, open_ = alive[~alone], open_[~alone]
        if not len(open_):
            break
        if k == last:
            for node, rest in zip(open_, alive, strict=True):
                a, b = bounds[node], bounds[node + 1]
                left = np.flatnonzero(rest)
                nearest[a:b] = left[distances(points[a:b], book[left], kind).argmin(axis=1)]
                np.add.at(sums, nearest[a:b], points[a:b].astype(sums.dtype))
                counts += np.bincount(nearest[a:b], minlength=len(book))
    return nearest, sums, counts


def cut(width: int, parts: int = PARTS) -> list[slice]:
    """Consecutive parts of a vector, equal if ``width`` allows it, else the first ones longer."""
    sizes = [width // parts + (k < width % parts) for k in range(parts)]
    ends = np.cumsum([0, *sizes])
    return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


TREES = T.StructType([
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("vectors", T.BinaryType()), T.StructField("orders", T.BinaryType()),
    T.StructField("nodes", T.BinaryType()),
])


def grow_trees(rows: DataFrame, width: int) -> DataFrame:
    """A row for each block of a task's vectors: ids, labels, vectors, and the tree of each part.

    All vectors have ``width`` components.
    """
    slices = cut(width)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                cells = np.asarray(part.column("v").flatten().to_numpy(zero_copy_only=False), np.int64).reshape(part.num_rows, width)
                orders, nodes = zip(*(build(cells[:, s]) for s in slices), strict=True)
                columns = [pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("label").to_pylist()], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([cells.tobytes()], pa.binary()), *(pa.array([b"".join(x.tobytes() for x in y)], pa.binary()) for y in (orders, nodes))], names=TREES.names)

    return rows.select("vec_id", "label", "v").mapInArrow(grow, TREES)


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list, np.ndarray, list[dict]]]:
    """Ids, labels, vectors and trees of stored blocks."""
    for batch in batches:
        for ids, labels, vectors, orders, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cells, n, at, trees = np.frombuffer(vectors, np.int64).reshape(len(ids), width), sum(len(b) - 1 for b in halvings(len(ids))), 0, []
            held = np.frombuffer(nodes, np.int64)
            for s, order in zip(cut(width), np.frombuffer(orders, np.int32).reshape(PARTS, len(ids)), strict=True):
                wide = s.stop - s.start
                trees.append(tree(cells[:, s], order, held[at : at + n * 3 * wide].reshape(n, 3, wide)))
                at += n * 3 * wide
            yield ids, labels, cells, trees


def refine(trees: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: every part assigned, every used entry the floored mean of its parts."""
    spark = trees.sparkSession
    shared = spark.sparkContext.broadcast(books)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        sums, counts = [b.astype(object) * 0 for b in held], [np.zeros(len(b), np.int64) for b in held]
        for _, _, cells, parts in blocks(batches, width):
            bound = int(np.abs(cells).max()) if cells.size else 0
            for p, own in enumerate(parts):
                _, s, c = assign(own, held[p], bound)
                sums[p] += s
                counts[p] += c
        for p, (s, c) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(c)
            rows = [(p, int(e), j, int(c[e]), str(s[e, j])) for e in used for j in range(s.shape[1])]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["part", "entry", "place", "n", "total"])

    found = trees.mapInArrow(gather, "part int, entry int, place int, n long, total string")
    means = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = [b.copy() for b in books]
    for r in means.collect():  # a number for each component of the codebooks
        new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return new


def fit(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict:
    """Codebooks of ``rows`` (``vec_id, label, v``), and the trees that they were fitted on.

    A codebook starts as a part of the vectors with the smallest ids (nulls last, equal ids
    by their integers).  The first of them tells the width; vectors of other widths count
    for nothing.
    """
    ship_package(rows.sparkSession)
    coded = rows.filter("size(v) > 0")
    seeds = [r["v"] for r in coded.sort(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    width = len(seeds[0]) if seeds else 0
    if seeds and any(len(s) != width for s in seeds):
        seeds = [r["v"] for r in coded.filter(F.size("v") == width).sort(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    first = np.array(seeds, np.int64).reshape(len(seeds), width)
    books = [first[:, s] for s in cut(width)]
    trees = stored(grow_trees(coded.filter(F.size("v") == width), width), "trees")
    for _ in range(rounds if seeds else 0):
        books = refine(trees, books, width)
    return {"width": width, "books": books, "trees": trees}


def encode(model: dict) -> DataFrame:
    """``vec_id, label, code, error`` of the vectors that the model was fitted on.

    ``error`` is null where it is beyond the range of long.
    """
    trees, width = model["trees"], model["width"]
    shared = trees.sparkSession.sparkContext.broadcast(model["books"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for ids, labels, cells, parts in blocks(batches, width):
            bound = int(np.abs(cells).max()) if cells.size else 0
            digits, error = np.empty((len(ids), PARTS), np.int64), np.zeros(len(ids), object)
            for p, (own, s) in enumerate(zip(parts, cut(width), strict=True)):
                nearest, _, _ = assign(own, books[p], bound)
                digits[own["order"], p] = nearest
                kind = object if exact_kind(bound, books[p]) is object else np.int64
                away = cells[:, s].astype(kind) - books[p].astype(kind)[digits[:, p]]
                error = error + (away * away).sum(axis=1)
            codes = ["".join(f"{x:02x}" for x in row) for row in digits.tolist()]
            errors = [int(e) if e < 2**63 else None for e in error]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"]
            )

    return trees.mapInArrow(code, "vec_id long, label string, code string, error long")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op11_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors.

    A vector that is null, or holds a null or a component that is not finite, is dropped.
    One without components, of another width than the first one, or with integers of
    more than ``WIDEST`` bits stays, without code and error, and is not learned from.
    Widths that four does not divide give longer first parts.  Null ids come last as first
    entries; repeated rows count as often as they are there; equal entries and ties
    go to the lower index; fewer than 256 vectors make smaller codebooks; an empty table
    gives no rows; other columns are not read.
    """
    rows = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    model = fit(rows)
    odd = rows.filter(F.coalesce(F.size("v") != model["width"], F.lit(True)) | (F.coalesce(F.size("v"), F.lit(0)) <= 0))
    none = odd.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = encode(model).unionByName(none)
    name = F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")).alias("name")
    coded = stored(coded.select("vec_id", name, "code", "error"), "codes")
    totals = coded.groupBy("name").agg(F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS long)").alias("label_error"))
    return lookup(coded, stored(totals, "labels"), "name").select("vec_id", "code", "error", "label_error", F.lit(books_digest(model["books"])).alias("codebooks_sha256"))
