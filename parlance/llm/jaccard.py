"""N-gram Jaccard join by universe partition.

A document is the set of its distinct word shingles, as 64-bit hashes.  Sets are
banded by size so that linked sets lie in one band or in neighbouring ones.  For
a band, two linked sets differ in at most ``H`` tokens.  A hash cuts the universe
of tokens into segments; with ``m`` segments of which ``m1`` tolerate one
difference, ``m + m1 = H + 1``, some segment of a linked pair holds equal subsets,
or subsets one token apart if it is one of the ``m1`` (pigeonhole).  A segment is
indexed by the hash of its subset, a tolerant one also by those of its subset
without one token.  :func:`allocation` picks ``m1`` by the expected cost: rows of
the index plus chance meetings of ``documents`` unrelated sets.

Equal sets are one node from the start.  Rows that meet under a signature are
compared by parity sketches, whose distance never exceeds the true difference, so
no link is lost; what each task emits is a forest, never all pairs.  Nodes still
connected form blocks, and inside a block sets are compared exactly.

Large groups and blocks are dealt out as tiles, bounded in rows and in tokens
(:func:`links_within`).  First each tile is compared within itself and with the
group's first row.  What that connects is a class; of a group of near copies one class
holds almost all rows.  Then only rows outside the largest class go on, to be
compared with all others: rows that are connected already never meet again.

Texts of one template that are not linked share signatures too, a fixed share of them
each, and have no such class.  Where more pairs than ``FULL`` squared tiles would be
compared in a group, its rows are signed anew by another cut of the universe.  Linked
pairs share a signature under every cut, so only rows that share the group and a new
signature have to meet; this goes on inside the new groups.  A group for which the
count of new pairs is no gain is compared as it is: no pair is ever left out.

Defined cases: a null or wordless text has an empty set and is linked to nothing;
fewer words than ``N`` make one shingle of them all; rows without ``doc_id`` take
no part and keep a null component; rows of one ``doc_id`` are one document, and a
link of either row counts; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import fresh_name, lookup, ship_package, stored

#: Linked if 100 * intersection >= PERCENT * union.
N, PERCENT = 3, 90
#: For the cost model: share of tokens that unrelated sets have in common, share
#: of all sets in one band, and what a row that meets another costs in index rows.
COMMON, BAND_SHARE, MEETING = 0.05, 0.1, 8
#: Rows of a tile, for sketches and for sets, and tokens of a tile of sets, about.
TILE, SET_TILE, TOKENS = 512, 128, 4_000_000
#: A group is cut anew if more pairs than this many squared tiles would be compared, if
#: that leaves one pair of ``GAIN`` at most, and up to ``CUTS`` times.
FULL, GAIN, CUTS = 64, 4, 12
#: Cells of the smallest parity sketch; larger sets have a cell a token or more.
CELLS = 512
#: Rows up to which a table of ids is broadcast (about 16 bytes each).
SMALL = 2_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = mix(out * _A + hashed[k : len(hashed) - width + 1 + k], seed=k + 1)
    return np.unique(out)


@lru_cache(maxsize=None)
def edges(upto: int, percent: int = PERCENT) -> tuple[int, ...]:
    """First sizes of the bands, up to the one that holds ``upto``."""
    e = [1, 2]
    while e[-1] <= upto:
        e.append(max(e[-1] + 1, (e[-1] - 1) * 100 // percent + 1))
    return tuple(e)


def tolerance(band: int, first: tuple[int, ...], percent: int = PERCENT) -> int:
    """Most tokens that linked sets differ in, the smaller one of this band.

    With r + s tokens in all: i >= p u, u + i = r + s, d = u - i, so
    d <= (1 - p) (r + s) / (1 + p).
    """
    r = first[band + 1] - 1
    return (100 - percent) * (r + r * 100 // percent) // (100 + percent)


@lru_cache(maxsize=None)
def allocation(h: int, size: int, documents: int) -> tuple[int, int]:
    """``(m, m1)``: segments, and how many of them tolerate one difference."""

    def cost(m1: int) -> float:
        m = h + 1 - m1
        own = size / m
        met = MEETING * BAND_SHARE * documents
        exact, tolerant = met * COMMON**own, met * (own + 1) * COMMON ** max(own - 1, 0)
        return m + m1 * own + (m - m1) * exact + m1 * tolerant

    m1 = min(range((h + 1) // 2 + 1), key=lambda k: (cost(k), k))
    return h + 1 - m1, m1


def signatures(tokens: np.ndarray, documents: int, percent: int = PERCENT, cut: int = 0) -> np.ndarray:
    """Index keys of a set, under its own band and as the larger set of the one below.

    ``cut`` names one of many independent ways to cut the universe into segments.
    """
    n = len(tokens)
    if not n:
        return np.empty(0, dtype=np.int64)
    first = edges(1 << max(n, 2).bit_length(), percent)
    own = int(np.searchsorted(first, n, side="right")) - 1
    keys = []
    value, at = mix(tokens, seed=77), cut * 1_000_003
    for band in (own, own - 1):
        if band < 0 or not (h := tolerance(band, first, percent)):
            continue  # linked sets are equal here, and equal sets are one node
        m, m1 = allocation(h, first[band + 1] - 1, documents)
        segment = (mix(tokens, seed=1000 + band + at) % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        v, s = value[order], segment[order]
        bounds = np.searchsorted(s, np.arange(m + 1))
        summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
        sums = summed[bounds[1:]] - summed[bounds[:-1]]
        label = mix(np.arange(m, dtype=np.uint64), seed=5000 + band + at)
        keys.append(mix(sums + label))
        if m1:
            few = s < m1
            keys.append(mix(sums[s[few]] - v[few] + label[s[few]]))
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.empty(0, dtype=np.int64)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the numbers of tokens in a power of two of cells.

    Two sets differ in at least as many tokens as their sketches in parities.
    """
    size = max(CELLS, 1 << max(len(tokens) - 1, 0).bit_length())
    cells = np.bincount((mix(tokens, seed=31) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of many rows; a larger one is folded to the size of a smaller one by exclusive or."""

    def __init__(self, rows: list[bytes]):
        self.rows, self.size = rows, np.array([len(r) for r in rows], dtype=np.int64)

    def folded(self, at: np.ndarray, size: int) -> np.ndarray:
        out = np.empty((len(at), size // 8), dtype=np.uint64)
        for own in np.unique(self.size[at]):
            same = np.flatnonzero(self.size[at] == own)
            words = np.frombuffer(b"".join(self.rows[k] for k in at[same]), dtype=np.uint64)
            out[same] = np.bitwise_xor.reduce(words.reshape(len(same), own // size, size // 8), axis=1)
        return out

    def apart(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Parities in which the sketches of each pair differ."""
        out = np.empty(len(u), dtype=np.int64)
        small = np.minimum(self.size[u], self.size[v])
        for size in np.unique(small):
            for part in np.array_split(np.flatnonzero(small == size), max(1, len(u) * int(size) >> 26)):
                x, y = self.folded(u[part], int(size)), self.folded(v[part], int(size))
                out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each of ``n`` rows."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if (root == before).all():
            break
        keep = root[u] != root[v]
        u, v = u[keep], v[keep]
    while (root != root[root]).any():
        root = root[root]
    return root


def base_rows(docs: DataFrame, n: int = N) -> DataFrame:
    """For each row: id, size, two hashes that name the set, sketch."""
    ship_package(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                sets = [shingle_set(t, n) for t in part["text"].to_pylist()]
                sums = [(mix(s, seed=3).sum(dtype=np.uint64), mix(s, seed=4).sum(dtype=np.uint64)) for s in sets]
                keys = np.array(sums, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                        pa.array([sketch(s) for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "sketch"],
                )

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, k1 long, k2 long, sketch binary")


def index_rows(docs: DataFrame, documents: int, n: int = N, percent: int = PERCENT, cut: int = 0) -> DataFrame:
    """``sig, node`` for each signature of each row; nothing of it is stored before the shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                keys = [signatures(shingle_set(t, n), documents, percent, cut) for t in part["text"].to_pylist()]
                node = np.repeat(part["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(node)], names=["sig", "node"])

    return docs.filter("doc_id is not null").mapInArrow(rows, "sig long, node long")


def only(df: DataFrame, ids: DataFrame, how: str, on: str | list[str] = "doc_id") -> DataFrame:
    """Semi or anti join with a stored table of ids; broadcast if that is small."""
    return df.join(F.broadcast(ids) if ids.count() <= SMALL else ids, on, how)


def meeting(index: DataFrame) -> DataFrame:
    """Rows of ``sig, node`` that share their signature.

    Rows stream through in the order of ``sig``; a row needs its neighbours only.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        before = None  # the signature before the held rows

        def emit(sig, node, last):
            """All rows but a last one that the next batch may join; returns what stays."""
            nonlocal before
            end = len(sig) if last else len(sig) - 1
            if end <= 0:
                return None
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            new[0] = before is None or sig[0] != before
            shared = ~new
            shared[:-1] |= ~new[1:]
            keep = np.flatnonzero(shared[:end])
            before = sig[end - 1]
            return pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep])], names=["sig", "node"])

        for batch in batches:
            sig, node = (np.concatenate([h, batch[c].to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("sig", "node"), strict=True))
            out = emit(sig, node, False)
            held = (sig[-1:], node[-1:])
            if out is not None:
                yield out
        if len(held[0]) and (out := emit(*held, True)) is not None:
            yield out

    return index.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(rows, "sig long, node long")


def links_within(
    members: DataFrame, payload: DataFrame, most: int, compare: Callable, resign: Callable[[DataFrame, int], DataFrame] | None = None, cut: int = 0
) -> DataFrame:
    """``u, v``: edges that connect what pairs within the groups of ``members`` connect.

    ``members`` has ``key, node, tokens`` (long) and may have ``class``, where nodes of one
    class are connected already; ``payload`` a row or more for each
    node with what ``compare`` needs (see :func:`grouped`), which leaves pairs of equal ``class`` out.
    ``resign`` gives ``node, sig`` for a table of nodes and the number of a cut.
    """
    kinds, at = "u long, v long", ["key", "left", "right"]
    if "class" not in members.columns:
        members = members.withColumn("class", F.col("node"))
    # what makes the members (joins, signatures) runs once, however many steps read them
    members = stored(members, "members")
    sizes = stored(
        members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.min(F.struct("node", "class")).alias("first")).filter("n > 1"),
        "sizes",
    )
    parts = lambda n, t: F.greatest(F.ceil(n / F.lit(most)), F.ceil(t / F.lit(TOKENS))).cast("long")
    zero = F.lit(0).cast("long")
    whole = sizes.select("key", "first", parts(F.col("n"), F.col("t")).alias("tiles"))
    several = whole.filter("tiles > 1")
    place = lambda tiles: F.pmod(F.xxhash64("node"), tiles)
    alone = several.isEmpty()
    dealt = lookup(members, whole.select("key", "tiles"), "key").filter("tiles is not null")
    dealt = dealt if alone else stored(dealt, "dealt")
    own = dealt.select("key", place(F.col("tiles")).alias("left"), zero.alias("right"), "node", "class")
    # the first row visits the other tiles
    visits = several.select("key", F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("left"), zero.alias("right"), "first.node", "first.class")
    met = lambda rows: rows.join(payload, "node").repartition(*at).sortWithinPartitions(*at).mapInArrow(grouped(compare, at), kinds)
    if alone:
        return met(own)
    near = stored(met(own.unionByName(visits)), "edges")
    known = members.filter("class <> node").select(F.col("node").alias("u"), F.col("class").alias("v")).distinct()
    classes = stored(components(near.unionByName(known) if cut else near), "classes")
    # rows of the groups with several tiles, by class; those outside the largest one go on
    split = dealt.filter("tiles > 1").join(classes, "node", "left").withColumn("class", F.coalesce("root", "class"))
    split = stored(split.select("key", "node", "tokens", "class"), "split")
    counts = split.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    ranked = counts.groupBy("key").agg(
        F.max(F.struct("n", "class", "t")).alias("top"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("classes")
    ).filter("classes > 1")
    plan = stored(ranked.select(
        "key", F.col("top.class").alias("main"), parts(F.col("top.n"), F.col("top.t")).alias("most"),
        parts(F.col("n") - F.col("top.n"), F.col("t") - F.col("top.t")).alias("others"),
        ((F.col("n") - F.col("top.n")).cast("double") * F.col("n")).alias("pairs"),
    ), "plan")
    if resign and cut < CUTS:
        found, plan = _cut_anew(split, plan, payload, most, compare, resign, cut + 1)
        near = near.unionByName(found) if found else near
    if plan.isEmpty():
        return near
    split = lookup(split.select("key", "node", "class"), plan, "key").filter("main is not null")
    every = lambda tiles: F.explode(F.sequence(zero, tiles - 1))
    main, other = split.filter(F.col("class") == F.col("main")), split.filter(F.col("class") != F.col("main"))
    # tiles of the largest class are numbered below 0
    cross = main.select("key", (-1 - place(F.col("most"))).alias("left"), every(F.col("others")).alias("right"), "node", "class").unionByName(
        other.select("key", every(F.col("most")).alias("left"), place(F.col("others")).alias("right"), "node", "class").withColumn("left", -1 - F.col("left"))
    )
    among = other.withColumn("own", place(F.col("others"))).select("key", "own", every(F.col("others")).alias("other"), "node", "class")
    among = among.select("key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "node", "class")
    return near.unionByName(met(cross.unionByName(among)))


def _cut_anew(
    split: DataFrame, plan: DataFrame, payload: DataFrame, most: int, compare: Callable, resign: Callable, cut: int
) -> tuple[DataFrame | None, DataFrame]:
    """Edges of the over-full groups of ``plan`` that another cut makes smaller, and the rest of ``plan``."""
    full = stored(plan.filter(F.col("pairs") > FULL * most * most).select("key", "pairs"), "full")
    if full.isEmpty():
        return None, plan
    rows = stored(lookup(split, full, "key").filter("pairs is not null").select("key", "node", "tokens", "class"), "rows")
    signed = resign(stored(rows.select("node").distinct(), "resigned"), cut)
    spread = stored(
        rows.join(signed, "node").select(F.col("key").alias("before"), F.xxhash64("key", "sig").alias("key"), "node", "tokens", "class"), "spread"
    )
    by_class = spread.groupBy("before", "key", "class").agg(F.count(F.lit(1)).alias("n"))
    by_key = by_class.groupBy("before", "key").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    left = by_key.groupBy("before").agg(F.sum((F.col("n") - F.col("top")).cast("double") * F.col("n")).alias("left"))
    better = full.join(left, full["key"] == left["before"], "left").filter(GAIN * F.coalesce("left", F.lit(0)) <= F.col("pairs"))
    better = stored(better.select(full["key"], F.lit(True).alias("smaller")), "better")
    if better.isEmpty():
        return None, plan
    smaller = lookup(spread, better.withColumnRenamed("key", "before"), "before").filter("smaller").select("key", "node", "tokens", "class")
    rest = stored(lookup(plan, better, "key").filter("smaller is null").drop("smaller"), "plan")
    return links_within(smaller, payload, most, compare, resign, cut), rest


def grouped(compare: Callable[[dict[str, pa.Array]], tuple[np.ndarray, np.ndarray]], names: list[str]):
    """A function for mapInArrow over rows sorted by ``names``: whole groups go to ``compare``.

    ``compare`` gets the columns of a run of whole groups and the groups' bounds,
    and returns pairs of row numbers; the spanning forest of their nodes goes out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            keys = [table[c].to_numpy() for c in names]
            new = np.ones(table.num_rows, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            bounds = np.append(np.flatnonzero(new), table.num_rows)
            u, v = compare(table, bounds)
            node = table["node"].to_numpy()
            root = forest(len(node), u, v)
            # rows of one node may be several
            a, b = node, node[root]
            keep = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["u", "v"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            last = np.logical_and.reduce([table[c].to_numpy() == table[c][-1].as_py() for c in names])
            start = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = table.slice(start)
            if start:
                yield emit(table.slice(0, start))
        if held is not None and held.num_rows:
            yield emit(held)

    return rows


def _by_sketch(table: pa.Table, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group whose sketches allow a link."""
    n, kind = table["n_shingles"].to_numpy(), table["class"].to_numpy()
    sketches = Sketches(table["sketch"].to_pylist())
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    us, vs = [], []
    for step in range(1, int(np.diff(bounds).max(initial=1))):
        u = np.flatnonzero(group[step:] == group[:-step])
        if not len(u):
            break
        v = u + step
        small, large = np.minimum(n[u], n[v]), np.maximum(n[u], n[v])
        ok = (100 * small >= percent * large) & (kind[u] != kind[v])
        u, v = u[ok], v[ok]
        ok = (100 + percent) * sketches.apart(u, v) <= (100 - percent) * (n[u] + n[v])
        us.append(u[ok])
        vs.append(v[ok])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, int), np.empty(0, int))


def _near_pairs(percent: int):
    """A function for mapInArrow over pairs with sizes and sketches: those that may be linked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = np.arange(batch.num_rows)
            n, m = batch["n_shingles"].to_numpy(), batch["n_shingles_b"].to_numpy()
            apart = Sketches(batch["sketch"].to_pylist() + batch["sketch_b"].to_pylist()).apart(u, u + batch.num_rows)
            ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch["node"].filter(keep), batch["node_b"].filter(keep)], names=["u", "v"])

    return rows


def _by_set(table: pa.Table, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are linked: sizes of intersections by products of 0-1 matrices, in slices of tokens."""
    us, vs = [], []
    kind = table["class"].to_numpy()
    lists = table["tokens"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a < 2:
            continue
        sizes = np.diff(offsets[a : b + 1])
        own = np.repeat(np.arange(b - a), sizes)
        kinds, column = np.unique(flat[offsets[a] : offsets[b]], return_inverse=True)
        order = np.argsort(column, kind="stable")
        own, column = own[order], column[order]
        common = np.zeros((b - a, b - a), dtype=np.float32)
        width = max(1, min(len(kinds), 4_000_000 // int(b - a)))
        for low in range(0, len(kinds), width):
            x, y = np.searchsorted(column, [low, low + width])
            ones = np.zeros((b - a, width), dtype=np.float32)
            ones[own[x:y], column[x:y] - low] = 1
            common += ones @ ones.T
        i = np.rint(common).astype(np.int64)
        linked = np.triu(100 * i >= percent * (sizes[:, None] + sizes[None, :] - i), 1)
        linked &= kind[a:b][:, None] != kind[a:b][None, :]
        u, v = np.nonzero(linked)
        us.append(u + a)
        vs.append(v + a)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, int), np.empty(0, int))


def links(rows: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``u, v``: edges between nodes that connect what links connect, one row per node and task at most.

    ``docs`` are the texts to link and ``rows`` their sizes and sketches.
    """
    kinds = "u long, v long"
    shared = stored(meeting(index_rows(docs, rows.count(), n, percent)), "meeting")
    named = rows.select(F.col("doc_id").alias("node"), "n_shingles", "sketch")
    # two rows under a signature: the pair goes on, once however many signatures it shares
    sizes = stored(shared.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")), "sizes")
    other = named.select(*[F.col(c).alias(f"{c}_b") for c in named.columns])
    pairs = sizes.filter("n = 2 and a <> b").select("a", "b").distinct().join(named, F.col("a") == F.col("node")).join(other, F.col("b") == F.col("node_b"))
    near = pairs.select("node", "node_b", "n_shingles", "n_shingles_b", "sketch", "sketch_b").mapInArrow(_near_pairs(percent), kinds)
    many = shared.join(sizes.filter("n > 2").select("sig"), "sig", "left_semi").select(F.col("sig").alias("key"), "node", F.lit(0).cast("long").alias("tokens"))
    documents = rows.count()

    def resign(nodes: DataFrame, cut: int) -> DataFrame:
        return index_rows(only(docs, nodes.withColumnRenamed("node", "doc_id"), "left_semi"), documents, n, percent, cut)

    near = near.unionByName(links_within(many, named, TILE, lambda t, b: _by_sketch(t, b, percent), resign))
    blocks = stored(components(near), "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                found = [shingle_set(t, n).view(np.int64) for t in part["text"].to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["node", "tokens"]
                )

    ids = blocks.select(F.col("node").alias("doc_id"))
    tokens = only(docs, ids, "left_semi").mapInArrow(sets, "node long, tokens array<long>")
    sizes = named.groupBy("node").agg(F.max("n_shingles").alias("tokens"))
    members = blocks.join(sizes, "node").select(F.col("root").alias("key"), "node", "tokens")
    return links_within(members, tokens, SET_TILE, lambda t, b: _by_set(t, b, percent))


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(base_rows(docs, n), "sets")
    named = rows.filter("doc_id is not null and n_shingles > 0")
    same = ["n_shingles", "k1", "k2"]
    nodes = stored(
        named.groupBy(*same).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "nodes"
    )
    equal = F.broadcast(nodes) if nodes.count() <= SMALL else nodes
    copies = stored(named.select("doc_id", *same).join(equal, same).filter("doc_id <> node").select("doc_id", "node"), "copies")
    # the texts of a repeated id may differ, so all of them stay in the index
    twice = named.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    spare = stored(copies.select("doc_id").distinct().join(twice, "doc_id", "left_anti"), "spare")
    found = links(only(named, spare, "left_anti"), only(docs, spare, "left_anti"), n, percent)
    roots = components(found.union(copies))
    return rows.join(roots, rows["doc_id"] == roots["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id; all its columns stay.

    Rows without ``doc_id`` stay.  Rows that share an id are documents of their own if
    their texts differ; of rows with equal id and text one stays.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    twice = stored(ids.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if twice.isEmpty():
        found = stored(jaccard_components(docs, n, percent), "components")
        gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
        return only(docs, stored(gone, "gone"), "left_anti")
    # rows of a repeated id are named by a hash of id and text instead
    key, own = fresh_name(docs, "node"), F.col("doc_id").cast("long")
    digest = F.xxhash64(own, F.coalesce("text", F.lit("")))
    repeated = only(docs, twice, "left_semi").withColumn(key, digest).dropDuplicates([key])
    single = only(docs, twice, "left_anti").withColumn(key, own)
    every = stored(single.unionByName(repeated), "named")
    found = stored(jaccard_components(every.select(F.col(key).alias("doc_id"), "text"), n, percent).distinct(), "components")
    names = every.filter(F.col(key).isNotNull()).select(F.col(key).alias("node"), own.alias("id"))
    linked = found.join(found.groupBy("component_id").count().filter("count > 1").select("component_id"), "component_id")
    ranked = linked.select(F.col("doc_id").alias("node"), "component_id").join(names, "node")
    least = ranked.groupBy("component_id").agg(F.min(F.struct("id", "node")).alias("first")).select("component_id", "first.node")
    gone = stored(ranked.select("node").join(least.select("node"), "node", "left_anti").withColumnRenamed("node", key), "gone")
    return only(every, gone, "left_anti", key).select(*docs.columns)


def op5_partition_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: 3-word shingles, similarity of 0.9 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
