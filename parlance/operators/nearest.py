"""The nearest points of the questions of one task, by numpy.

Products of single precision and a bound of their error tell which points may be among the
nearest; only these are compared in double precision, summed from the first component to the last.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Questions whose cells are looked up together, and those that are multiplied together; points multiplied together at least and at most; products whose best give the first bound; pairs compared together.
LOOKED_UP, ROWS, NARROW, WIDE, FIRST, PAIRS = 4096, 1024, 512, 2048, 512, 2**14
#: Scores that sort as SQL does: not a number first, null last; and no score.
NAN, NULL, NONE = 2.0, -2.0, -3.0
#: Half a unit of the fifth place, and more than the error of the doubles.
HALF, SLACK = 0.5e-5, 1e-9


@dataclass
class Vectors:
    """Vectors by owner; ``like``: 0, or the constant score that all pairs with this one have."""

    id: np.ndarray
    owner: np.ndarray
    x: np.ndarray
    like: np.ndarray

    def __post_init__(self):
        self.square = dots(self.x, self.x)
        self.like = np.where((self.like == 0) & ~((self.square > 0) & (self.square < np.inf)), NAN, self.like)
        self.x[self.like != 0] = 0
        self.square[self.like != 0] = 1
        self.unit = np.empty(self.x.shape, np.float32)
        for a in range(0, len(self.x), PAIRS):
            self.unit[a : a + PAIRS] = self.x[a : a + PAIRS] / np.sqrt(self.square[a : a + PAIRS])[:, None]

    def take(self, rows: np.ndarray) -> Vectors:
        new = object.__new__(Vectors)
        for name in ("id", "owner", "x", "like", "square", "unit"):
            setattr(new, name, getattr(self, name)[rows])
        return new


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, summed from front to back."""
    out = np.zeros(len(x))
    for a in range(0, len(x) if x.shape[1] else 0, PAIRS):
        out[a : a + PAIRS] = np.add.accumulate(x[a : a + PAIRS].astype(float) * y[a : a + PAIRS], axis=1)[:, -1]
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """To five places, halves away from zero."""
    far = np.abs(x) * 1e5
    down = np.floor(far)
    return np.copysign((down + (far - down >= 0.5)) / 1e5, x) + 0.0


def cosines(q: Vectors, p: Vectors, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    out = np.empty(len(row))
    for a in range(0, len(row), PAIRS):
        i, j = row[a : a + PAIRS], column[a : a + PAIRS]
        out[a : a + PAIRS] = dots(q.x[i], p.x[j]) / np.sqrt(p.square[j] * q.square[i])
    return rounded(np.clip(out, -1, 1))


def whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def vectors(ids: pa.Array, column: pa.Array, owner: np.ndarray, width: int) -> Vectors:
    length = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    there, x = length > 0, np.zeros((len(column), width), np.float32 if pa.types.is_float32(column.type.value_type) else float)
    if there.any():
        if (length[there] != width).any():
            raise ValueError(f"vectors of other than {width} components")
        x[there] = np.asarray(column.flatten().to_numpy(zero_copy_only=False), x.dtype).reshape(there.sum(), -1)
    x += 0  # no minus zero
    return Vectors(np.asarray(ids.to_numpy(zero_copy_only=False)), owner, x, np.where(there, 0, NULL))


def owners(asked: pa.Table, held: pa.Table, within: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for the values of ``within``, the same on both sides."""
    code = np.zeros(asked.num_rows + held.num_rows, np.int64)
    for c in within:
        value = pa.concat_arrays([whole(asked[c]), whole(held[c])]).dictionary_encode()
        at = np.asarray(value.indices.fill_null(-1)) + 1
        code = np.unique(code * (len(value.dictionary) + 1) + at, return_inverse=True)[1]
    return code[: asked.num_rows], code[asked.num_rows :]


def copies(v: Vectors, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by owner, kind, cell, vector and id; true where a row has another vector than the one before."""
    odd = np.random.default_rng(1).integers(0, 2**63, v.x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mark, bits = np.zeros(len(v.x), np.uint64), np.uint32 if v.x.itemsize == 4 else np.uint64
    for a in range(0, len(v.x), PAIRS):
        mark[a : a + PAIRS] = v.x[a : a + PAIRS].view(bits).astype(np.uint64) @ odd
    order = np.lexsort((v.id, mark, cell, v.like, v.owner))
    new = np.ones(len(order), bool)
    new[1:] = np.any([key[order[1:]] != key[order[:-1]] for key in (v.owner, v.like, cell, mark)], axis=0)
    same = np.flatnonzero(~new)
    for a in range(0, len(same), PAIRS):
        at = same[a : a + PAIRS]
        new[at] = (v.x[order[at]] != v.x[order[at - 1]]).any(axis=1)
    return order, new


def offer(top: np.ndarray, ids: np.ndarray, row: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
    """Puts scores in the place of lesser ones of their row; ties to the smaller id."""
    k = top.shape[1]
    order = np.lexsort((id, -score, row))
    row, score, id = row[order], score[order], id[order]
    who, first, count = np.unique(row, return_index=True, return_counts=True)
    place = np.arange(len(row)) - np.repeat(first, count)
    at, good = np.repeat(np.arange(len(who)), count), place < k
    s, i = np.concatenate([top[who], np.full((len(who), k), NONE)], axis=1), np.concatenate([ids[who], np.zeros((len(who), k), ids.dtype)], axis=1)
    s[at[good], k + place[good]], i[at[good], k + place[good]] = score[good], id[good]
    best = np.lexsort((i, -s), axis=-1)[:, :k]
    top[who], ids[who] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def true_at(mask: np.ndarray) -> np.ndarray:
    """Places that are true, where few are: eight at a time first."""
    mask = mask.ravel()
    even = len(mask) // 8 * 8
    at = (np.flatnonzero(mask[:even].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[mask[at]], np.flatnonzero(mask[even:]) + even])


def pieces(cell: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of the sorted cells that are multiplied together: small cells together, large ones in pieces."""
    ends, out, lo = [*np.flatnonzero(np.diff(cell)) + 1, len(cell)], [], 0
    for end in ends:
        if end - lo >= NARROW or end == len(cell):
            out += [(a, min(a + WIDE, end)) for a in range(lo, end, WIDE)]
            lo = end
    return out


def meet(q: Vectors, p: Vectors, cell: np.ndarray, probed: np.ndarray | None, top: np.ndarray, ids: np.ndarray) -> None:
    """Offers the points to the questions that probe their cells (``probed``, by cell and question; all if none)."""
    k, error = top.shape[1], (p.x.shape[1] + 8) * 2.0**-24 + SLACK
    below = lambda s: np.nextafter(np.maximum(s, NULL).astype(np.float32), np.float32(-4))
    floor = below(np.where(top[:, -1] > NULL, top[:, -1] - HALF - error, NULL))
    for lo, hi in pieces(cell):
        several = probed is not None and cell[lo] != cell[hi - 1]
        asks = np.arange(len(q.id)) if probed is None else np.flatnonzero(probed[np.unique(cell[lo:hi])].any(axis=0)) if several else np.flatnonzero(probed[cell[lo]])
        for a in range(0, len(asks), ROWS):
            who = asks[a : a + ROWS]
            s = (q.unit if len(who) == len(q.unit) else q.unit[who]) @ p.unit[lo:hi].T
            if several:
                s[~probed[cell[lo:hi]][:, who].T] = -np.inf
            if hi - lo >= k and len(new := np.flatnonzero(floor[who] <= NULL)):
                kth = np.partition(s[new, : max(k, FIRST)], -k, axis=1)[:, -k].astype(float)
                floor[who[new]] = below(kth - 2 * error - 2 * HALF)
            row, column = np.divmod(true_at(s >= floor[who][:, None]), hi - lo)
            if len(row):
                row, column = who[row], column + lo
                offer(top, ids, row, cosines(q, p, row, column), p.id[column])
                row = np.unique(row)
                floor[row] = np.maximum(floor[row], below(np.where(top[row, -1] > NULL, top[row, -1] - HALF - error, NULL)))


def nearest_in_task(asked: pa.Table, held: pa.Table, within: list[str], centroids: np.ndarray, probes: int, k: int) -> pa.Table:
    """``q, id, score`` of the ``k`` best points for each question; ``held`` has blocks of points of a cell."""
    names = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    if not asked.num_rows or not held.num_rows or not probes:
        return names.empty_table()
    mine, theirs = owners(asked, held, within)
    block = whole(held["points"])
    many = np.asarray(pc.list_value_length(block))
    points = block.flatten()
    width = centroids.shape[1]
    p = vectors(pc.struct_field(points, "id"), pc.struct_field(points, "vector"), np.repeat(theirs, many), width)
    cell = np.repeat(np.asarray(whole(held["cell"])), many)
    q = vectors(whole(asked["id"]), whole(asked["vector"]), mine, width)
    # of equal points the k smallest ids can be found; equal questions are answered once
    order, new = copies(p, cell)
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    order = order[np.arange(len(new)) - start < k]
    p, cell = p.take(order), cell[order]
    order, new = copies(q, np.zeros(len(q.id), int))
    all_ids, answer = q.id[order], np.cumsum(new) - 1
    q = q.take(order[new])
    top, ids = np.full((len(q.id), k), NONE), np.zeros((len(q.id), k), np.int64)
    near = centroids.astype(np.float32).T
    for owner in np.intersect1d(q.owner, p.owner):
        qs, ps = (slice(*np.searchsorted(v.owner, [owner, owner + 1])) for v in (q, p))
        here, cells = p.take(ps), cell[ps]
        some, plain = here.take(here.like != 0), slice(*np.searchsorted(here.like, [0, 0.5]))
        here_plain = here.take(plain)
        for r in np.flatnonzero(q.like[qs] != 0) + qs.start:  # one of each kind at most
            offer(top, ids, np.full(len(here.id), r), np.minimum(q.like[r], np.where(here.like == NULL, NULL, NAN)), here.id)
        ordinary = np.flatnonzero(q.like[qs] == 0) + qs.start
        for a in range(0, len(ordinary), LOOKED_UP):
            rows = ordinary[a : a + LOOKED_UP]
            if len(some.id):
                offer(top, ids, np.repeat(rows, len(some.id)), np.tile(some.like, len(rows)), np.tile(some.id, len(rows)))
            if len(here_plain.id):
                asks, best, best_ids, probed = q.take(rows), top[rows], ids[rows], None
                if probes < len(centroids):
                    probed = np.zeros((len(centroids), len(rows)), bool)
                    probed[np.argpartition(-(asks.unit @ near), probes - 1, axis=1)[:, :probes].T, np.arange(len(rows))] = True
                meet(asks, here_plain, cells[plain], probed, best, best_ids)
                top[rows], ids[rows] = best, best_ids
    top, ids = top[answer], ids[answer]
    row, column = np.nonzero(top > NONE)
    score = top[row, column]
    score = pa.array(np.where(score == NAN, np.nan, score), mask=score == NULL)
    return pa.Table.from_arrays([pa.array(all_ids[row]), pa.array(ids[row, column]), score], schema=names)
