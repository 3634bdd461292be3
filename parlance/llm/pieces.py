"""SentencePiece encoding and decoding, giant documents by a max-plus scan.

A text's pieces are the segmentation with the largest sum of the model's piece
scores (the unigram algorithm), with byte pieces for characters that no piece
covers.  Documents of at most ``CHUNK`` characters are encoded where they lie.
Longer ones are split into chunks, a row each.  The state at a chunk's boundary is
how far the first cut at or after it lies behind it.  A chunk yields a matrix: the
best score from each entry state to each exit state.  Matrices combine by max-plus
products, ``FAN`` neighbours at a time, level by level; from the top, every level
then hands its parts the best scores of all their entry states.  With these a chunk
tells, for each exit state, where the best way to it entered; the exits of a
document's chunks follow from its end (a number for each state and chunk), and
then each chunk is traced back on its own.  No task holds more than ``FAN`` matrices or a chunk.

Of segmentations with equal sums the one is taken whose last piece is longest,
then the one before it, and so on, whether a text is in chunks or not.

Pieces never hold a blank mark after another character, so a mark behind another
character is a cut in every segmentation.  Between such cuts, words are encoded
once and remembered, the new ones of many texts together; the matrix of a chunk
needs full sums only near its ends.

The files at hand hold byte-pair models.  Their scores are used as they are: the
ids are the best-scoring segmentation, not the order of merges (see the README).

Defined cases: a null or empty text is one chunk without ids; runs of blanks and
any character round-trip exactly, but that a blank mark in a text comes back as a
blank; repeated rows are encoded one by one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ship_package, stored

MODEL = "piece_bpe_32k.model"
CHUNK = 32_768
FAN = 64
MARK = "▁"
#: Characters of the words that a task remembers at a time.
CACHE = 6_000_000
#: Characters of the texts whose new words are segmented together.
BLOCK = 2_000_000
#: How much lower than the worst piece an uncovered character scores.
UNKNOWN = 10.0
#: Texts between certain cuts where blanks follow one another.
WORD = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")

_coders: dict = {}
_decoders: dict = {}


def _model(file: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=file if "/" in file else public_tokenizers.path(file))


class Words(dict):
    """Numbers of words; a new one gets the next number and is listed in ``fresh``."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Decoder:
    """The plain text of each id, in UTF-8."""

    def __init__(self, file: str = MODEL):
        m = _model(file)
        raw = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(m.get_piece_size())]
        self.count = np.array([len(r) for r in raw])
        self.first = np.cumsum(self.count) - self.count
        self.pool = np.frombuffer(b"".join(raw), np.uint8)

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of runs of ids, a blank in front where the ids have one."""
        counts = self.count[ids]
        ends = np.concatenate([[0], np.cumsum(counts)])[bounds]
        data = self.pool[ragged(self.first[ids], counts)]
        return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))


class Coder:
    """Scores, ids and the segmentation of short texts."""

    def __init__(self, file: str = MODEL):
        m = _model(file)
        every = range(m.get_piece_size())
        self.names = [m.id_to_piece(i) for i in every]
        plain = [i for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.scores = {self.names[i]: m.get_score(i) for i in plain}
        self.bytes = {int(self.names[i][3:5], 16): i for i in every if m.is_byte(i)}
        self.longest = max(map(len, self.ids))
        # every beginning of a piece, with its score if it is one
        self.begins: dict[str, float | None] = {p[:k]: None for p in self.ids for k in range(1, len(p))} | self.scores
        self.bare = min(self.scores.values()) - UNKNOWN
        self._trie()
        self.forget()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a blank mark after another character")
        if any("\n" in p for p in self.ids):
            raise ValueError("a piece holds a line's end")

    def best(self, text: str, upto: int | None = None, reach: list[float] | None = None) -> tuple[list[float], list[int]]:
        """Best scores of all cuts, and the start of the piece before each.

        With ``upto``, no piece starts there or later.  ``reach`` has the scores of
        the first cuts, if pieces from before the text end there.
        """
        n = len(text)
        low = float("-inf")
        score, start = [low] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        if reach:
            score[: len(reach)] = reach[: n + 1]
        begins, bare = self.begins.get, self.bare
        for i in range(n if upto is None else min(n, upto)):
            base = score[i]
            if base == low:
                continue
            j = i + 1
            s = begins(text[i:j], False)
            if s is None or s is False:
                if base + bare > score[j]:
                    score[j], start[j] = base + bare, i
            elif base + s > score[j]:
                score[j], start[j] = base + s, i
            while s is not False and j < n:
                j += 1
                s = begins(text[i:j], False)
                if s is not None and s is not False and base + s > score[j]:
                    score[j], start[j] = base + s, i
        return score, start

    def _trie(self) -> None:
        """Beginnings of pieces as numbered nodes; edges are sorted (node, character) keys."""
        nodes = {"": 0} | {p: k for k, p in enumerate(self.begins, 1)}
        edges = sorted((nodes[p[:-1]] << 21 | ord(p[-1]), k) for p, k in nodes.items() if p)
        self.edges, self.targets = (np.array(c, dtype=np.int64) for c in zip(*edges, strict=True))
        self.id_at = np.array([self.ids.get(p, -1) for p in nodes], dtype=np.int64)
        self.score_at = np.array([self.scores.get(p, 0.0) for p in nodes])

    def forget(self) -> None:
        """Drops the words met so far."""
        self.known = Words()
        self.held = 0
        self.pool, self.first, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts between two certain cuts, one after another, and their numbers.

        As :meth:`best` does it, for all words at once: first all pieces at all
        places, then the best scores by the place in the word.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        total = len(codes)
        begin = np.cumsum(sizes) - sizes
        word_of = np.repeat(np.arange(len(words)), sizes)
        ends = (begin + sizes)[word_of]
        at, node = np.arange(total), np.zeros(total, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []  # place, node, length
        for length in range(1, self.longest + 1):
            key = node << 21 | codes[at + length - 1]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[edge] == key
            if length == 1:
                bare = ~(hit & (self.id_at[self.targets[edge]] >= 0))
                found.append((at[bare], np.full(int(bare.sum()), -1), 1))
            at, node = at[hit], self.targets[edge[hit]]
            whole = self.id_at[node] >= 0
            found.append((at[whole], node[whole], length))
            more = at + length < ends[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        start, node = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        size = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
        score = np.where(node >= 0, self.score_at[node], self.bare)
        place = start - begin[word_of[start]]
        order = np.argsort(place.astype(np.int16) if sizes.max() < 2**15 else place, kind="stable")
        start, node, size, score = start[order], node[order], size[order], score[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=1))])
        # a word has one cell more than characters
        cell = start + word_of[start]
        goal = cell + size
        best, back = np.full(total + len(words), -np.inf), np.zeros(total + len(words), np.int64)
        home = begin + np.arange(len(words))
        best[home] = 0.0
        for low, high in zip(bounds, bounds[1:], strict=False):
            to = goal[low:high]
            reach = best[cell[low:high]] + score[low:high]
            up = np.flatnonzero(reach > best[to])
            best[to[up]], back[to[up]] = reach[up], low + up
        now, taken = home + sizes, []
        while len(now):
            step = back[now]
            taken.append(step)
            now = cell[step]
            going = now > home
            now, home = now[going], home[going]
        chosen = np.concatenate(taken)
        chosen = chosen[np.argsort(start[chosen], kind="stable")]
        # a piece is its id, an uncovered character the ids of its bytes
        first = np.where(node[chosen] >= 0, self.id_at[node[chosen]], -1)
        many = np.ones(len(chosen), np.int64)
        pool = np.arange(len(self.names), dtype=np.int32)
        lone = np.flatnonzero(first < 0)
        if len(lone):
            letters, which = np.unique(codes[start[chosen[lone]]], return_inverse=True)
            spelt = [[self.bytes[b] for b in chr(x).encode("utf-8", "surrogatepass")] for x in letters]
            width = np.array([len(x) for x in spelt])
            first[lone] = (len(pool) + np.cumsum(width) - width)[which]
            many[lone] = width[which]
            pool = np.concatenate([pool, np.fromiter(chain.from_iterable(spelt), np.int32)])
        counts = np.bincount(word_of[start[chosen]], weights=many, minlength=len(words)).astype(np.int64)
        return pool[ragged(first, many)], counts

    @staticmethod
    def units(marked: str) -> list:
        """Parts between certain cuts: a word stands for itself behind a mark, a tuple for any other part."""
        if not marked:
            return []
        if MARK * 2 in marked or marked.endswith(MARK):
            return [w[1:] if w[0] == MARK and MARK not in w[1:] and len(w) > 1 else (w,) for w in WORD.findall(marked)]
        words: list = marked.split(MARK)
        if words[0]:
            words[0] = (words[0],)
        else:
            del words[0]
        return words

    def encode(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose ends are cuts, one after another, and their numbers."""
        if self.held > CACHE:
            self.forget()
        known = self.known
        lists = [self.units(t) for t in marked]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        words = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
        if known.fresh:
            fresh = [MARK + w if isinstance(w, str) else w[0] for w in known.fresh]
            known.fresh.clear()
            ids, many = self.segment(fresh)
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(many) - many])
            self.count = np.concatenate([self.count, many])
            self.pool = np.concatenate([self.pool, ids])
            self.held += sum(map(len, fresh))
        counts = self.count[words]
        upto = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)] if len(lists) else np.empty(0, np.int64)
        return self.pool[ragged(self.first[words], counts)], np.diff(upto, prepend=0)

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best scores from each entry state of a chunk to each exit state, up to a common constant.

        ``text`` is the chunk, ``size`` long, and what pieces that start in it may reach.
        """
        k = self.longest
        out = np.full((k, k), -np.inf)
        cuts = [m.start() + 1 for m in re.finditer(rf"[^{MARK}](?={MARK})", text[:size])]
        first = next((c for c in cuts if k <= c <= size), None)
        if first is None:
            for a in range(min(k, size)):
                s, _ = self.best(text[a:], size - a)
                ends = s[size - a : size - a + k]
                out[a, : len(ends)] = ends
            for a in range(size, k):  # the piece that entered ends behind this chunk
                out[a, a - size] = 0.0
            return out
        # what lies between the first and the last certain cut adds the same to all
        # ways through the chunk, so it is left out
        last = max(c for c in cuts if c <= size)
        s, _ = self.best(text[last:], size - last)
        ends = np.array(s[size - last : size - last + k]) if last < size else np.zeros(1)
        for a in range(k):
            out[a, : len(ends)] = self.best(text[a:first])[0][-1] + ends
        return out

    def entries(self, text: str, size: int, reach: np.ndarray) -> list[int]:
        """For each exit state of a chunk, the entry state of the best way to it.

        ``reach`` has the best scores of the entry states.
        """
        k = self.longest
        cuts = (m.start() + 1 for m in re.finditer(rf"[^{MARK}](?={MARK})", text[:size]))
        first = next((c for c in cuts if k <= c <= size), None)
        _, start = self.best(text[:first] if first else text, None if first else size, list(reach))

        def entry(j: int) -> int:
            while j < len(start) and start[j] >= 0:
                j = start[j]
            return min(j, k - 1)

        return [entry(first)] * k if first else [entry(size + b) for b in range(k)]


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``first`` and are ``count`` long."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - upto + count, count)


def coder(file: str = MODEL) -> Coder:
    if file not in _coders:
        _coders[file] = Coder(file)
    return _coders[file]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _marked(text):
    """The text as the model sees it: a blank mark in front, marks for blanks."""
    marked = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    return F.when(F.length(text) > 0, marked).otherwise(F.lit(""))


def _groups(names: list[str]):
    """Runs of rows with equal ``names``, over batches sorted by them."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[c] != held[0][c] for c in names):
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    return runs


def _as_batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _with_states(chunks: DataFrame, file: str) -> DataFrame:
    """Chunks of giant documents with their best entry and exit states."""
    level_fields = [("uid", pa.int64()), ("at", pa.int64()), ("m", pa.binary())]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(file)
        for batch in batches:
            rows = [(r["uid"], r["at"], c.matrix(r["part"], r["size"]).tobytes()) for r in batch.to_pylist()]
            yield _as_batch(rows, level_fields)

    def side(m: bytes) -> np.ndarray:
        x = np.frombuffer(m)
        k = int(len(x) ** 0.5)
        return x.reshape(k, k)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _groups(["uid", "up"])(batches):
            m = side(run[0]["m"])
            for r in run[1:]:
                m = product(m, side(r["m"]))
            yield _as_batch([(run[0]["uid"], run[0]["up"], m.tobytes())], level_fields)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _groups(["uid", "up"])(batches):
            reach, out = np.frombuffer(run[0]["reach"]), []
            for r in run:
                out.append((r["uid"], r["at"], reach.tobytes()))
                reach = (reach[:, None] + side(r["m"])).max(axis=0)
            yield _as_batch(out, [("uid", pa.int64()), ("at", pa.int64()), ("reach", pa.binary())])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(file)
        for batch in batches:
            rows = [(r["uid"], r["at"], c.entries(r["part"], r["size"], np.frombuffer(r["reach"]))) for r in batch.to_pylist()]
            yield _as_batch(rows, [("uid", pa.int64()), ("at", pa.int64()), ("entries", pa.list_(pa.int32()))])

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a document from its last chunk to its first: it leaves behind its last character."""
        uid, state = None, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                state = 0 if r["uid"] != uid else state
                uid, entry = r["uid"], r["entries"][state]
                out.append((uid, r["at"], entry, state))
                state = entry
            yield _as_batch(out, [("uid", pa.int64()), ("at", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64())])

    kind = "uid long, at long, m binary"
    levels = [stored(chunks.select("uid", "at", "part", "size").mapInArrow(matrices, kind), "matrices")]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("up", F.expr(f"at div {FAN}"))
        up = up.repartition("uid", "up").sortWithinPartitions("uid", "up", "at")
        levels.append(stored(up.mapInArrow(combine, kind), "matrices"))
    # the whole document enters at its first character
    whole = np.full(coder(file).longest, -np.inf)
    whole[0] = 0.0
    ways = levels[-1].select("uid", "at", F.lit(whole.tobytes()).alias("reach"))
    for level in reversed(levels[:-1]):
        below = level.withColumn("up", F.expr(f"at div {FAN}"))
        above = ways.select("uid", F.col("at").alias("up"), "reach")
        below = below.join(above, ["uid", "up"]).repartition("uid", "up").sortWithinPartitions("uid", "up", "at")
        ways = below.mapInArrow(descend, "uid long, at long, reach binary")
    found = chunks.join(ways, ["uid", "at"]).select("uid", "at", "part", "size", "reach").mapInArrow(enter, "uid long, at long, entries array<int>")
    found = found.repartition("uid").sortWithinPartitions("uid", F.col("at").desc())
    found = found.mapInArrow(leave, "uid long, at long, entry long, leave long")
    return chunks.join(stored(found, "states"), ["uid", "at"])


def encode_documents(docs: DataFrame, file: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, chunk, chunks, ids, text_crc32`` for each chunk of each document.

    ``ids`` of a document's chunks, in order, are its ids; ``text_crc32`` is the
    checksum of the part of the text that they stand for, in UTF-8.
    """
    ship_package(docs.sparkSession)
    reach = coder(file).longest
    text = _marked(F.col("text"))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    kind = "doc_id long, chunk long, chunks long, ids array<int>, text_crc32 long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of ``doc_id, chunk, chunks, part``, the part's ends being cuts."""
        c = coder(file)
        for batch in batches:
            sizes = np.cumsum(pc.utf8_length(batch["part"]).to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, BLOCK + (sizes[low - 1] if low else 0), "right")))
                some = batch.slice(low, high - low)
                low = high
                texts = some["part"].to_pylist()
                ids, counts = c.encode(texts)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                plain = (unmarked(t, k == 0) for t, k in zip(texts, some["chunk"].to_pylist(), strict=True))
                sums = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in plain]
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], some["chunk"], some["chunks"], pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)), pa.array(sums, pa.int64())],
                    names=["doc_id", "chunk", "chunks", "ids", "text_crc32"],
                )

    zero = F.lit(0).cast("long")
    short = marked.filter(F.length("text") <= chunk).select("doc_id", zero.alias("chunk"), F.lit(1).cast("long").alias("chunks"), F.col("text").alias("part"))
    long = marked.filter(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())
    parts = long.withColumn("chunks", F.ceil(F.length("text") / F.lit(chunk)).cast("long")).select(
        "doc_id", "uid", "chunks", "text", F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("at")
    ).select(
        "doc_id", "uid", "chunks", "at",
        F.substring("text", (F.col("at") * chunk + 1).cast("int"), F.lit(chunk + reach - 1)).alias("part"),
        F.least(F.lit(chunk), F.length("text") - F.col("at") * chunk).cast("int").alias("size"),
    )
    traced = _with_states(stored(parts, "chunks"), file).select(
        "doc_id", F.col("at").alias("chunk"), "chunks",
        F.substring("part", (F.col("entry") + 1).cast("int"), (F.col("size") + F.col("leave") - F.col("entry")).cast("int")).alias("part"),
    )
    return short.mapInArrow(encode, kind).unionByName(traced.mapInArrow(encode, kind))


def unmarked(text: str, first: bool) -> str:
    """A marked text, or a chunk of one, as it was: without the mark in front, blanks for marks."""
    return (text[1:] if first else text).replace(MARK, " ")


def decode_ids(rows: DataFrame, file: str = MODEL) -> DataFrame:
    """``rows``, as :func:`encode_documents` returns them, with the ``text`` that the ids stand for."""
    ship_package(rows.sparkSession)
    ids, chunk = rows.columns.index("ids"), rows.columns.index("chunk")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file not in _decoders:
            _decoders[file] = Decoder(file)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                some = batch.slice(low, 200)
                lists = some.column(ids)
                bounds = lists.offsets.to_numpy()
                texts = _decoders[file].texts(lists.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0])
                # the first chunk has the mark in front
                texts = pc.if_else(pc.equal(some.column(chunk), 0), pc.utf8_slice_codeunits(texts, 1), texts)
                yield pa.RecordBatch.from_arrays([*some.columns, texts.cast(pa.string())], names=[*some.schema.names, "text"])

    return rows.mapInArrow(decode, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))


def op3_max_plus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded: a row per chunk with the hash of its ids."""
    rows = decode_ids(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select(
        "doc_id", "chunk", "chunks", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"),
        (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"),
    )
