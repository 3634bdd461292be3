"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary.
A word's probability is the sum, over all ways to cut it into pieces, of the
product of their probabilities: the forward algorithm.  Piece probabilities are
fitted by expectation maximisation (the backward pass gives expected counts) on
a bounded sample of labelled documents, ``SAMPLE`` of each language at most
(:func:`train`), or on all of them (:func:`train_whole`).
Words are maximal runs of letters, in lower case; pieces never cross a blank, so
a text's log likelihood is the sum over its words, and each distinct word is
scored once for a task.  The score is the posterior of the best language under
equal priors.  A text in no learned language has a high posterior too, so
:func:`likelihood_floors` tells how likely a letter of a text is at least, by what
the sample shows for each language.

A letter is what ``str.isalpha`` says (the Unicode categories L), in fitting and in
prediction alike.  What the driver gets for fitting are the sample's word counts; they
grow with its documents' lengths and the number of languages, not with the corpus.  Of
all documents it gets sums for each piece and language alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text if there is no labelled row to learn from; equal posteriors go to
the first language in alphabetical order; letters outside the vocabulary have a
fixed small probability; the prediction depends on the text only; an empty table
gives no rows; extra columns are kept by :func:`identify` as they are, but those that
have the names of its results, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lowest, ship_package, stored

#: Labelled documents of a language that piece probabilities are fitted on.
SAMPLE = 400
#: Rows up to which the ids of the sample are broadcast.
SMALL = 1_000_000
ROUNDS = 4
SMOOTH = 0.1
#: Probability of a letter that no piece covers.
UNKNOWN = 1e-7
VOCABULARY = "piece_bpe_32k.model"
#: Characters of the distinct words that a task keeps scores for at a time.
CACHE = 4_000_000
#: Letters of a word beyond which sums of its segmentations are taken as logarithms.
LINEAR = 64
#: Words of one length that are segmented together have so many characters at most (or are one word).
CELLS = 1 << 19
#: Nats below the lowest likelihood of a letter (but for one text in a hundred) that still count as the language.
MARGIN = 1.0
#: Rows whose new words are scored together.
BLOCK = 500
#: Distinct words of a task in a round of fitting to all words, and pieces whose expected counts are sent together.
WORDS, PIECES = 20_000, 1024
SPACE = "▁"
BASE = np.uint64(1_099_511_628_211)
#: Letters, and numbers that are no digits: those are taken out afterwards.
NEARLY = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters, in lower case."""
    found = NEARLY.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def vocabulary(file: str = VOCABULARY) -> list[str]:
    """Pieces of lower-case letters, with or without the mark of a word's start."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file if "/" in file else public_tokenizers.path(file))
    pieces = (
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    )
    body = re.compile(rf"{SPACE}?[^\W\d_]*")
    return sorted({p for p in pieces if p == p.lower() and p and body.fullmatch(p)})


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


class Pieces:
    """The vocabulary as sorted hashes, one array for each length."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p in pieces}):
            ids = [k for k, p in enumerate(pieces) if len(p) == n]
            codes = _codes([pieces[k] for k in ids])
            hashed = np.zeros(len(ids), dtype=np.uint64)
            for j in range(n):
                hashed = hashed * BASE + codes[:, j]
            order = np.argsort(hashed)
            self.by_length[n] = hashed[order], np.array(ids)[order]
        self.longest = max(self.by_length, default=1)

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, length, rows, piece ids) of all pieces in words of one length."""
        n = codes.shape[1]
        for start in range(n):
            hashed = np.zeros(len(codes), dtype=np.uint64)
            for length in range(1, min(self.longest, n - start) + 1):
                hashed = hashed * BASE + codes[:, start + length - 1]
                if length not in self.by_length:
                    continue
                known, ids = self.by_length[length]
                at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                rows = np.flatnonzero(known[at] == hashed)
                if len(rows):
                    yield start, length, rows, ids[at[rows]]


def _forward(pieces: Pieces, codes: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Forward sums (position, word, language), scaled, with the log of the scale.

    All matches are returned too, for the backward pass.
    """
    m, n = codes.shape
    alpha = np.zeros((n + 1, m, p.shape[1]))
    alpha[0] = 1.0
    scale, found, done = np.zeros((m, 1)), [], 0
    matches = list(pieces.matches(codes))
    covered = np.zeros((n, m), dtype=bool)
    by_start: dict[int, list] = {}
    for start, length, rows, ids in matches:
        by_start.setdefault(start, []).append((length, rows, ids))
        if length == 1:
            covered[start, rows] = True
    for start in range(n):
        if start and start % 16 == 0:  # keep products of many small numbers in range
            top = alpha[start : start + pieces.longest].max(axis=(0, 2))
            alpha[start : start + pieces.longest] /= np.maximum(top, 1e-300)[None, :, None]
            scale[:, 0] += np.log(np.maximum(top, 1e-300))
        for length, rows, ids in by_start.get(start, ()):
            alpha[start + length, rows] += alpha[start, rows] * p[ids]
            found.append((start, length, rows, ids))
        bare = np.flatnonzero(~covered[start])
        alpha[start + 1, bare] += alpha[start, bare] * UNKNOWN
    return alpha, scale, found


def by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and code points of words, those of one length together."""
    places: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        places.setdefault(len(w), []).append(k)
    for at in places.values():
        most = max(1, min(4096, CELLS // (len(words[at[0]]) + 1)))
        for k in range(0, len(at), most):
            part = at[k : k + most]
            yield part, _codes([SPACE + words[j] for j in part])


def log_likelihood(pieces: Pieces, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Of each word under each language, all segmentations summed."""
    out = np.empty((len(words), p.shape[1]))
    for part, codes in by_length(words):
        alpha, scale, _ = _forward(pieces, codes, p)
        out[part] = np.log(np.maximum(alpha[-1], 1e-300)) + scale
    return out


def _expect_long(pieces: Pieces, codes: np.ndarray, p: np.ndarray, weight: np.ndarray, expected: np.ndarray) -> None:
    """Adds the expected piece counts of long words, by logarithms of the sums."""
    m, n = codes.shape
    logs = np.log(p)
    steps: dict[int, list] = {}
    covered = np.zeros((n, m), dtype=bool)
    for start, length, rows, ids in pieces.matches(codes):
        steps.setdefault(start, []).append((length, rows, ids))
        covered[start, rows] |= length == 1
    alpha, beta = np.full((n + 1, m, p.shape[1]), -np.inf), np.full((n + 1, m, p.shape[1]), -np.inf)
    alpha[0] = beta[n] = 0.0
    for start in range(n):
        for length, rows, ids in steps.get(start, ()):
            alpha[start + length, rows] = np.logaddexp(alpha[start + length, rows], alpha[start, rows] + logs[ids])
        bare = np.flatnonzero(~covered[start])
        alpha[start + 1, bare] = np.logaddexp(alpha[start + 1, bare], alpha[start, bare] + np.log(UNKNOWN))
    for start in reversed(range(n)):
        for length, rows, ids in steps.get(start, ()):
            beta[start, rows] = np.logaddexp(beta[start, rows], logs[ids] + beta[start + length, rows])
        bare = np.flatnonzero(~covered[start])
        beta[start, bare] = np.logaddexp(beta[start, bare], np.log(UNKNOWN) + beta[start + 1, bare])
        for length, rows, ids in steps.get(start, ()):
            got = np.exp(alpha[start, rows] + logs[ids] + beta[start + length, rows] - alpha[n, rows]) * weight[rows]
            for k in range(p.shape[1]):
                np.add.at(expected[:, k], ids, got[:, k])


def expected_counts(pieces: Pieces, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected counts of pieces (piece, language) in words that occur ``weight`` times (word, language)."""
    expected = np.zeros_like(p)
    for part, codes in by_length(words):
        if codes.shape[1] > LINEAR:
            _expect_long(pieces, codes, p, weight[part], expected)
            continue
        n = codes.shape[1]
        alpha, beta = np.zeros((n + 1, len(part), p.shape[1])), np.zeros((n + 1, len(part), p.shape[1]))
        alpha[0] = beta[n] = 1.0
        found = list(pieces.matches(codes))
        steps: dict[int, list] = {}
        covered = np.zeros((n, len(part)), dtype=bool)
        for start, length, rows, ids in found:
            steps.setdefault(start, []).append((length, rows, ids))
            covered[start, rows] |= length == 1
        for start in range(n):
            for length, rows, ids in steps.get(start, ()):
                alpha[start + length, rows] += alpha[start, rows] * p[ids]
            alpha[start + 1] += np.where(covered[start][:, None], 0.0, alpha[start] * UNKNOWN)
        for start in reversed(range(n)):
            for length, rows, ids in steps.get(start, ()):
                beta[start, rows] += p[ids] * beta[start + length, rows]
            beta[start] += np.where(covered[start][:, None], 0.0, UNKNOWN * beta[start + 1])
        share = weight[part] / np.maximum(alpha[n], 1e-300)
        for start, length, rows, ids in found:
            got = alpha[start, rows] * p[ids] * beta[start + length, rows] * share[rows]
            for k in range(p.shape[1]):
                expected[:, k] += np.bincount(ids, weights=got[:, k], minlength=pieces.size)
    return expected


def fit(pieces: Pieces, counts: list[tuple[str, str, int]], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities (piece, language), from word counts."""
    langs = sorted({lang for lang, _, _ in counts})
    words = sorted({w for _, w, _ in counts})
    at, col = {w: k for k, w in enumerate(words)}, {lang: k for k, lang in enumerate(langs)}
    weight = np.zeros((len(words), len(langs)))
    for lang, w, n in counts:
        weight[at[w], col[lang]] += n
    p = np.full((pieces.size, len(langs)), 1.0 / max(pieces.size, 1))
    for _ in range(rounds if words else 0):
        expected = SMOOTH + expected_counts(pieces, words, weight, p)
        p = expected / expected.sum(axis=0)
    return langs, p


def fit_whole(vocab: list[str], counts: DataFrame, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """:func:`fit` for ``lang, word, n`` of any size: each round is one pass of tasks over the words.

    The driver holds piece probabilities alone; a task sends its expected counts in
    blocks of pieces, which are added up block by block.
    """
    spark, size = counts.sparkSession, len(vocab)
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    words = stored(counts.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("in")), "words")
    tasks = max(1, -(-words.count() // WORDS))
    p, col = np.full((size, len(langs)), 1.0 / max(size, 1)), {lang: k for k, lang in enumerate(langs)}
    blocks = list(range(0, size, PIECES))
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast((vocab, p))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, p = shared.value  # noqa: B023
            pieces, total = Pieces(vocab), np.zeros_like(p)
            for batch in batches:
                weight = np.zeros((batch.num_rows, p.shape[1]))
                for k, found in enumerate(batch["in"].to_pylist()):
                    for x in found:
                        weight[k, col[x["lang"]]] += x["n"]
                total += expected_counts(pieces, batch["word"].to_pylist(), weight, p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array([total[b : b + PIECES].ravel() for b in blocks], pa.list_(pa.float64()))], names=["block", "x"]
            )

        def added(table: pa.Table) -> pa.Table:
            rows = np.sort(np.array(table["x"].to_pylist()), axis=0)  # the same sum in any order of tasks
            return pa.table({"block": table["block"].slice(0, 1), "x": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

        sent = words.repartition(tasks).mapInArrow(expect, "block long, x array<double>")
        summed = {r["block"]: r["x"] for r in sent.groupBy("block").applyInArrow(added, "block long, x array<double>").collect()}
        expected = SMOOTH + np.concatenate([np.array(summed[b]).reshape(-1, len(langs)) for b in blocks])
        p = expected / expected.sum(axis=0)
        shared.unpersist()
    return langs, p


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows that may be learned from: crc32 of the id, mod 4, is not 2."""
    return docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, lang, text``: ``sample`` labelled rows of each language at most, by a hash of the id."""
    slim = training_rows(docs.select("doc_id", "lang"))
    # a language may hold most rows: about twice the sample goes on to be ranked
    counts = stored(slim.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    place = F.xxhash64("doc_id")
    some = slim.join(F.broadcast(counts) if counts.count() <= SMALL else counts, "lang")
    some = some.filter(place / F.lit(2.0**64) + 0.5 <= F.lit(2.0 * sample + 100) / F.col("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(place, "doc_id"))
    chosen = some.withColumn("rank", rank).filter(F.col("rank") <= sample)
    chosen = stored(chosen.select("doc_id").distinct(), "sample")
    ids = F.broadcast(chosen) if chosen.count() <= SMALL else chosen
    return training_rows(docs.select("doc_id", "lang", "text")).join(ids, "doc_id", "left_semi")


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, word, n`` of ``lang, text``; a task sends a word once for each batch it occurs in."""
    ship_package(rows.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(
                (lang, w) for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True) for w in words(text)
            )
            langs, names = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "word", "n"]
            )

    counts = rows.select("lang", "text").mapInArrow(counted, "lang string, word string, n long")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = SAMPLE, file: str = VOCABULARY, rows: DataFrame | None = None) -> dict:
    """The model: vocabulary, languages, probabilities, from the word counts of the sample.

    ``rows`` is the sample if it is there already.
    """
    counts = word_counts(sample_rows(docs, sample) if rows is None else rows)
    vocab = vocabulary(file)
    langs, p = fit(Pieces(vocab), [tuple(r) for r in counts.collect()])
    return {"vocabulary": vocab, "langs": langs, "p": p}


def train_whole(docs: DataFrame, file: str = VOCABULARY) -> dict:
    """The model of :func:`train` from all labelled rows, fitted by Spark."""
    vocab = vocabulary(file)
    counts = stored(word_counts(training_rows(docs.select("doc_id", "lang", "text"))), "counts")
    langs, p = fit_whole(vocab, counts)
    return {"vocabulary": vocab, "langs": langs, "p": p}


def likelihood_floors(rows: DataFrame, model: dict) -> dict[str, float]:
    """For each language, the least log likelihood of a letter, on the mean of a text.

    It lies ``MARGIN`` below that of all but one in a hundred of ``rows``.
    """
    names = ("lang_pred", "score", "letter")
    return floors_of(stored(identify(rows.select("text"), model, names).select("lang_pred", "letter"), "letters"))


def floors_of(found: DataFrame) -> dict[str, float]:
    """:func:`likelihood_floors` of stored ``lang_pred, letter``, by exact percentiles."""
    ranked = lowest(found, "lang_pred", "letter", 0.01)
    return {lang: (1 - x % 1) * v[math.floor(x)] + x % 1 * v[math.ceil(x)] - MARGIN for lang, (_, x, v) in ranked.items()}


def identify(docs: DataFrame, model: dict, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with more columns: the language and its posterior.

    A third name gets the mean log likelihood of a letter in that language (null
    without one).
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in names}])
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs, p, pieces = m["langs"], m["p"], Pieces(m["vocabulary"])
        known: dict[str, int] = {}
        scores, held = np.empty((0, len(langs))), 0
        for batch in batches:
            preds: list[str] = []
            posts: list[float] = []
            letters: list[float | None] = []
            for low in range(0, batch.num_rows, BLOCK):
                texts = [words(t) for t in batch.column(at).slice(low, BLOCK).to_pylist()]
                if held > CACHE:
                    known, scores, held = {}, np.empty((0, len(langs))), 0
                if langs:
                    fresh = [w for w in set().union(*texts) if w not in known]
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    held += sum(map(len, fresh))
                    if fresh:
                        scores = np.concatenate([scores, log_likelihood(pieces, p, fresh)])
                for found in texts:
                    if not found or not langs:
                        preds.append("und")
                        posts.append(0.0)
                        letters.append(None)
                        continue
                    total = scores[np.fromiter(map(known.__getitem__, found), np.int64, len(found))].sum(axis=0)
                    best = int(total.argmax())
                    preds.append(langs[best])
                    posts.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
                    letters.append(float(total[best]) / sum(map(len, found)))
            added = [pa.array(preds, pa.string()), pa.array(posts, pa.float64()), pa.array(letters, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added[: len(names)]], names=[*batch.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=False)]])
    return docs.mapInArrow(predict, schema)


def op10_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
