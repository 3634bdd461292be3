"""Secrets in texts: three fixed patterns, and a character network over all other candidates.

A candidate is a run of value characters with a digit in it.  The network reads the
whole run and the characters around it: embedded characters, one convolution, the
largest and the mean response inside, the largest around, two dense layers.  Long runs
are read in windows whose responses are combined, so length changes nothing.  It is
written in numpy and trained here: labelled findings are what the patterns find in all
documents (and other candidates there), and findings made in common formats.  They stay
in Spark: an epoch is one pass in which each share of the rows, dealt out by a hash,
learns from the same weights, and the mean of what the shares have learned goes on.  A
held-out quarter calibrates the scores and sets the thresholds: the highest ones that
still find ``RECALL`` of the labelled findings.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh_name, lowest, ship_package, stored

# The patterns of the base findings and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "network")

#: A text without any of these, in lower case, has no assignment.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Runs that may hold a hex match or be a candidate.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEAST = 16

#: Made rows of either label for each ``MIX`` candidates of documents, and rows of a share, about.
MADE, MIX, SHARE = 1500, 2000, 4096
#: Share of labelled findings that the thresholds must find, and findings of an alphabet that get a threshold of their own.
RECALL, OWN_THRESHOLD = 0.98, 30

#: Characters of a window inside and on each side; sizes of the network.
INSIDE, AROUND, EMBED, WIDTH, FILTERS, HIDDEN = 64, 16, 8, 5, 24, 16
#: Windows scored at once.
CHUNK = 1024
EPOCHS, STEP, BATCH, SEED = 6, 0.01, 64, 11

FINDING = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType()),
]))


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the matches of the three patterns, in order."""
    found = []
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(k in lower for k in KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    for run in RUN.finditer(text):
        if run.end() - run.start() >= HEX_LEAST:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of ``LEAST`` value characters or more, without dots and dashes at their ends, that hold a digit."""
    out = []
    for run in RUN.finditer(text):
        a, b = run.span()
        while a < b and text[a] in ".-":
            a += 1
        while b > a and text[b - 1] in ".-":
            b -= 1
        if b - a >= LEAST and any("0" <= c <= "9" for c in text[a:b]):
            out.append((a, b))
    return out


def free_of(spans: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> list[bool]:
    """For ascending spans: no base finding overlaps them."""
    out, reach, k = [], -1, 0
    for a, b in spans:
        while k < len(found) and found[k][0] < b:
            reach = max(reach, found[k][2])
            k += 1
        out.append(reach <= a)
    return out


def char_ids(text: str) -> np.ndarray:
    """Printable ASCII from 2 on, other white space 97, all else 1; 0 is padding."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((codes >= 32) & (codes < 127), codes - 30, np.where((codes >= 9) & (codes <= 13), 97, 1)).astype(np.int64)


ALPHABET = 98


def alphabet(value: str) -> int:
    """0: digits, 1: lower hex, 2: letters and digits, 3: others."""
    return 0 if value.isdigit() else 1 if not value.strip("0123456789abcdef") else 2 if value.isalnum() else 3


def windows(text: str, a: int, b: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Characters, places of the span, those this window answers for, and those around the span."""
    size = INSIDE + 2 * AROUND
    for low in range(a, b, INSIDE):
        high = min(low + INSIDE, b)
        left, right = max(0, low - AROUND), min(len(text), high + AROUND)
        ids, at = np.zeros(size, np.int64), AROUND - (low - left)
        ids[at : at + right - left] = char_ids(text[left:right])
        places = np.arange(size) + low - AROUND
        yield ids, (places >= a) & (places < b), (places >= low) & (places < high), ((places >= left) & (places < a)) | ((places >= b) & (places < right))


def start_weights() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0] if len(shape) > 1 else 1), shape)
    features = 3 * FILTERS
    return {
        "embed": rng.normal(0, 0.5, (ALPHABET, EMBED)), "conv": draw(WIDTH * (EMBED + 1), FILTERS), "conv0": np.zeros(FILTERS),
        "dense": draw(features, HIDDEN), "dense0": np.zeros(HIDDEN), "out": draw(HIDDEN, 1), "out0": np.zeros(1),
    }


def unrolled(w: dict, ids: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The characters that each place's filters see, embedded, with a flag for those of the span."""
    seen = np.concatenate([w["embed"][ids], span[..., None].astype(float)], axis=2)
    seen[ids == 0] = 0
    padded = np.pad(seen, ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0)))
    return np.concatenate([padded[:, j : j + ids.shape[1]] for j in range(WIDTH)], axis=2)


def responses(w: dict, ids: np.ndarray, span: np.ndarray) -> np.ndarray:
    return np.maximum(unrolled(w, ids, span) @ w["conv"] + w["conv0"], 0)


def head(w: dict, features: np.ndarray) -> np.ndarray:
    """Logits."""
    return (np.maximum(features @ w["dense"] + w["dense0"], 0) @ w["out"] + w["out0"])[:, 0]


def logits(w: dict, items: list[tuple[str, int, int]]) -> np.ndarray:
    """Logits of spans of texts, read whole: windows of a span are combined by largest and sum."""
    n = len(items)
    most, sums, around, sizes = np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros(n)
    held: list[tuple] = []

    def flush() -> None:
        at = np.array([h[0] for h in held])
        ids, span, inside, outside = (np.stack([h[1][j] for h in held]) for j in range(4))
        r = responses(w, ids, span)
        np.maximum.at(most, at, (r * inside[..., None]).max(axis=1))
        np.maximum.at(around, at, (r * outside[..., None]).max(axis=1))
        np.add.at(sums, at, (r * inside[..., None]).sum(axis=1))
        np.add.at(sizes, at, inside.sum(axis=1))
        held.clear()

    for k, (text, a, b) in enumerate(items):
        for window in windows(text, a, b):
            held.append((k, window))
            if len(held) == CHUNK:
                flush()
    if held:
        flush()
    return head(w, np.concatenate([most, sums / np.maximum(sizes, 1)[:, None], around], axis=1))


def start_state() -> tuple[dict, dict, dict, int]:
    """Weights, their two moments, and steps done."""
    w = start_weights()
    return w, {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0


def epoch(state: tuple, parts: tuple[np.ndarray, ...], labels: np.ndarray, rng: np.random.Generator) -> tuple:
    """The state after one pass of Adam on the log loss over all rows."""
    w, m, v, t = dict(state[0]), dict(state[1]), dict(state[2]), state[3]
    for some in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
        t += 1
        for k, g in gradients(w, *(x[some] for x in parts), labels[some]).items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - STEP * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w, m, v, t


def first_windows(items: list[tuple[str, int, int]]) -> tuple[np.ndarray, ...]:
    """Of spans longer than a window the first one is learned from."""
    parts = [next(windows(*i)) for i in items]
    return tuple(np.stack([p[j] for p in parts]) for j in range(4))


def train_weights(items: list[tuple[str, int, int]], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Weights after all epochs over few rows."""
    parts, state, rng = first_windows(items), start_state(), np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        state = epoch(state, parts, labels, rng)
    return state[0]


def learned(rows: DataFrame) -> dict[str, np.ndarray]:
    """Weights after all epochs over ``text, start, end, label, place``, in shares of ``SHARE`` rows, about."""
    shares = max(1, -(-rows.count() // SHARE))
    rows = rows.withColumn("share", F.pmod(F.shiftrightunsigned("place", 2), F.lit(shares))).repartition(shares, "share")
    state = start_state()
    for k in range(EPOCHS):
        shared = rows.sparkSession.sparkContext.broadcast(state)

        def learn(table: pa.Table) -> pa.Table:
            table = table.sort_by([(c, "ascending") for c in ("place", "text", "start", "label")])
            items = list(zip(*(table[c].to_pylist() for c in ("text", "start", "end")), strict=True))
            share = table["share"][0].as_py()
            now = epoch(shared.value, first_windows(items), table["label"].to_numpy().astype(float), np.random.default_rng([SEED, k, share]))  # noqa: B023
            flat = np.concatenate([x.ravel() for part in now[:3] for x in part.values()])
            return pa.table({"n": [table.num_rows], "t": [now[3]], "x": pa.array([flat], pa.list_(pa.float64()))})

        sent = rows.groupBy("share").applyInArrow(learn, "n long, t long, x array<double>").select("n", "t", F.posexplode("x").alias("at", "x"))
        # sums in ascending order: the same in any order of tasks
        sums = F.aggregate(F.array_sort(F.collect_list(F.col("x") * F.col("n"))), F.lit(0.0), lambda a, b: a + b)
        mean = sent.groupBy("at").agg((sums / F.sum("n")).alias("x"), F.max("t").alias("t")).orderBy("at").collect()
        flat, low, parts = np.array([r["x"] for r in mean]), 0, []
        for part in state[:3]:
            parts.append({})
            for name, x in part.items():
                parts[-1][name] = flat[low : low + x.size].reshape(x.shape)
                low += x.size
        state = (*parts, mean[0]["t"])
        shared.unpersist()
    return state[0]


def gradients(w: dict, ids: np.ndarray, span: np.ndarray, inside: np.ndarray, outside: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss."""
    n, size = ids.shape
    seen = unrolled(w, ids, span)
    r = np.maximum(seen @ w["conv"] + w["conv0"], 0)
    own, other = r * inside[..., None], r * outside[..., None]
    count = np.maximum(inside.sum(axis=1), 1)[:, None]
    features = np.concatenate([own.max(axis=1), own.sum(axis=1) / count, other.max(axis=1)], axis=1)
    hidden = np.maximum(features @ w["dense"] + w["dense0"], 0)
    logit = hidden @ w["out"] + w["out0"]
    d_logit = (1 / (1 + np.exp(-logit)) - labels[:, None]) / n
    d_hidden = (d_logit @ w["out"].T) * (hidden > 0)
    d_features = d_hidden @ w["dense"].T
    d_r = np.zeros_like(r)
    rows, filters = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
    for part, place in ((own, d_features[:, :FILTERS]), (other, d_features[:, 2 * FILTERS :])):
        np.add.at(d_r, (rows, part.argmax(axis=1), filters), place)
    d_r += (d_features[:, FILTERS : 2 * FILTERS] / count)[:, None, :] * inside[..., None]
    d_r *= r > 0
    flat = d_r.reshape(-1, FILTERS)
    d_seen = (flat @ w["conv"].T).reshape(n, size, WIDTH, EMBED + 1)
    half = WIDTH // 2
    d_place = np.zeros((n, size + 2 * half, EMBED))
    for j in range(WIDTH):
        d_place[:, j : j + size] += d_seen[:, :, j, :EMBED]
    d_place, places = d_place[:, half : half + size].reshape(-1, EMBED), ids.ravel()
    d_embed = np.stack([np.bincount(places, weights=d_place[:, e], minlength=ALPHABET) for e in range(EMBED)], axis=1)
    d_embed[0] = 0
    return {
        "embed": d_embed, "conv": seen.reshape(-1, WIDTH * (EMBED + 1)).T @ flat, "conv0": flat.sum(axis=0),
        "dense": features.T @ d_hidden, "dense0": d_hidden.sum(axis=0), "out": hidden.T @ d_logit, "out0": d_logit.sum(axis=0),
    }


def made_findings(n: int, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """``text, start, end, label``: ``n`` findings of either label in common formats, between ordinary words.

    Findings are random values as keys, signed tokens and passwords look; the others are
    numbers, hosts, addresses, dates, versions, names of files and of variables.
    """
    rng = random.Random(seed)
    pick = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    lower, alnum = string.ascii_lowercase, string.ascii_letters + string.digits
    word = lambda: pick(lower, 3, 9)
    secret = [
        lambda: pick("0123456789abcdef", 32, 64), lambda: pick("0123456789ABCDEF", 32, 64), lambda: pick(alnum, 20, 64), lambda: pick(alnum + "+/", 24, 80) + "=", lambda: pick(alnum + "_-", 24, 48),
        lambda: rng.choice(("sk_live_", "ghp_", "xoxb-", "key-", "pk.")) + pick(alnum, 20, 40), lambda: ".".join(pick(alnum + "_-", 16, 40) for _ in range(3)), lambda: pick(string.ascii_uppercase + string.digits, 20, 40),
    ]
    other = [
        lambda: pick(string.digits, 16, 19), lambda: f"mail{rng.randint(0, 99)}.{word()}.example.com", lambda: f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T0{rng.randint(0, 9)}.{rng.randint(10, 59)}.00",
        lambda: f"/{word()}/{word()}/{word()}{rng.randint(0, 999)}.html", lambda: f"{word()}-{word()}-{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}.tar.gz", lambda: f"{word()}_{word()}_{word()}_{rng.randint(0, 99)}",
        lambda: f"{word()}{word().title()}{word().title()}{rng.randint(0, 9)}", lambda: word() * 3 + str(rng.randint(0, 99)), lambda: rng.choice(string.digits + "=-_") * rng.randint(16, 60) + "1", lambda: "-".join([word(), word(), word(), str(rng.randint(0, 9999))]),
    ]
    before = ["", "", "", 'token = "', "key: ", "Bearer ", "auth=", "\n", "<", "| ", "("]
    rows = []
    for k in range(2 * n):
        label = k % 2
        value = rng.choice(secret if label else other)()
        if not any(c.isdigit() for c in value):
            value += "7"
        start = f"{word()} {word()} {rng.choice(before)}"
        rows.append((f"{start}{value}{rng.choice(('', ' ', chr(34), '. '))}{word()} {word()}" if rng.random() < 0.9 else f"{start}{value}", len(start), len(start) + len(value), label))
    return rows


def made_rows(spark: SparkSession, sets: int) -> DataFrame:
    """``text, start, end, label, place`` of that many sets of made findings, each of its own seed."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed in batch["id"].to_pylist():
                columns = list(zip(*made_findings(made, SEED + seed), strict=True))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([seed] * len(columns[0]))], names=["text", "start", "end", "label", "seed"])

    made = MADE
    rows = spark.range(sets).mapInArrow(make, "text string, start int, end int, label int, seed long")
    return rows.withColumn("place", F.xxhash64("text", "start", "seed")).drop("seed")


def labelled(docs: DataFrame) -> DataFrame:
    """``text, start, end, label, place``: all candidates of all documents with their surroundings.

    A candidate that a pattern's match overlaps is a finding.  ``place`` is a hash of document and span.
    """
    ship_package(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, place in zip(batch["text"].to_pylist(), batch["place"].to_pylist(), strict=True):
                spans = candidates(text or "")
                for (a, b), free in zip(spans, free_of(spans, base_findings(text or "")), strict=True):
                    left, high = max(0, a - AROUND), min(b, a + INSIDE)
                    out.append((text[left : high + AROUND], a - left, high - left, int(not free), a, place))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            names = ["text", "start", "end", "label", "at", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    found = docs.select("text", F.xxhash64("doc_id", "text").alias("place"))
    found = found.mapInArrow(find, "text string, start int, end int, label int, at long, place long")
    return found.withColumn("place", F.xxhash64("place", "at")).drop("at")


def scored(rows: DataFrame, weights: dict) -> DataFrame:
    """``rows`` with their logits ``z`` and the value's ``alphabet``."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = list(zip(*(batch[c].to_pylist() for c in ("text", "start", "end")), strict=True))
            z, kinds = logits(shared.value, items) if items else [], [alphabet(t[a:b]) for t, a, b in items]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z, pa.float64()), pa.array(kinds, pa.int32())], names=[*batch.schema.names, "z", "alphabet"])

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField("z", T.DoubleType()), T.StructField("alphabet", T.IntegerType())]))


def newton(sums) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps with a small penalty.

    ``sums`` gives, for a slope and an offset, those of (p - label) x, p - label, and p (1 - p) times x x, x and 1.
    """
    at = np.array([1.0, 0.0])
    for _ in range(50):
        a, b, xx, x, one = sums(*at)
        step = np.linalg.solve(np.array([[xx, x], [x, one]]) + 0.01 * np.eye(2), np.array([a, b]) + 0.01 * (at - [1.0, 0.0]))
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def calibrated(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The logistic curve through held-out scores."""

    def sums(slope: float, offset: float) -> list[float]:
        p = 1 / (1 + np.exp(-np.clip(slope * scores + offset, -30, 30)))
        r, w = p - labels, p * (1 - p)
        return [float(x.sum()) for x in (r * scores, r, w * scores * scores, w * scores, w)]

    return newton(sums)


def calibrated_whole(held: DataFrame) -> tuple[float, float]:
    """:func:`calibrated` for a table of ``z, label``."""
    z, y = F.col("z"), F.col("label").cast("double")

    def sums(slope: float, offset: float) -> list[float]:
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(float(slope)) * z + F.lit(float(offset))))))
        terms = held.select(z.alias("z"), (p - y).alias("r"), (p * (1 - p)).alias("w"))
        return [x or 0.0 for x in terms.agg(*[F.sum(F.expr(e)) for e in ("r * z", "r", "w * z * z", "w * z", "w")]).first()]

    return newton(sums)


def train(docs: DataFrame | None, rows: list[tuple[str, int, int, int]] | None = None) -> dict:
    """Weights, calibration, and a threshold for each alphabet.

    ``rows`` are labelled findings, if there are better ones than those of the patterns
    in ``docs``.  A quarter is held out.
    """
    if rows is None:
        return train_whole(docs)
    every = rows + made_findings(MADE)
    random.Random(SEED).shuffle(every)
    items, labels = [r[:3] for r in every], np.array([r[3] for r in every], float)
    held = np.arange(len(every)) % 4 == 3
    w = train_weights([i for i, h in zip(items, held, strict=True) if not h], labels[~held])
    tested = [i for i, h in zip(items, held, strict=True) if h]
    slope, offset = calibrated(scores := logits(w, tested), labels[held])
    p = 1 / (1 + np.exp(-(slope * scores + offset)))
    kinds, hit = np.array([alphabet(t[a:b]) for t, a, b in tested]), labels[held] == 1
    least = lambda mask: float(np.quantile(p[mask & hit], 1 - RECALL, method="lower"))
    whole = least(np.ones(len(p), bool))
    thresholds = [least(kinds == k) if (hit & (kinds == k)).sum() >= OWN_THRESHOLD else whole for k in range(4)]
    return {"weights": w, "slope": slope, "offset": offset, "thresholds": thresholds}


def train_whole(docs: DataFrame) -> dict:
    """:func:`train` on the candidates of all documents and made ones.

    A candidate that no pattern matches may be a secret all the same: a first network,
    which has not seen those of the documents, takes the likely ones out, and the others
    are learned as no findings.
    """
    found = stored(labelled(docs), "candidates")
    # the mix of found and made rows stays the same in a larger corpus
    made = stored(made_rows(docs.sparkSession, max(1, -(-found.count() // MIX))), "made")
    open_ = found.filter("label = 0")
    if not open_.isEmpty():
        first = learned(found.filter("label = 1").unionByName(made))
        found = found.filter("label = 1").unionByName(scored(open_, first).filter("z < 0").drop("z", "alphabet"))
    every = stored(found.unionByName(made), "labelled")
    out = F.col("place").bitwiseAND(3) == 3
    w = learned(every.filter(~out))
    held = stored(scored(every.filter(out), w).select("z", "label", "alphabet"), "held")
    slope, offset = calibrated_whole(held)
    # the curve does not change the order of scores, but falls if its slope does
    hits = held.filter("label = 1").select("alphabet", (F.col("z") * F.lit(1.0 if slope >= 0 else -1.0)).alias("z"))
    own = lowest(hits, "alphabet", "z", 1 - RECALL)
    whole = lowest(hits.withColumn("alphabet", F.lit(-1)), "alphabet", "z", 1 - RECALL)
    least = lambda n, x, values: float(1 / (1 + np.exp(-np.clip(abs(slope) * values[int(x)] + offset, -700, 700))))
    thresholds = [least(*own[k]) if k in own and own[k][0] >= OWN_THRESHOLD else least(*whole[-1]) for k in range(4)]
    return {"weights": w, "slope": slope, "offset": offset, "thresholds": thresholds}


def probabilities(model: dict, items: list[tuple[str, int, int]]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model["slope"] * logits(model["weights"], items) + model["offset"], -700, 700)))


def scan(docs: DataFrame, model: dict, name: str = "findings") -> DataFrame:
    """``docs`` with the findings of each text: kind, start, end (code points), probability (null for patterns).

    They are in the order of start and kind.  A candidate that overlaps a pattern's match
    is no finding of its own.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    name, at = fresh_name(docs, name), docs.columns.index("text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            base, items, owner = [base_findings(t) for t in texts], [], []
            for k, text in enumerate(texts):
                spans = candidates(text)
                for (a, b), free in zip(spans, free_of(spans, base[k]), strict=True):
                    if free:
                        items.append((text, a, b))
                        owner.append(k)
            added: list[list] = [[] for _ in texts]
            for k, (text, a, b), p in zip(owner, items, probabilities(m, items) if items else (), strict=True):
                if p >= m["thresholds"][alphabet(text[a:b])]:
                    added[k].append((a, 3, b, float(p)))
            rows = [
                [{"kind": KINDS[f[1]], "start": f[0], "end": f[2], "probability": f[3] if len(f) > 3 else None} for f in sorted([*found, *more])]
                for found, more in zip(base, added, strict=True)
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(find, T.StructType([*docs.schema.fields, T.StructField(name, FINDING)]))


def joined(findings: Column) -> Column:
    """``kind:start:end`` of findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op12_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents.

    A null or empty text has none; very long texts and runs are read whole; repeated rows
    and rows without id are scanned like others; ties in start follow the order of kinds;
    an empty table gives no rows (the network then learns from made findings); other
    columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scan(docs, train(docs)).drop("text")
    base = F.filter("findings", lambda f: f["kind"] != "network")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"),
    )
