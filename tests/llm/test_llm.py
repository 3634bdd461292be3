"""Operators on training data: contracts, brute force, and the odd tables."""

import functools
import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import html as wrappers
from parlance.llm import jaccard, langid, packing, pieces, quality, sharding, syncmers, urls, warc
from parlance.llm.shared import scratch_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{k % 97}x{k % 89}" for k in range(30000))
#: id, text, lang: nulls, empty and long texts, copies, ties, one id twice, an id that is null
ODD = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t", None), (4, "one", "en"), (5, "One", "fr"), (6, "one two", "en"), (7, LONG, "en"), (8, LONG, None),
    (9, "the cat sat on the mat and the dog sat on the log today", "en"), (10, "the cat sat on the mat and the dog sat on the log today", "en"),
    (None, "no id here at all my friend", "en"), (None, None, None), (12, "same id first text with a few words", "de"), (12, "same id second text with other words", "de"),
    (13, "é漢 😀 <|endoftext|> \x00 x", "es"), (14, "a b c d e f g h i j", "fr"), (14, "a b c d e f g h i j", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    # clashing names: columns that operators use inside or return
    return df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit(1), "slot": F.lit("x"), "quality__": F.lit(0), "quality__w": F.lit(7), "Quality__P": F.lit(8), "language_pred": F.lit(9), "node": F.lit(3)}).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def plain_anchors(text):
    """Hash to first place of each closed syncmer, with Spark's hash."""
    import xxhash

    tokens = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    if not tokens:
        return {}
    chained = lambda parts: functools.reduce(lambda seed, x: xxhash.xxh64_intdigest(x, seed), parts, 42)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    mers = [chained([a.encode(), b.encode()]) for a, b in zip(tokens, tokens[1:])]
    inner, out = syncmers.K - syncmers.S + 1, {}
    for i in range(len(tokens) - syncmers.K + 1):
        inside = [signed(x) for x in mers[i : i + inner]]
        if min(inside) in (inside[0], inside[-1]):
            hashed = chained([mers[i + k].to_bytes(8, "little") for k in range(0, syncmers.K, syncmers.S)]) >> 25
            out.setdefault(hashed, i)
    return out or {chained([t.encode() for t in tokens]) >> 25: 0}


def plain_likeness(a, b):
    return 1.0 if not a and not b else len(a.keys() & b.keys()) / len(a.keys() | b.keys())


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_syncmers(request, which):
    """Fingerprints, likeness and the edited texts against plain Python."""
    df = request.getfixturevalue(which).filter("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    rows = df.collect()
    got = {r.doc_id: r for r in syncmers.fingerprint_with_edits(df).collect()}
    assert len(got) == len(rows)
    anchors = {r.doc_id: plain_anchors(r.text) for r in rows}
    ids = sorted(anchors, reverse=True)
    text = {r.doc_id: r.text or "" for r in rows}
    for k, i in enumerate(ids):
        after, n, r = ids[(k + 1) % len(ids)], len(text[i]), got[i]
        edited = text[i][: n - n // 2] + text[after][: n // 2]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for name, want in ((r.fingerprint, anchors[i]), (r.edited_fingerprint, plain_anchors(edited))):
            found = [int(name[j : j + 16], 16) for j in range(0, len(name), 16)]
            assert {x >> 24: x & (2**24 - 1) for x in found} == want and len(found) == len(want)
        assert r.near_next == pytest.approx(plain_likeness(anchors[i], anchors[after]))
        assert r.near_edited == pytest.approx(plain_likeness(anchors[i], plain_anchors(edited)))


def test_next_documents(spark, monkeypatch):
    """Uneven ids, a hot id, nulls: every row meets its next one, and no range holds most rows."""
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 4)
    rng = random.Random(2)
    ids = [10**15, -(2**63), 2**63 - 1, *range(300), *[rng.randrange(10**9) for _ in range(100)], *[77] * 150, *[None] * 120]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    want = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    got = {r.text: r.next.text for r in syncmers.with_next(df, ["text"]).collect()}
    assert got == want
    sizes = syncmers.id_ranges(df.withColumn("key", F.xxhash64("text")), F.col("key")).groupBy("bucket", "part").count().collect()
    assert max(r["count"] for r in sizes) < 40


def test_syncmer_rule(spark):
    """Anchors against the definition, with Spark's hashes of token pairs."""
    words = [random.Random(5).choice("abcdefgh") + str(k % 13) for k in range(60)]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    got = syncmers.with_anchors(df, "text", "a").first().a
    pairs = spark.createDataFrame(list(zip(words, words[1:])), "a string, b string").select(F.xxhash64("a", "b")).collect()
    mers = [r[0] for r in pairs]
    inner = syncmers.K - syncmers.S + 1
    places = [i for i in range(len(words) - syncmers.K + 1) if min(mers[i], mers[i + inner - 1]) == min(mers[i : i + inner])]
    seen = {tuple(words[i : i + syncmers.K]) for i in places}
    assert len(got) == len(seen) and {x & (2**24 - 1) for x in got} <= set(places)
    # an edit behind a k-mer does not change it
    other = spark.createDataFrame([(" ".join(words[:40] + ["zzz"] * 5),)], "text string")
    again = syncmers.with_anchors(other, "text", "a").first().a
    same = 40 - syncmers.K
    assert {x for x in got if x & (2**24 - 1) <= same} == {x for x in again if x & (2**24 - 1) <= same}


def test_syncmers_odd(odd, empty):
    got = syncmers.fingerprint_with_edits(odd).collect()
    assert len(got) == len(ODD) and all(r.near_edited is not None for r in got)
    assert syncmers.fingerprint_with_edits(empty).count() == 0
    one = syncmers.fingerprint_with_edits(odd.filter("doc_id = 9")).collect()
    assert one[0].near_next == 1.0


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, cov = Counter(win), set()
    for i, k in enumerate(win):
        if c[k] > 1:
            cov.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_counts(request, which):
    df = request.getfixturevalue(which)
    c = F.col("quality__")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = quality.with_counts(df.select("doc_id", "text")).select("text", *[c[n].alias(n) for n in names]).collect()
    assert all(tuple(r)[1:] == counts(r.text) for r in rows)


def test_quality_keeps_clean(spark, sf_dir, docs):
    got = {r.doc_id: r for r in quality.op2_quality_cascade(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    clean = [got[r.doc_id] for r in labels if r.quality == 1]
    junk = [got[r.doc_id] for r in labels if r.quality == 0]
    assert all(r.kept for r in clean if not r.base_failed) and sum(r.kept for r in junk) <= 0.1 * len(junk)


def test_quality_order_and_columns(odd, empty):
    order = quality.cascade_order(odd)
    assert {n for n, _, _ in order} == set(quality.RULES) and [n for n, _, _ in quality.cascade_order(empty)] == list(quality.RULES)
    kept = quality.kept_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {9, 10}
    assert {(r["quality__"], r["quality__w"], r["Quality__P"]) for r in kept.collect()} == {(0, 7, 8)} and quality.kept_documents(empty).count() == 0


def test_quality_rates_are_conditional(spark):
    """A rule that rejects what another one rejected already comes last, however much it rejects."""
    body = " ".join(f"word{k}" for k in range(40))
    signs, cries = (" ".join(x.format(j) for j in range(30)) + " " for x in ("#s{0}", "x{0}!!"))
    rows = [((signs if k % 2 else "") + body + " " + (cries if k % 5 == 0 else ""),) for k in range(100)]
    df = spark.createDataFrame(rows, "text string")
    many = lambda text, c: 5 * c["n_symbols"] > c["n_words"]
    rules = {"many": many, "same": many, "shouting": quality.RULES["shouting"]}
    order = quality.cascade_order(df, rules)
    rates = [r for n, _, r in order if n != "shouting"]
    assert rates[1] == 0 and 0.3 <= rates[0] <= 0.7 and all(0.05 <= r <= 0.25 for n, _, r in order if n == "shouting")
    lists = spark.createDataFrame([("\n".join(f"- item{k} number{k} of{k} it{k}" for k in range(12)),), ("\n".join(f"line number {k} ends ..." for k in range(12)),), (body,)], "text string")
    c = F.col("quality__")
    failed = [r.f for r in quality.with_counts(lists).select(quality.failed_rule(F.col("text"), c, list(quality.RULES)).alias("f")).collect()]
    assert failed == ["bullets", "ellipses", None]


def test_pieces_whole_document(spark):
    """In chunks or not, the ids are those of one scan over the whole text."""
    rng = random.Random(3)
    texts = [t for _, t, _ in ODD[:7]] + ["a" * 300, "internationalization" * 20, "  two  blanks   ", "\n\n x \n", "ab" * 41, "x▁y ▁ z" * 9]
    texts += ["".join(rng.choice("ab é漢 theonrig\n") for _ in range(rng.randint(1, 300))) for _ in range(20)]
    texts += ["".join(rng.choice("theonrigas") for _ in range(rng.randint(30, 300))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = pieces.coder()

    def scan(m):
        start, cuts, j = c.best(m)[1], [], len(m)
        while j > 0:
            cuts.append(m[start[j] : j])
            j = start[j]
        return [i for x in reversed(cuts) for i in ([c.ids[x]] if x in c.ids else [c.bytes[b] for b in x.encode()])]

    for chunk in (40, 17, pieces.CHUNK):
        rows = pieces.decode_ids(pieces.encode_documents(df, chunk=chunk)).collect()
        by, back = defaultdict(list), defaultdict(str)
        for r in sorted(rows, key=lambda r: r.chunk):
            by[r.doc_id] += r.ids
            back[r.doc_id] += r.text
            assert zlib.crc32(r.text.encode()) == r.text_crc32
        assert set(by) == set(range(len(texts)))
        for i, t in enumerate(texts):
            m = pieces.MARK + t.replace(" ", pieces.MARK) if t else ""
            assert back[i] == (t or "").replace(pieces.MARK, " ")
            if len(m) < 5000:
                assert by[i] == scan(m), (chunk, t)


def test_pieces_are_the_best():
    """Against all segmentations of short words."""
    c = pieces.coder()

    def every(t):
        if not t:
            return [0.0]
        out = [c.scores[t[:k]] + s for k in range(1, len(t) + 1) if t[:k] in c.scores for s in every(t[k:])]
        return out + ([] if t[0] in c.scores else [c.bare + s for s in every(t[1:])])

    for w in ("▁hello", "▁nation", "▁the", "▁été", "▁a漢b", "ization", "▁x▁y"):
        assert c.best(w)[0][-1] == max(every(w))


def test_pieces_odd(odd, empty):
    rows = pieces.decode_ids(pieces.encode_documents(odd)).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in rows if r.chunks == 1) == Counter((i, zlib.crc32((t or "").encode())) for i, t, _ in ODD if t != LONG)
    assert pieces.decode_ids(pieces.encode_documents(empty)).count() == 0


def test_pieces_forget(monkeypatch):
    """Little room for words changes no ids."""
    texts = ["▁" + "▁".join(f"w{k % 50}x{j}" for k in range(40)) for j in range(6)]
    ids, counts = pieces.Coder().encode(texts)
    monkeypatch.setattr(pieces, "CACHE", 100)
    c, small = pieces.Coder(), []
    for t in texts:
        small += c.encode([t])[0].tolist()
    assert small == ids.tolist() and counts.sum() == len(small)


def test_shards(odd, empty, docs):
    for df, shards in ((docs, 40), (odd, 5)):
        got = sharding.shard_documents(df, shards).collect()
        assert len(got) == df.count()
        places = defaultdict(list)
        for r in got:
            places[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in places.values()) and set(places) <= set(range(shards))
        want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    sizes = Counter()
    for r in sharding.shard_documents(docs, 10).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 10
    assert sharding.shard_documents(empty).count() == 0


def test_the_deal(docs):
    """Shards and places against a plain replay of the deal."""
    rows = sharding.shard_documents(docs, 7).collect()
    weight = Counter({k: 0 for k in range(sharding.SLOTS)})
    for r in rows:
        weight[r.vslot] += r.size
    loads, shard = [0] * 7, {}
    for k in sorted(weight, key=lambda k: (-weight[k], k)):
        shard[k] = loads.index(min(loads))
        loads[shard[k]] += weight[k]
    assert all(r.shard == shard[r.vslot] for r in rows)
    for s in range(7):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: (r.vslot, r.doc_id, r.text_crc32, r.size))
        assert [r.slot for r in own] == list(range(len(own)))


def test_rebalancing(spark):
    weights = spark.createDataFrame([(k, 100 + k % 7) for k in range(256)], "vslot int, bytes long")
    path = scratch_dir(spark, "map")
    sharding.store_map(sharding.first_map(weights, 8), path)
    sharding.store_map(sharding.rebalanced_map(sharding.load_map(spark, path), weights, 9), path)
    old = {r.vslot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    new = {r.vslot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert set(old) == set(new) == set(range(256)) and set(new.values()) == set(range(9))
    assert sum(old[k] != new[k] for k in old) < 256 / 4


def brute_components(rows, n, percent):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            w = WORD.findall((t or "").translate(ASCII_LOWER))
            sets[i].append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, v in sets.items() for s in v if s]
    for a, (i, s) in enumerate(flat):
        for j, t in flat[:a]:
            if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_texts():
    rng = random.Random(9)
    rows, k = [], 0
    for size in (5, 12, 30, 80, 200, 700):
        base = [f"t{rng.randrange(500)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 9, 15):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(size)] = f"e{rng.randrange(99)}"
            rows.append((k, " ".join(w)))
            k += 1
    return rows


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, odd, docs, n, percent):
    for df in (spark.createDataFrame(near_texts(), "doc_id long, text string"), odd, docs):
        got = jaccard.jaccard_components(df, n, percent).collect()
        want = brute_components([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], n, percent)
        assert len(got) == df.count()
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_tiles(spark, monkeypatch):
    """Groups and blocks over the tile size give the same classes, with few rows broadcast or many."""
    from parlance.llm import components, shared

    rng = random.Random(4)
    base = [f"w{j}" for j in range(60)]
    rows = [(k, " ".join(base + [f"x{k}"])) for k in range(20)] + near_texts()[9:14]
    for k in range(100, 112):  # a chain: neighbours are linked, few are linked to the first
        base[rng.randrange(60)] = f"y{k}"
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").dropDuplicates(["doc_id"]).cache()
    want = brute_components([tuple(r) for r in df.collect()], 3, 90)
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "SET_TILE", 3)
    for tokens, small in ((4_000_000, 500_000), (100, 0)):
        monkeypatch.setattr(jaccard, "TOKENS", tokens)
        monkeypatch.setattr(components, "SMALL", small)
        monkeypatch.setattr(components, "HUB", 3)
        monkeypatch.setattr(shared, "SMALL", small)
        monkeypatch.setattr(shared, "HOT", 3)
        assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == want


def test_members_of_groups_are_made_once(spark, monkeypatch):
    """Groups of several tiles, whose rows are dealt out in rounds, do not repeat what makes their members."""
    monkeypatch.setattr(jaccard, "TILE", 4)
    rng = random.Random(6)
    base = [f"w{j}" for j in range(60)]
    rows = [(k, " ".join([*base, f"x{k}"])) for k in range(20)] + [(k, " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))) for k in range(20, 36)]
    named = jaccard.base_rows(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("doc_id", "node")
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    members = spark.createDataFrame([(7, k, 0) for k in range(36)], "key long, node long, tokens long").mapInArrow(counted, "key long, node long, tokens long")
    edges = jaccard.links_within(members, named, 4, lambda t, b: jaccard._by_sketch(t, b, 90)).collect()
    linked = {x for e in edges for x in (e.u, e.v)}
    assert linked == set(range(20)) and made.value == 36


def test_jaccard_tolerant_segments(spark, monkeypatch):
    """Many documents make segments tolerant; links stay the same."""
    monkeypatch.setattr(jaccard, "BAND_SHARE", 1e9)
    jaccard.allocation.cache_clear()
    assert jaccard.allocation(9, 50, 1000)[1] > 0
    df = spark.createDataFrame(near_texts(), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    jaccard.allocation.cache_clear()
    assert got == brute_components(near_texts(), 3, 90)


def test_one_of_each(odd, empty):
    kept = jaccard.one_of_each(odd)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert kept.columns == odd.columns and ids == [1, 2, 3, 4, 6, 7, 9, 12, 12, 13, 14] and {r.node for r in kept.collect()} == {3} and kept.filter("doc_id is null").count() == 2
    assert jaccard.one_of_each(empty).count() == 0


def test_one_of_each_with_repeated_ids(spark):
    """Rows of one id are told apart by their texts, also where those have copies elsewhere."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (3, b), (8, a), (9, c), (None, a), (6, a + " end"), (7, None), (7, None)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert Counter(map(tuple, kept)) == Counter([(5, a), (3, b), (9, c), (None, a), (7, None)])


PAGES = [
    (5, "u", "x" * 200), (5, "u", "x" * 200), (9, None, "x" * 200), (11, "a\r\nb", None), (None, "q", "x" * 200),
    (12, "q", "WARC/1.1\r\n\r\n\r\n" * 20), (13, "q", "WARC/1.1\r\n\r\n\r\n" * 20), (14, "s", "é" * 49), (15, "s", "é" * 49), (16, "s", ""),
]


def test_record_parser(monkeypatch):
    """Records that hold what looks like records, read in parts of any size."""
    import io

    rng = random.Random(1)
    bodies = [bytes(rng.choice(b"ab\r\nWARC/1.\r\n\r\n") for _ in range(rng.randrange(60))) for _ in range(40)]
    data = b"".join(b"WARC/1.1\r\nX: %d\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (k, len(b), b) for k, b in enumerate(bodies))
    for size in (1, 3, 50, 1 << 18):
        monkeypatch.setattr(warc, "READ", size)
        assert [(int(h["X"]), b) for h, b in warc.parse_records(io.BytesIO(data))] == list(enumerate(bodies))


def test_warc_classes_and_hot_digests(spark, monkeypatch):
    """Records of all sizes, one file for a large one, and lookups without a broadcast of all."""
    import gzip
    import io
    import os

    from parlance.llm import shared

    monkeypatch.setattr(warc, "CLASSES", (100, 300, 1000))
    monkeypatch.setattr(warc, "FILE_BYTES", 900)
    monkeypatch.setattr(shared, "SMALL", 1)
    monkeypatch.setattr(shared, "HOT", 5)
    rows = [(k, "u", "ab" * (20 * (k % 5 + 1) ** 2) + ("x" * 900 if k == 7 else "")) for k in range(60)] + [(100 + k, None, "same" * 100) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    raw, out = scratch_dir(spark, "raw"), scratch_dir(spark, "out")
    warc.write_archive(df, raw)
    warc.deduplicate(spark, raw, out)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.resolved(warc.read_archive(spark, out)).collect()}
    first = {}
    for i, _, t in rows:
        first.setdefault(t, i)
    assert got == {i: ("revisit", first[t]) if len(t) >= 100 and first[t] != i else ("response", None) for i, _, t in rows}
    sizes, infos = [], 0
    for name in os.listdir(raw):
        if name.endswith(".gz") and not name.startswith("."):
            with open(f"{raw}/{name}", "rb") as f:
                found = [h for h, _ in warc.parse_records(io.BytesIO(gzip.decompress(f.read())))]
            infos += sum(h["WARC-Type"] == "warcinfo" for h in found)
            sizes.append([int(h["X-Payload-Length"]) for h in found if h["WARC-Type"] != "warcinfo"])
    assert infos == 1 and all(sum(x) <= 900 or len(x) == 1 for x in sizes) and sum(map(len, sizes)) == 80


def test_warc(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record_id", F.lit(1))
    for rows in (df, df.limit(0)):
        raw, out = scratch_dir(spark, "raw"), scratch_dir(spark, "out")
        warc.write_archive(rows, raw)
        warc.deduplicate(spark, raw, out)
        got = [tuple(r) for r in warc.resolved(warc.read_archive(spark, out)).collect()]
        want, seen = [], {}
        for r in sorted(rows.collect(), key=lambda r: (r.page_id is None, r.page_id or 0)):
            b = (r.html or "").encode()
            d = hashlib.sha256(b).hexdigest()
            if len(b) >= 100 and d in seen:
                want.append((r.page_id, len(b), d, "revisit", seen[d]))
            else:
                seen.setdefault(d, r.page_id)
                want.append((r.page_id, len(b), d, "response", None))
        assert Counter(got) == Counter(want)
        back = Counter((r.page_id, r.payload) for r in warc.read_archive(spark, raw, payloads=True).collect())
        assert back == Counter((r.page_id, r.html or "") for r in rows.collect())


def test_main_text(spark):
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><header>Top</header><div class='cookie-notice'>We use</div><nav><a href=x>Menu</a></nav>"
        "<main><article><header><h1>T &amp; x</h1></header><p>a  b<br>c</p><ul><li>one<li>two</ul><div class='comments'><p>nice!</p></div><form>f</form>"
        "<script>if(a<b){}</script></article></main><aside>side</aside><div class=ad>buy</div><footer>foot</footer></body></html>"
    )
    rows = [(1, "https://h.test/1", page), (2, "https://h.test/2", page.replace("one", "other")), (2, "https://h.test/2", page), (3, None, None), (4, "x", ""), (5, "y", "plain <b>te</b>xt"), (None, "z", "<p>a<p>b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("no")).withColumn("host", F.lit("no"))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in wrappers.extract(df).collect())
    main = "T & x\na b c\none\ntwo"
    assert got == sorted((i, t, len(t)) for i, t in [(1, main), (2, main.replace("one", "other")), (2, main), (3, ""), (4, ""), (5, "plain text"), (0, "a\nb")])
    assert wrappers.extract(df.limit(0)).count() == 0


def test_main_text_of_mixed_templates(spark):
    one = "<article><h1>head {0}</h1><p>text {0}</p></article><div>beside {0}</div>"
    two = "<div class=content><h1>title {0}</h1><p>body {0}</p></div>"
    for url in ("https://h.test/{0}", None):
        rows = [(k, url and url.format(k), (one if k % 3 else two).format(k)) for k in range(9)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
        assert got == {k: (f"head {k}\ntext {k}" if k % 3 else f"title {k}\nbody {k}") for k in range(9)}


def test_main_text_under_names(spark):
    def texts_of(form, n=4):
        rows = [(k, f"https://h.test/{k}", form.format(k)) for k in range(n)]
        return [r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).sort("page_id").collect()]

    side = "<div class='sidebar'>side {0}</div><div id=cookie-notice>We use {0}</div><div class='x site-footer'>foot {0}</div>"
    kept = [f"head {k}\ntext {k}" for k in range(4)]
    for name in ("content has-sidebar", "no-sidebar", "nav-open", "share-enabled", "hidden-print", "layout with-sidebar"):
        assert texts_of(f"<div class='{name}'><h1>head {{0}}</h1><p>text {{0}}</p></div>" + side) == kept, name
    for name in ("entry promo", "nav", "widget-area"):
        assert texts_of(f"<div class='{name}'><article><h1>head {{0}}</h1><p>text {{0}}</p></article></div>" + side) == kept, name
    long = "words of a page " * 12
    body = f"<div class='promo'><h1>head {{0}}</h1><div class='sidebar'>side {{0}}</div><p>{long}{{0}}</p></div>"
    assert texts_of(body + side) == [f"head {k}\n{long}{k}" for k in range(4)]
    comments = f"<div class=comments><article><p>{long}{{0}}</p></article></div>"
    assert texts_of("<div><h1>head {0}</h1><p>text {0}</p></div>" + comments) == kept


def test_main_text_of_copies_and_link_slots(spark):
    copies = "<h1>head</h1><div class=body><p>the only text</p></div>"
    menu = "".join(f"<a href=/{k}>a long menu item</a> " for k in range(20))
    links = f"<div>{menu}</div><div>text {{0}}</div>"
    foot = "<p>text {0}</p><h6>the same everywhere</h6>"
    rows = [(k, f"https://{h}.test/{k}", form.format(k)) for k in range(5) for h, form in (("a", copies), ("b", links), ("c", foot))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.url[8], r.page_id): r.text for r in wrappers.extract(df).collect()}
    assert got == {(h, k): t for k in range(5) for h, t in (("a", "head\nthe only text"), ("b", f"text {k}"), ("c", f"text {k}"))}


def test_wrapper_alignment():
    a = wrappers.shape("<div><h1>x</h1><p>a</p></div>")
    b = wrappers.shape("<div><p>a</p><p>b</p><ul><li>q</li></ul></div>")
    assert wrappers.expression(wrappers.align(a, b)) == "<div>(<h1>#TEXT</>)?(<p>#TEXT</>)+(<ul><li>#TEXT</></>)?</>"


def token_stream(page):
    out = []
    for node, *_ in wrappers.texts(page, (), lambda _, label: (out.append(f"<{label}>"), ())[1], lambda *_: out.append("</>")):
        if node is not None:
            out.append("#")
    return "".join(out)


def as_pattern(w):
    inner = "".join(("(?:" if c[5] == 1 else "") + as_pattern(c) + (")+" if c[5] == 2 else "") for c in w[4])
    body = "#" if w[0] == "#" else f"<{re.escape(w[0])}>{inner}</>" if w[0] else inner
    return f"(?:{body})" + ("*" if w[1] and w[2] else "+" if w[1] else "?" if w[2] else "")


def random_template(rng, depth=0):
    """A function that writes pages of one template with optional and repeated groups."""
    parts = []
    for _ in range(rng.randint(1, 4)):
        inner = random_template(rng, depth + 1) if depth < 2 and rng.random() < 0.5 else lambda r: "x"
        parts.append((rng.choice(["div", "section", "h2", "h3", "div class=a", "div class=b", "blockquote"]), rng.choice(["one", "optional", "repeated", "pairs"]), inner))

    def write(r):
        out = ""
        for tag, kind, inner in parts:
            for _ in range({"one": 1, "optional": r.randrange(2), "repeated": r.randint(1, 4), "pairs": r.randint(1, 3)}[kind]):
                out += f"<{tag}>{inner(r)}</{tag.split()[0]}>" + ("<p>y</p>" if kind == "pairs" else "")
        return out

    return write


def test_wrappers_accept_their_pages():
    """The wrapper as a regular expression matches every page that it was made of, in any order of folding."""
    for seed in range(300):
        rng = random.Random(seed)
        write = random_template(rng)
        pages = [write(rng) for _ in range(5)]
        shapes = [wrappers.shape(p) for p in pages]
        one = shapes[0]
        for other in shapes[1:]:
            one = wrappers.align(one, other)
        two = wrappers.align(wrappers.align(shapes[4], shapes[2]), wrappers.align(shapes[3], wrappers.align(shapes[1], shapes[0])))
        for w in (one, two):
            assert all(re.fullmatch(as_pattern(w), token_stream(p)) for p in pages), (seed, wrappers.expression(w))


def extracted(pages):
    w = wrappers.shape(pages[0])
    for p in pages[1:]:
        w = wrappers.align(w, wrappers.shape(p))
    follower = wrappers.Follower(wrappers.judged(w))
    return [wrappers.main_text(p, follower) for p in pages]


def test_repeated_and_optional_groups_decide():
    """Pages with other numbers of a group find the same slots; a page's place in the group matters."""
    page = "<h1>t {0}</h1>" + "{1}" + "<h2>more</h2><p>always this</p>"
    pairs = lambda k: "".join(f"<h2>head {k}{j}</h2><p>body {k}{j}</p>" for j in range(k))
    pages = [page.format(k, "<div>never changes</div>" * (k % 2) + pairs(k)) for k in range(1, 8)]
    w = wrappers.shape(pages[0])
    for p in pages[1:]:
        w = wrappers.align(w, wrappers.shape(p))
    assert wrappers.expression(w) == "<h1>#TEXT</>(<div>#TEXT</>)?(<h2>#TEXT</><p>#TEXT</>)+"
    menu = "<ul>" + "<li><a href=x>go</a>" * 4 + "</ul>"
    lone = [f"<h1><a href=/{k}>title {k}</a></h1>{menu}<p>text {k}</p>" for k in range(5)]
    assert extracted(lone) == [f"title {k}\ntext {k}" for k in range(5)]
    once = [f"<h2>h {k}</h2><p>p {k}</p><blockquote><p>the same</p></blockquote>" for k in range(5)]
    assert extracted(once) == [f"h {k}\np {k}" for k in range(5)]


def test_text_is_not_lost():
    for page, text in (
        ("<p>one</p><button>go<p>two</p><p>three</p>", "one\ngo\ntwo\nthree"), ("<p>a</p><svg><p>b", "a\nb"), ("a<br>b<wbr>c", "a bc"),
        ("<p>x <math>y</math> <noscript>z</noscript></p>", "x y\nz"), ("<nav>menu<p>text", "menu\ntext"), ("<p>a<textarea>b", "a"), ("<p>a<button>b</button>c</p>", "a\nc"),
        ("</div></p><p>a</b></p>", "a"), ("<object>o</object><select><option>s</select>", "o"),
        ("<article><p>x</p><div class=alert>w</div><div class=legal-history>l</div><p class=related-work>r</p><div class=ad>buy</div></article>", "x\nw\nl\nr"),
    ):
        assert extracted([page]) == [text], page
    notice = [f"<article><p>x {k}</p><div class=alert>the same alert</div></article>" for k in range(4)]
    assert extracted(notice) == [f"x {k}" for k in range(4)]


def test_deep_and_wide_pages():
    for page in ("<div>" * 100_000 + "x", "<div><p>x" * 30_000, "<div><b><p>x</p></i></b></div></div>" * 20_000):
        assert extracted([page])[0].split() == ["x"] * page.count("x")
    wide = ["".join(f"<div class=c{chr(97 + (k * 7 + j) % 26)}{chr(97 + j % 26)}x>t{k}{j}</div><p>u</p>" for j in range(300)) for k in range(4)]
    w = wrappers.shape(wide[0])
    for p in wide[1:]:
        w = wrappers.align(w, wrappers.shape(p))
    assert len(w[4]) <= wrappers.WIDE
    assert [t.count("t") for t in extracted(wide)] == [300] * 4


def test_extraction_of_the_pages(spark, sf_dir):
    import html as entities

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r.text for r in wrappers.op7_host_wrappers(spark, sf_dir).collect()}
    for r in rows:
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


URLS = [
    (1, "https://A.Example.com/en/7?x"), (2, "https://a.example.com/en/6"), (3, "http://x.net/de/1"), (4, "http://b.example.net/de/81#q"), (5, "http://q.org/es/"),
    (6, None), (7, "no scheme"), (8, "https://badcom/en/"), (9, "https://com/en/"), (9, "https://com/en/"), (None, "http://h.org?p/es/"), (10, "a://b://c/d"),
]


def test_urls(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("no"))
    labels = spark.createDataFrame([(k, k % 2 == 0) for k in range(12)], "page_id long, bad boolean")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judge_urls(df, labels).collect()}
    assert got[(1, "a.example.com", "/en/7")] == ("example.com/en/7", "allow") and got[(2, "a.example.com", "/en/6")] == ("com/en/", "block")
    assert got[(3, "x.net", "/de/1")] == ("net/de/", "allow") and got[(4, "b.example.net", "/de/81")] == ("example.net/de/8", "block")
    assert got[(5, "q.org", "/es/")] == ("org/es/", "block") and got[(8, "badcom", "/en/")][0] is None and got[(9, "com", "/en/")] == ("com/en/", "block")
    assert (6, "", "") in got and (7, "", "") in got and (None, "h.org", "") in got and (10, "b:", "//c/d") in got
    assert urls.judge_urls(df, labels).count() == len(URLS) and urls.judge_urls(df.limit(0), labels).count() == 0


def test_reputation_shrinks(spark):
    rows = [("good.test.com", k < 2) for k in range(60)] + [("bad.test.com", k >= 2) for k in range(60)] + [("once.test.com", True)]
    df = spark.createDataFrame(rows, "host string, bad boolean")
    hosts = df.select("host").distinct().union(spark.createDataFrame([("new.test.com",)], "host string"))
    got = {r.host: r for r in urls.host_reputation(df, hosts).collect()}
    base = 61 / 121
    assert got["bad.test.com"].above >= urls.SURE > 0.05 > got["good.test.com"].above and got["once.test.com"].above < urls.SURE
    assert got["good.test.com"].mean < got["new.test.com"].mean < got["bad.test.com"].mean and got["good.test.com"].mean < base < got["bad.test.com"].mean


def test_beta_distribution():
    """Against sums over a fine grid."""
    import numpy as np

    for a, b, x in ((2.5, 7.0, 0.3), (40.0, 60.0, 0.5), (1.0, 1.0, 0.25), (300.0, 900.0, 0.27), (5.0, 2.0, 0.9)):
        grid = (np.arange(200_000) + 0.5) / 200_000
        weight = np.exp((a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid) - (a - 1) * np.log(a / (a + b)) - (b - 1) * np.log(b / (a + b)))
        assert urls.beta_below(np.array([a]), np.array([b]), x)[0] == pytest.approx(weight[grid < x].sum() / weight.sum(), abs=1e-4)


def test_hosts_are_blocked(spark):
    """The whole filter against plain Python on hosts that differ, and against its SQL."""
    import duckdb
    import numpy as np

    from parlance.llm import oracles

    rng = random.Random(8)
    share = {f"h{k}.{d}.{s}": q for k in range(6) for d, q in (("fine", 0.05), ("spam", 0.7), ("mixed", 0.1 + 0.15 * k)) for s in ("com", "net", "co.uk")}
    urls_of = [(k, f"https://{h}/p/{k}") for k, h in enumerate(h for h in share for _ in range(40))] + [(10**6, "https://new.spam.com/x"), (10**6 + 1, None)]
    outcome = [(k, int(rng.random() >= share[u.split("/")[2]]), 0) for k, u in urls_of[:-2] if rng.random() < 0.8]
    pages = spark.createDataFrame(urls_of, "page_id long, url string")
    labels = spark.createDataFrame(outcome, "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.judge_urls(pages, urls.page_outcomes(labels)).collect()}

    host = {k: u.split("/")[2] if u else "" for k, u in urls_of}
    domain = {h: ".".join(h.split(".")[1:]) if h not in ("", "new.spam.com") else h[4:] for h in host.values()}
    suffix = {d: ".".join(d.split(".")[1:]) for d in domain.values()}
    tally = {h: [0, 0] for h in domain}
    for k, ok, _ in outcome:
        tally[host[k]][0] += 1
        tally[host[k]][1] += 1 - ok

    def summed(of, level):
        out = defaultdict(lambda: [0, 0])
        for key, (n, bad) in level.items():
            out[of[key]][0] += n
            out[of[key]][1] += bad
        return out

    domains = summed(domain, tally)
    suffixes = summed(suffix, domains)

    def strength(level):
        v = np.array([x for x in level.values() if x[0]], float)
        n, bad = v[:, 0], v[:, 1]
        m = bad.sum() / n.sum()
        scale = m * (1 - m) * ((n.sum() - (n**2).sum() / n.sum()) - (len(n) - 1))
        rho = ((n * (bad / n - m) ** 2).sum() - m * (1 - m) * (len(n) - 1)) / scale if scale > 0 else urls.RHO[1]
        return m, 1 / min(max(rho, urls.RHO[0]), urls.RHO[1]) - 1

    m, k0 = strength(suffixes)
    k1, k2 = strength(domains)[1], strength(tally)[1]
    base = sum(1 - ok for _, ok, _ in outcome) / len(outcome)
    blocked = {}
    for h, (n, bad) in tally.items():
        d, s = domains[domain[h]], suffixes[suffix[domain[h]]]
        prior = (d[1] + k1 * (s[1] + k0 * m) / (s[0] + k0)) / (d[0] + k1)
        mean = (bad + k2 * prior) / (n + k2)
        draws = np.random.default_rng(1).beta(mean * (n + k2), (1 - mean) * (n + k2), 200_000)
        blocked[h] = (draws > urls.LIFT * base).mean()
    for k, h in host.items():
        if abs(blocked[h] - urls.SURE) > 0.01:
            assert got[k].verdict == ("block" if blocked[h] >= urls.SURE else "allow"), (h, blocked[h])
    assert {got[k].verdict for k in host if ".spam." in host[k] and k < 10**6} == {"block"} and {got[k].verdict for k in host if ".fine." in host[k]} == {"allow"}

    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", labels.toPandas())
    assert {r[0]: r[4] for r in con.execute(oracles.HOSTS).fetchall()} == {k: r.verdict for k, r in got.items()}


def plain_best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return len(rooms)


def test_packing_plan():
    rng = random.Random(1)
    for size in (10, 50, 2048):
        for _ in range(30):
            h = {rng.randint(1, size): rng.randint(1, 30) for _ in range(rng.randint(1, 25))}
            runs = packing.plan(h, size)
            used, ranks = defaultdict(list), defaultdict(list)
            for n, rank, k, first, offset in runs:
                for j in range(k):
                    used[first + j].append((offset, n))
                    ranks[n].append(rank + j)
            assert all(sorted(ranks[n]) == list(range(c)) for n, c in h.items())
            for v in used.values():
                v.sort()
                assert all(o == sum(n for _, n in v[:j]) for j, (o, _) in enumerate(v)) and sum(n for _, n in v) <= size
            assert len(used) == plain_best_fit([n for n, c in h.items() for _ in range(c)], size)


def test_packing_in_parts(docs, monkeypatch):
    """Lengths ranked in many parts take the same number of sequences."""
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    got = packing.pack_documents(docs.select("doc_id", F.substring("text", 1, 40).alias("text"))).collect()
    assert len(got) == docs.count() and len({r.sequence_id for r in got}) == plain_best_fit([r.length for r in got], 2048)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(v)[:j]) for v in places.values() for j, (o, _) in enumerate(sorted(v)))


def test_packing(odd, empty, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder()("x <|endoftext|> y") == t.encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    import numpy as np

    for df in (docs, odd):
        got = packing.pack_documents(df).collect()
        want = Counter()
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
            n = len(ids)
            cuts = [0, n] if n <= 2048 else sorted({0, *range(n, 0, -2048)})
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        seqs = defaultdict(list)
        for r in got:
            seqs[r.sequence_id].append((r.offset, r.length))
        for v in seqs.values():
            v.sort()
            assert all(o == sum(n for _, n in v[:j]) for j, (o, _) in enumerate(v)) and sum(n for _, n in v) <= 2048
        assert len(seqs) == plain_best_fit([r.length for r in got], 2048)
    assert packing.pack_documents(empty).count() == 0


def test_forward_sums_all_segmentations():
    import numpy as np

    vocab = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "abb"]
    p = np.array([[0.05, 0.2], [0.1, 0.1], [0.2, 0.05], [0.2, 0.1], [0.15, 0.15], [0.1, 0.2], [0.1, 0.1], [0.1, 0.1]])

    def every(word, k):
        if not word:
            return 1.0
        total = sum(p[j, k] * every(word[len(v) :], k) for j, v in enumerate(vocab) if word.startswith(v))
        return total + (langid.UNKNOWN * every(word[1:], k) if word[0] not in vocab else 0)

    words = ["ab", "abba", "xa", "aabbab", "a" * 40]
    got = langid.log_likelihood(langid.Pieces(vocab), p, words)
    for w, row in zip(words[:4], got):
        assert np.allclose(np.exp(row), [every("▁" + w, 0), every("▁" + w, 1)])
    assert np.isfinite(got).all()


def test_languages(spark, sf_dir, odd, empty, docs):
    got = {r.doc_id: r for r in langid.op10_marginal_unigrams(spark, sf_dir).collect()}
    rows = docs.collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    model = langid.train(docs)
    out = langid.identify(odd, model, ("p__", "s__"))
    assert out.columns == [*odd.columns, "p__", "s__"]
    for r in out.collect():
        has = any(unicodedata.category(x)[0] == "L" for x in r.text or "")
        assert (r["p__"] in model["langs"]) == has and (r["p__"] == "und") == (not has) and 0 <= r["s__"] <= 1
    assert langid.identify(empty, model).count() == 0
    untaught = langid.train(empty)
    found = langid.identify(odd, untaught)
    assert {r.lang_pred for r in found.collect()} == {"und"} and sorted(found.columns) == sorted([*odd.columns, "lang_pred"])
    marks = spark.createDataFrame([("\u00b2 \u00bd \u2460 \u2167 7 _",), ("x\u00b2y \u2167",)], "text string")
    assert [r.lang_pred == "und" for r in langid.identify(marks, model).collect()] == [True, False]
    assert langid.words("x\u00b2Y \u2167 \u00e9a_b1c") == ["x", "y", "\u00e9a", "b", "c"]


def test_fitting_counts_all_segmentations(monkeypatch):
    """One round of expectation maximisation against sums over enumerated segmentations."""
    import numpy as np

    vocab = ["\u2581", "\u2581a", "a", "b", "ab", "ba", "\u2581ab", "abb"]
    counts = [("x", "abba", 3), ("x", "ab", 2), ("y", "bab", 1), ("y", "aqb", 2), ("x", "abbaabab", 1)]

    def ways(word):
        if not word:
            yield ()
        for k, v in enumerate(vocab):
            if word.startswith(v):
                yield from ((k, *rest) for rest in ways(word[len(v) :]))
        if word and word[0] not in vocab:
            yield from ((None, *rest) for rest in ways(word[1:]))

    want = np.full((len(vocab), 2), langid.SMOOTH)
    share = lambda way: np.prod([langid.UNKNOWN if k is None else 1 / len(vocab) for k in way])
    for lang, word, n in counts:
        every = list(ways("\u2581" + word))
        total = sum(map(share, every))
        for way in every:
            for k in way:
                if k is not None:
                    want[k, "xy".index(lang)] += n * share(way) / total
    for linear in (64, 0):  # sums as they are, and as logarithms
        monkeypatch.setattr(langid, "LINEAR", linear)
        langs, p = langid.fit(langid.Pieces(vocab), counts, 1)
        assert langs == ["x", "y"] and np.allclose(p, want / want.sum(axis=0))
    langs, p = langid.fit(langid.Pieces(vocab), [("x", "ab" * 400, 1)], 2)
    assert np.isfinite(p).all() and p[vocab.index("ab"), 0] > p[vocab.index("abb"), 0]


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as c

    got = c.run(spark, sf_dir).collect()
    rows = langid.sample_rows(docs)
    model = langid.train(docs)
    floors = langid.likelihood_floors(rows, model)
    known = langid.identify(docs.select("doc_id", "text"), model, ("pred", "score", "letter")).collect()
    ids = {r.doc_id for r in known if r.pred != "und" and r.score >= c.LEAST_SCORE and r.letter >= floors[r.pred]}
    assert {r.doc_id for r in c.language(spark, docs, sf_dir).collect()} == ids and len(ids) > 0.9 * len(known)
    ok = {r.doc_id for r in quality.op2_quality_cascade(spark, sf_dir).filter("kept").collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in ids and r.doc_id in ok]
    near = brute_components(left, c.SHINGLE_WORDS, c.SIMILAR_PERCENT)
    assert {r.doc_id for r in got} == {i for i, root in near.items() if i == root}
    assert [n for n, _ in c.STAGES] == ["language", "quality", "near_copies", "packing"]


def test_language_stage_learns_from_all_rows(spark, monkeypatch):
    """Probabilities and floors are those of all labelled rows, not of some hundred of a language."""
    import corpus_pipeline as c
    import numpy as np

    rng = random.Random(12)
    lexicon = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(300)] for lang, letters in (("x", "aeinrst"), ("y", "oulmdkgé"))}
    lexicon["y"].append("u" * 70)
    rows = [(k, "xxy"[k % 3], " ".join(rng.choice(lexicon["xxy"[k % 3]]) for _ in range(rng.randint(3, 12)))) for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    taught = [(lang, t) for k, lang, t in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    counts = Counter((lang, w) for lang, t in taught for w in langid.words(t))
    vocab = langid.vocabulary()
    langs, p = langid.fit(langid.Pieces(vocab), [(*key, n) for key, n in counts.items()])
    monkeypatch.setattr(langid, "WORDS", 100)
    model = langid.train_whole(df)
    assert model["langs"] == langs and np.allclose(model["p"], p, rtol=1e-9)
    monkeypatch.setattr(langid, "MARGIN", 1e-9)
    known = langid.identify(df, model, ("pred", "score", "letter")).collect()
    floors = {lang: np.percentile([r.letter for r in known if r.pred == lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2], 1) - 1e-9 for lang in langs}
    want = {r.doc_id for r in known if r.score >= c.LEAST_SCORE and r.letter >= floors[r.pred]}
    assert len(want) < 1200 and {r.doc_id for r in c.language(spark, df, "").collect()} == want


def test_language_stage_rejects_gibberish(spark, docs):
    """Texts of letters in no learned language go; clean ones of the learned languages stay."""
    import corpus_pipeline as c

    rng = random.Random(4)
    strange = [" ".join("".join(rng.choice("qxzjkvw") for _ in range(7)) for _ in range(60)), "漢字仮名交じり文の例です " * 20, "?!? 123"]
    added = spark.createDataFrame([(10**9 + k, t, None, "s", len(t)) for k, t in enumerate(strange)], docs.schema)
    kept = {r.doc_id for r in c.language(spark, docs.unionByName(added), "").collect()}
    assert not kept & {10**9 + k for k in range(3)} and len(kept) >= 0.97 * docs.filter("length(text) > 40").count()


def test_pipeline_odd(spark, odd, empty):
    import corpus_pipeline as c

    for df in (odd, empty):
        for _, stage in c.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns
            df = out.cache()
        c.STAGES[-1][1](spark, df, "").count()


def test_oracles(spark, sf_dir):
    from harness import connect, difference

    from parlance.llm import queries

    con = connect(sf_dir)
    for name, sql in queries.oracle_sql().items():
        assert difference(queries.queries()[name](spark, sf_dir), con, sql) == "", name
