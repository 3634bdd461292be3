"""Document fingerprints from closed syncmers.

A text is cut into tokens (runs of non-blanks, at most 16 characters each, so a
text without blanks has tokens too).  A k-mer is ``K`` consecutive tokens; it is
an anchor if the smallest hash among its inner ``S``-mers is the first or the
last of them.  The rule looks at the k-mer alone, so an edit elsewhere never
changes which k-mers are anchors.  An anchor is kept as one long: the upper 39
bits are its hash, the lower 24 bits its token position (positions from 2^24 on
count as the last one).  A fingerprint is all anchors, each hash at its first place, in
the order of their hashes, as hexadecimal digits, 16 for an anchor; two of seven
k-mers are anchors on the mean, so it is a little shorter than the text.

Likeness is the Jaccard index of the anchors' hashes.  :func:`aligned` compares positions: the share of the
common anchors that stand at the same place in both texts.

Defined cases: null is the empty text, whose fingerprint is empty; two empty
fingerprints are alike (1.0), an empty and another one are not (0.0); a text of
fewer than ``K`` tokens, or none of whose k-mers is an anchor, has one anchor, all its
tokens; equal texts have equal fingerprints.  The next document is taken in the order of descending ``doc_id``
(nulls last), then the text's hash; repeated rows follow one another.  A single
document is its own next one.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

K = 8
S = 2
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
POSITION_BITS = 24
#: Documents that share a range of ids, on the mean.
RANGE_ROWS = 1024
#: Quantiles of the ids at most, and how many of them are looked through at a time.
BUCKETS, STEP = 4096, 64
#: Ranges up to which their table (about 100 bytes each) is broadcast.
SMALL = 500_000


def _anchor(hashed: Column, position: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(hashed, POSITION_BITS + 1), POSITION_BITS)
    return high.bitwiseOR(F.least(position, F.lit(2**POSITION_BITS - 1)).cast("long"))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the sorted anchors (array of long) of the column ``text``."""
    t, m = f"{out}__t", f"{out}__m"
    step = df.withColumn(t, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)))
    tokens, mers = F.col(t), F.col(m)
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    step = step.withColumn(
        m, F.zip_with(F.slice(tokens, 1, pairs), F.slice(tokens, 2, pairs), lambda a, b: F.xxhash64(a, b))
    )
    inner = K - S + 1
    # the least of each run of `inner` S-mers, by runs that grow; a slice for each place would copy all of them
    least, have = m, 1
    while have < inner:
        more = min(have, inner - have)
        rest = F.greatest(F.size(least) - more, F.lit(0))
        runs = F.zip_with(F.slice(least, 1, rest), F.slice(least, 1 + more, rest), lambda x, y: F.least(x, y))
        have += more
        least = f"{out}__{have}"
        step = step.withColumn(least, runs)
    low = F.col(least)
    places = F.filter(
        F.sequence(F.lit(1), F.size(tokens) - (K - 1)),
        # named twice, so that the optimizer does not put the runs into the lambda
        lambda i: (F.get(mers, i - 1) == F.get(low, i - 1)) | (F.get(mers, i + (inner - 2)) == F.get(low, i - 1)),
    )
    # S-mers side by side cover the k-mer, so their hashes name it
    named = F.transform(places, lambda i: _anchor(F.xxhash64(*[F.get(mers, i - 1 + k) for k in range(0, K, S)]), i - 1))
    whole = F.array(_anchor(F.xxhash64(tokens), F.lit(0)))
    anchors = F.when(F.size(tokens) >= K, named).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn(out, F.array_sort(anchors))
    step = step.withColumn(out, F.when((F.size(out) == 0) & (F.size(tokens) > 0), whole).otherwise(F.col(out)))
    step = step.select(*df.columns, out)
    # of equal hashes the first place stays
    a = F.col(out)
    first = F.filter(
        a, lambda x, i: (i == 0) | (F.shiftright(x, POSITION_BITS) != F.shiftright(F.get(a, i - 1), POSITION_BITS))
    )
    return step.withColumn(out, first)


def hashes(anchors: Column) -> Column:
    return F.transform(anchors, lambda x: F.shiftright(x, POSITION_BITS))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two columns of distinct hashes."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def aligned(a: Column, b: Column) -> Column:
    """Share of the common anchors at the same place; null without common ones.

    ``a`` and ``b`` are columns of anchors.
    """
    common = F.size(F.array_intersect(hashes(a), hashes(b)))
    return F.when(common > 0, F.size(F.array_intersect(a, b)) / common)


def as_text(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _numbers(values: list) -> Column:
    """A constant array of long, as one string in the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def id_ranges(docs: DataFrame, key: Column) -> DataFrame:
    """Adds ``bucket, part``: ranges of about ``RANGE_ROWS`` rows in the order of descending ``doc_id``.

    Quantiles of all ids bound the buckets, so no spread of ids puts more than a
    share of one in ``BUCKETS`` into one; a bucket is cut into parts of equal width.
    An id that fills buckets alone and the nulls (the last bucket) are cut by ``key``,
    the hash by which they are ordered.
    """
    n, nulls, low, high = docs.agg(
        F.count("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1)), F.min("doc_id"), F.max("doc_id")
    ).first()
    buckets = max(1, min(BUCKETS, n // RANGE_ROWS))
    shares = [k / buckets for k in range(1, buckets)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * BUCKETS)).first()[0] or [] if shares else []
    times = Counter(found)
    bounds = sorted(times, reverse=True)
    hot = sorted((v for v, k in times.items() if k > 1), reverse=True)
    # bounds above the id, first by every STEP-th of them
    doc_id = F.col("doc_id")
    steps = [bounds[k : k + STEP] for k in range(0, len(bounds), STEP)]
    above = lambda values: F.size(F.filter(values, lambda x: x > doc_id))
    lines = F.split(F.lit(";".join(",".join(map(str, x)) for x in steps)), ";")
    coarse = above(_numbers([x[-1] for x in steps]))
    docs = docs.withColumn("bucket", coarse)
    within = F.split(F.get(lines, F.col("bucket")), ",").cast("array<bigint>")
    finer = F.greatest(F.coalesce(above(within), F.lit(0)), F.lit(0))  # none behind the last line
    docs = docs.withColumn("bucket", F.least(F.col("bucket") * STEP + finer, F.lit(len(bounds))) if bounds else F.lit(0))
    upper, lower = _numbers([high or 0, *bounds]), _numbers([*bounds, low or 0])
    top, bottom = F.get(upper, F.col("bucket")).cast("double"), F.get(lower, F.col("bucket")).cast("double")
    parts = n // (max(len(bounds), 1) * RANGE_ROWS) + 1
    wide = F.floor((top - doc_id) * parts / (top - bottom + 1))
    by_key = lambda rows: F.floor((key / F.lit(2.0**64) + 0.5) * (rows // RANGE_ROWS + 1))
    most = max((times[v] for v in hot), default=0) * (n // buckets)
    alone = F.array_contains(_numbers(hot), doc_id) if hot else F.lit(False)
    return docs.withColumn(
        "part", F.when(doc_id.isNull(), by_key(nulls)).when(alone, by_key(most)).otherwise(wide).cast("long")
    ).withColumn("bucket", F.when(doc_id.isNull(), 2 * len(bounds) + 2).otherwise(2 * F.col("bucket") + alone.cast("int")))


def with_next(docs: DataFrame, columns: list[str], made: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds ``next``, a struct of ``columns`` of the next document.

    A range of ids is one window; the first document of each range is also sent to the
    range before it, where it serves as the last one's next and is then dropped.  Which
    range is before another is told within a bucket, and between buckets by a table
    of at most two rows for each.  ``made`` adds columns behind the shuffle, so they are
    not moved.
    """
    own, place = docs.columns, ["bucket", "part"]
    key = F.xxhash64("text")
    ranged = id_ranges(docs.withColumn("key", key), F.col("key"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id").alias("down"), F.col("key").alias("key"))
    # a row for each range
    heads = stored(ranged.groupBy(*place).agg(F.min(order).alias("head")), "ranges")
    n = heads.count()
    ends = heads.groupBy("bucket").agg(F.max("part").alias("final"))
    ends = ends.select("bucket", F.struct(F.lag("bucket").over(W.orderBy("bucket")).alias("bucket"), F.lag("final").over(W.orderBy("bucket")).alias("part")).alias("behind"))
    final = heads.agg(F.max(F.struct(*place)).alias("final"))
    step = W.partitionBy("bucket").orderBy("part")
    heads = heads.join(F.broadcast(ends), "bucket").join(F.broadcast(final)).select(
        *place, "head",
        F.when(F.lag("part").over(step).isNotNull(), F.struct("bucket", F.lag("part").over(step).alias("part")))
        .when(F.col("behind.bucket").isNotNull(), F.col("behind")).otherwise(F.col("final")).alias("before"),
    )
    placed = ranged.join(F.broadcast(heads) if n <= SMALL else heads, place, "left")
    here = F.struct(*place, F.lit(False).alias("ghost"))
    there = F.struct("before.bucket", "before.part", F.lit(True).alias("ghost"))
    copies = placed.withColumn("at", F.explode(F.when(order == F.col("head"), F.array(here, there)).otherwise(F.array(here))))
    copies = copies.select(*own, "key", "at.bucket", "at.part", "at.ghost").repartition(*place)
    rank = [F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.col("key")]
    copies = made(copies.sortWithinPartitions(*place, *rank))
    following = W.partitionBy(*place).orderBy(*rank)
    return copies.withColumn("next", F.lead(F.struct(*columns)).over(following)).filter(~F.col("ghost")).drop("key", "ghost", *place)


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its text edited with the next document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(own, ["text", "anchors"], lambda df: with_anchors(df, "text", "anchors"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = paired.withColumn(
        "edited", F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.col("next.text"), half))
    )
    edited = with_anchors(edited, "edited", "edited_anchors")
    named = edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "anchors", "edited_anchors",
        hashes(F.col("anchors")).alias("a"),
        hashes(F.col("edited_anchors")).alias("b"),
        hashes(F.col("next.anchors")).alias("c"),
    )
    return named.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
        aligned(F.col("anchors"), F.col("edited_anchors")).alias("aligned_edited"),
    )


def op1_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts."""
    return fingerprint_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
