"""Substring search by an index of trigrams.

The index has a row for each distinct trigram of each lower-case field: ``gram, field,
id``, range-partitioned and sorted by gram, so a search reads the row groups of its grams
alone, and a gram that most texts have spans many files.  A keyword's candidates are the
fields that hold its rarest grams; only they are compared with the keyword itself.
Keywords shorter than a gram look for grams that hold them; texts shorter than a gram are
one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources.work import scratch_dir

SIZE = 3
#: Grams of a keyword whose postings are intersected: the rarest ones.
RAREST = 4


@dataclass
class KeywordIndex:
    postings: DataFrame
    counts: DataFrame
    fields: list[str]


def grams(text: Column) -> Column:
    """Distinct trigrams (code points) of the lower-case text; a shorter one is its own, none of an empty one."""
    lower = F.lower(text)
    return F.when(F.length(lower) >= SIZE, F.array_distinct(F.regexp_extract_all(lower, F.lit(r"(?s)(?=(...))"), F.lit(1)))).otherwise(F.array_remove(F.array(lower), ""))


def build(df: DataFrame, fields: list[str], path: str | None = None) -> KeywordIndex:
    """Writes the index of ``fields`` of ``df`` (``id`` and the fields) below ``path`` and opens it.

    Null fields have no grams; rows with one id are one row that holds the fields of all.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark, "keywords")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = F.array(*[F.struct(F.lit(i).cast("byte").alias("field"), F.coalesce(grams(F.col(f)), F.array()).alias("grams")) for i, f in enumerate(fields)])
    rows = df.select("id", F.inline(each)).select("id", "field", F.explode("grams").alias("gram"))
    rows.repartitionByRange(n, "gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(n, "gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return opened(spark, fields, path)


def opened(spark: SparkSession, fields: list[str], path: str) -> KeywordIndex:
    return KeywordIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts"), fields)


def _plan(index: KeywordIndex, keywords: list[str]) -> tuple[list[tuple[str, list[str]]], list[str]]:
    """For each keyword of a gram's length or more its rarest grams; and the shorter keywords."""
    long = [k for k in keywords if len(k) >= SIZE]
    of = {k: list(dict.fromkeys(k[i : i + SIZE] for i in range(len(k) - SIZE + 1))) for k in long}
    asked = sorted({g for gs in of.values() for g in gs})
    known = {r["gram"]: r["n"] for r in index.counts.filter(F.col("gram").isin(asked)).collect()} if asked else {}  # a row for each gram asked
    return [(k, sorted(gs, key=lambda g: known.get(g, 0))[:RAREST]) for k, gs in of.items() if all(g in known for g in gs)], [k for k in keywords if 0 < len(k) < SIZE]


def candidates(index: KeywordIndex, keywords: list[str]) -> DataFrame:
    """``id`` of rows, each once, in which a field holds the rarest grams of a keyword."""
    long, short = _plan(index, keywords)
    found = index.postings.filter(F.lit(False)).select("id")
    if long:
        pairs = index.postings.sparkSession.createDataFrame([(k, g, len(gs)) for k, gs in long for g in gs], "keyword string, gram string, needed int")
        read = index.postings.filter(F.col("gram").isin(sorted({g for _, gs in long for g in gs})))
        hits = read.join(F.broadcast(pairs), "gram").groupBy("id", "field", "keyword").agg(F.count_distinct("gram").alias("n"), F.first("needed").alias("needed"))
        found = found.unionByName(hits.filter("n = needed").select("id"))
    for k in short:
        found = found.unionByName(index.postings.filter(F.col("gram").contains(k)).select("id"))
    return found.distinct()


def search(index: KeywordIndex, df: DataFrame, keywords: list[str]) -> DataFrame:
    """Rows of ``df`` in which a field holds a keyword, in any case: what a scan finds, read by candidates.

    Keywords are plain text; empty ones find nothing.
    """
    keywords = list(dict.fromkeys(k.lower() for k in keywords if k))
    near = df.join(candidates(index, keywords), "id", "left_semi")
    hit = F.lit(False)
    for k in keywords:
        for f in index.fields:
            hit = hit | F.coalesce(F.lower(F.col(f)).contains(k), F.lit(False))
    return near.filter(hit)
