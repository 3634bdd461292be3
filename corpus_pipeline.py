"""The corpus pipeline: language, quality, near copies, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, and ``run`` writes each result as Parquet and reads it again
as the next stage's documents.  All stages but the last keep the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.jaccard import one_of_each
from parlance.llm.langid import floors_of, identify, train_whole, training_rows
from parlance.llm.packing import pack_documents
from parlance.llm.quality import kept_documents
from parlance.llm.shared import fresh_name, scratch_dir, stored

#: Word shingles and similarity from which documents are near copies.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Posterior below which a document's language counts as unknown.
LEAST_SCORE = 0.5

#: No SQL: languages, shingle joins and token ids are beyond it; a test compares
#: ``run`` with a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, without a likely language, or whose letters are unlikely in it.

    Languages and likelihoods are learned from all labelled rows that may be learned from.
    A null or empty text goes; a very long one is read whole; repeated rows and ties are
    judged one by one; a null ``doc_id`` is a value like others (only, nothing is learned
    from it); an empty table gives no rows; columns stay as they are, whatever their names.
    """
    names = tuple(fresh_name(docs, f"language_{n}") for n in ("pred", "score", "letter"))
    pred, score, letter = map(F.col, names)
    model = train_whole(docs)
    found = stored(identify(docs, model, names), "identified")
    floors = floors_of(training_rows(found).select(pred.alias("lang_pred"), letter.alias("letter")))
    likely = F.lit(True)
    if floors:
        least = F.create_map(*map(F.lit, chain.from_iterable(floors.items())))
        likely = F.coalesce(letter >= F.try_element_at(least, pred), F.lit(True))
    return found.filter((pred != "und") & (score >= LEAST_SCORE) & likely).drop(*names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail a quality rule.

    A null or empty text has no words and goes; a very long one is read whole; repeated
    rows and null ids are judged like others; an empty table gives no rows; columns stay
    as they are, whatever their names.
    """
    return kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    A null or empty text is like no other and stays; so do rows without an id.  Different
    texts with one id are documents of their own; of rows with equal id and text one
    stays.  Very long texts are compared whole; an empty table gives no rows; columns stay
    as they are, whatever their names.
    """
    return one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 2048.

    A null or empty text is the id 0 alone; a very long one is cut into pieces; repeated
    rows are packed one by one, ties in the order of their ids (nulls first); an empty
    table gives no rows; only the pieces' columns are returned.
    """
    return pack_documents(docs)


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
