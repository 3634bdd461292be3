"""Quality rules as a short-circuit cascade.

Each rule rejects a document on its own.  A plan for the cascade is made on a
bounded random sample of all rows: a rule's cost is the time that its expression adds
over the sample, and rules are put in order one after another, each time the one with
the most rejections per cost among the sample rows that the base and the rules
before let pass.  The order decides only how soon work stops; the verdict is the same
for every order.

Columns that the base counts need are computed once; the cascade is one CASE
expression, so a rule is evaluated only for rows that all earlier ones let pass.

Defined cases: a null or empty text has no words and fails the base; ties in
rejection per cost keep the order in ``RULES``; a very long text is read whole; repeated
rows are judged one by one; an empty table gives no rows and
the written order; extra columns are kept by :func:`kept_documents`, whatever
their names, because working columns take names that the table lacks.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANKS, fresh_name, stored, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rows at most that costs and rejection rates are estimated on.
SAMPLE_ROWS = 2048
#: Files that the sample is stored in, to be read by several tasks.
SAMPLE_PARTS = 8
#: Least cost of a rule: below it, times on the sample tell nothing.
LEAST_SECONDS = 0.005
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = r"[#*$%&|<>]"
#: Patterns that begin with one character are found much faster than alternatives.
BULLET, LINE_END = r"[\x20\t]*[-*\u2022]", r"[\x20\t]*(?:\n|$)"


def _sorted_pairs(windows: Column, distinct: Column) -> Column:
    """Hashes with their places, sorted; nothing where every hash is distinct."""
    return F.when(
        F.size(windows) > distinct,
        F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _repeat_words(pairs: Column) -> Column:
    """Words inside windows that occur twice or more.

    ``pairs`` must be a column, not an expression: it is read for every element.
    Places with an equal neighbour are put back in order, and each adds the words
    that the one before did not cover.
    """
    twins = F.filter(
        F.transform(
            pairs,
            lambda p, k: F.when(
                (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]), p["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return F.aggregate(
        F.array_sort(twins),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.cast("int").alias("last")
        ),
        lambda acc: acc["n"],
    )


def with_counts(docs: DataFrame, at: str = "quality__") -> DataFrame:
    """Adds the struct ``at`` with the base counts of the column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w, h, p, lines = (fresh_name(docs, f"{at}{x}") for x in "whpl")
    step = docs.withColumn(w, words_of(F.col("text")))
    words = F.col(w)
    step = step.withColumn(
        h,
        F.when(
            F.size(words) >= WINDOW,
            # single words: a slice for each place would copy all of them
            F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    step = step.withColumn(p, _sorted_pairs(F.col(h), F.size(F.array_distinct(F.col(h)))))
    step = step.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(p)).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        # not deterministic: else the optimizer moves filters on counts below the
        # columns that they are made of, and evaluates those once for each use
        F.monotonically_increasing_id().alias("row"),
    )
    return step.withColumn(at, counts).drop(w, h, p, lines)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


#: name to expression of (text, counts): true where the rule rejects.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    # a symbol for every fifth word or more
    "symbols": lambda text, c: 5 * c["n_symbols"] > c["n_words"],
    # more than half of the lines are copies of earlier ones
    "copied_lines": lambda text, c: 2 * c["n_dup_lines"] > c["n_lines"],
    # words are shorter than 2 or longer than 20 characters on the mean
    "word_length": lambda text, c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"]),
    # runs of exclamation or question marks after every fifth word or more
    "shouting": lambda text, c: 5 * F.regexp_count(text, F.lit(r"[!?]{2,}")) > c["n_words"],
    # more than nine of ten lines begin with a bullet
    "bullets": lambda text, c: 10 * (F.regexp_count(text, F.lit("\n" + BULLET)) + text.rlike("^" + BULLET).cast("int")) > 9 * c["n_lines"],
    # more than three of ten lines end with an ellipsis
    "ellipses": lambda text, c: 10 * (F.regexp_count(text, F.lit(r"\.\.\." + LINE_END)) + F.regexp_count(text, F.lit(r"\u2026" + LINE_END))) > 3 * c["n_lines"],
    # less than half of the characters in words are letters
    "letters": lambda text, c: 2 * F.length(F.regexp_replace(text, r"\P{L}+", "")) < c["word_chars"],
}


def cascade_order(docs: DataFrame, rules: dict = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """``(rule, seconds, rejection rate)`` in the order of the cascade, from a random sample.

    The sample has ``rows`` rows at most and is only used for this order; it is stored
    with the base counts, so a rule's cost is the time that its own expression takes,
    beyond that of reading the rows.  A rate is the share of the rows rejected among those
    that came so far.  What comes back to the driver are truth values of the sample.
    """
    n = docs.count()
    if not n:
        return [(name, LEAST_SECONDS, 0.0) for name in rules]
    some = docs.select("text").sample(fraction=min(1.0, 1.5 * rows / n), seed=5).limit(rows).repartition(SAMPLE_PARTS)
    some = stored(with_counts(some), "quality-sample")
    text, c = F.coalesce("text", F.lit("")), F.col("quality__")
    verdicts = {name: F.coalesce(rule(text, c), F.lit(False)) for name, rule in rules.items()}
    left = [r.asDict() for r in some.filter(~base_failed(c)).select(*[v.alias(name) for name, v in verdicts.items()]).collect()]

    def seconds(verdict: Column) -> float:
        taken = []
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            some.agg(F.count(F.when(verdict, 1)), F.sum(F.octet_length("text")), F.sum(c["n_words"])).collect()
            taken.append(time.perf_counter() - began)
        return min(taken)

    base = seconds(F.octet_length(text) > 0)
    costs = {name: max(seconds(v) - base, LEAST_SECONDS) for name, v in verdicts.items()}
    order: list[tuple[str, float, float]] = []
    while len(order) < len(rules):
        open_ = [name for name in rules if name not in {o[0] for o in order}]
        rates = {name: sum(r[name] for r in left) / max(len(left), 1) for name in open_}
        best = max(open_, key=lambda name: rates[name] / costs[name])
        order.append((best, costs[best], rates[best]))
        left = [r for r in left if not r[best]]
    return order


def failed_rule(text: Column, counts: Column, order: list[str], rules: dict = RULES) -> Column:
    """The first rule, in this order, that rejects; null if none does."""
    case = F.when(base_failed(counts), F.lit("base"))
    for name in order:
        case = case.when(rules[name](text, counts), F.lit(name))
    return case


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that no rule rejects, with the columns they came with."""
    order = [name for name, _, _ in cascade_order(docs)]
    text = F.coalesce(F.col("text"), F.lit(""))
    at = fresh_name(docs, "quality__")
    c = F.col(at)
    return with_counts(docs, at).filter((c["row"] >= 0) & failed_rule(text, c, order).isNull()).drop(at)


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = [name for name, _, _ in cascade_order(docs)]
    c = F.col("quality__")
    failed = failed_rule(F.coalesce(F.col("text"), F.lit("")), c, order)
    judged = with_counts(docs.select("doc_id", "text")).withColumn("failed_rule", failed)
    return judged.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(c).alias("base_failed"),
        F.col("failed_rule").isNull().alias("kept"),
    )
