"""Text functions, column to column."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greetings.
GREETINGS = [
    "hi", "hello", "hey", "greetings", "good morning", "good afternoon", "good evening", "good night", "howdy", "sup", "what's up", "hey there",
]
#: Phrases that ask for a person.
AGENT_PHRASES = [
    "speak to agent", "talk to agent", "connect to agent", "live agent", "human agent", "real person", "speak to human", "talk to human",
    "connect to human", "speak to person", "talk to person", "connect to person", "speak to someone", "talk to someone", "connect to someone",
    "agent please", "human please", "person please", "agent", "human", "representative", "support agent", "customer service", "customer support",
    "live chat", "live support", "can i speak", "can i talk", "i want to speak", "i want to talk", "need to speak", "need to talk", "want to speak",
    "want to talk", "let me speak", "let me talk", "transfer to agent", "transfer to human", "transfer to person",
]
#: Hints of a question about the site's structure.
STRUCTURE_HINTS = ["list", "show", "give me", "links", "how many", "all ", "urls", "products", "collections", "top "]
#: Words that carry no meaning for a search.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "for", "to", "in", "on", "with", "all", "show", "list", "give", "me", "links", "url", "urls", "how", "many",
    "top", "best", "your", "their", "our", "my", "there", "is", "are", "do", "you", "please", "products", "collections", "link", "items", "item",
]
#: Words that promise a long answer.
LONG_WORDS = [
    "list", "top", "best", "all", "multiple", "several", "many", "links", "link", "url", "urls", "products", "items", "options", "ways", "steps",
    "examples", "recommendations", "suggestions", "compare", "difference", "differences", "explain", "detailed", "comprehensive", "complete", "full",
    "everything", "show me", "give me", "provide me", "send me",
]
#: Patterns of the token budget.
QUANTITY = r"(?i)\b(\d+)\s+(best|top|ways|steps|items|products|links|options|recommendations|suggestions|examples)\b"
LISTING = r"(?i)\b(list|lists|listing)\b"
WHOLE = r"(?i)\b(all|every|each)\b"
LINKING = r"(?i)\b(link|links|url|urls|website|websites|page|pages)\b"
DETAILED = r"(?i)\b(explain|describe|detail|detailed|comprehensive|complete|full|everything|how\s+does|how\s+do|what\s+are|what\s+is)\b"


def clean_spaces(c: Column) -> Column:
    """No-break spaces become blanks, runs one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, " ", " "), r"\s+", " "))


def norm_question(c: Column) -> Column:
    """Tags and no-break spaces become blanks; runs of blanks one; trimmed, lower case; null is empty."""
    return F.lower(clean_spaces(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" "))))


def strip_html(c: Column) -> Column:
    """Tags go without a trace, then five entities are decoded, the ampersand first."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(c)


def clean_content(c: Column) -> Column:
    """Line ends unified, three or more become two, tabs and runs of blanks become one blank."""
    for pattern, put in (("\r\n?", "\n"), ("\n{3,}", "\n\n"), ("\t", " "), (" {2,}", " ")):
        c = F.regexp_replace(c, pattern, put)
    return F.trim(c)


def clean_markdown(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def _any(predicates: list[Column]) -> Column:
    return reduce(or_, predicates, F.lit(False))


def is_greeting(c: Column) -> Column:
    q = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return _any([(q == g) | q.startswith(f"{g} ") | (q == f"{g}!") for g in GREETINGS])


def is_accidental(c: Column) -> Column:
    """Keyboard noise: long without blanks and of few letters whatever their case, or one half twice, letter by letter."""
    q = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    n = F.length(q)
    few = F.size(F.array_distinct(F.split(F.lower(q), ""))) < n * 0.4
    half = F.floor(n / 2).cast("int")
    twice = (n > 6) & (n % 2 == 0) & (F.left(q, half) == F.right(q, half))
    return (n >= 3) & ((~q.contains(" ") & (n > 10) & few) | twice)


def is_agent_request(c: Column) -> Column:
    q = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return _any([q.contains(p) for p in AGENT_PHRASES])


def detect_intent(c: Column) -> Column:
    q = F.lower(F.coalesce(c, F.lit("")))
    return F.when(_any([q.contains(h) for h in STRUCTURE_HINTS]), "STRUCTURAL").otherwise("SEMANTIC")


def _first_number(c: Column) -> Column:
    digits = F.ltrim(F.regexp_extract(c, r"\b(\d+)\b", 1), F.lit("0"))
    digits = F.when((digits == "") & c.rlike(r"\b\d+\b"), "0").otherwise(digits)
    return F.when(F.length(digits) > 18, F.lit(10**18 - 1)).otherwise(digits.try_cast("long"))


def requested_count(c: Column, fallback: int = 5) -> Column:
    """The first whole number in the text if it is above 0 (one beyond 18 digits counts as the largest of 18)."""
    n = _first_number(F.coalesce(c, F.lit("")))
    return F.when(n > 0, n).otherwise(F.lit(fallback)).cast("long")


def keywords(c: Column) -> Column:
    """Words of more than two characters that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\w\s-]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def max_tokens(c: Column) -> Column:
    """Token budget of an answer, by what it is asked to hold."""
    q = F.coalesce(c, F.lit(""))
    long = _any([F.lower(F.trim(q)).contains(w) for w in LONG_WORDS])
    lists, links = q.rlike(LISTING) | q.rlike(WHOLE), q.rlike(LINKING)
    n = F.coalesce(_first_number(q), F.lit(5))
    counted = q.rlike(QUANTITY) | (long & (lists | links))
    return (
        F.when(counted & links, F.least(F.lit(2000), 200 + n * 150))
        .when(counted, F.least(F.lit(1000), 200 + n * 80))
        .when(links & long, 800).when(lists | (long & q.rlike(DETAILED)), 600).when(long, 400).otherwise(200).cast("long")
    )


def role_name(c: Column) -> Column:
    return (
        F.when(c.isin("ai", "bot", "assistant"), "Assistant").when(c.isin("visitor", "user"), "User")
        .when(c.isin("humanAgent", "client", "agent"), "Agent").when(c == "system", "System").otherwise("User")
    )


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long")


def meaningful(c: Column) -> Column:
    """Two different characters, two words, and three letters in ten characters."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    letters = F.length(F.regexp_replace(bare, "[^a-zA-Z]", ""))
    return (F.size(F.array_distinct(F.split(bare, ""))) >= 2) & (word_count(c) >= 2) & (letters >= 0.3 * F.length(bare))


def dominated(c: Column) -> Column:
    """Whether one word of more than two letters makes up more than three tenths of all words, inside the row."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")
    long = F.array_sort(F.filter(words, lambda w: F.length(w) > 2))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(acc["word"] == w, acc["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(long, start, step, lambda acc: acc["most"]) > 0.3 * F.size(words)


def spam(c: Column) -> Column:
    """One word all over, many runs of marks, or mostly capitals in a long text."""
    c = F.coalesce(c, F.lit(""))
    caps = F.length(F.regexp_replace(c, "[^A-Z]", ""))
    return dominated(c) | (F.regexp_count(c, F.lit("[!?]{2,}")) > 5) | ((caps > 0.5 * F.length(c)) & (F.length(c) > 100))


def initials(c: Column) -> Column:
    parts = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"[\s#]+"), lambda w: w != "")
    return F.upper(F.left(F.array_join(F.transform(parts, lambda w: F.left(w, F.lit(1))), ""), F.lit(2)))


def html_encode(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return F.concat(F.lit("<p>"), c, F.lit("</p>"))


def format_bytes(c: Column) -> Column:
    """Largest unit that the value reaches, with one decimal."""

    def shown(size: int, unit: str) -> Column:
        return F.concat((F.floor(c * 10 / size + 0.5) / 10).cast("string"), F.lit(f" {unit}"))

    return F.when(c >= 1 << 40, shown(1 << 40, "TB")).when(c >= 1 << 30, shown(1 << 30, "GB")).when(c >= 1 << 20, shown(1 << 20, "MB")).otherwise(shown(1 << 10, "KB"))
