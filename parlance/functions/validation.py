"""Checks of contents before they are trained on, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least characters of each kind, and of others; kinds of files.
LEAST = {"snippet": 10, "file": 10, "faq": 1, "webpage": 10}
OTHER = 5
FILES = ("txt", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
#: What a content without fault is called.
OK = "OK"


def trimmed(c: Column) -> Column:
    """Without white space at its ends, whatever its kind."""
    return F.regexp_replace(c, r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$", "")


def content_code(content: Column, kind: str | Column, used: Column, limit: Column) -> Column:
    """What is wrong with a content: missing, too short for its kind, or more than the owner's plan has room for."""
    least = _least(F.lit(kind) if isinstance(kind, str) else kind)
    size = F.octet_length(trimmed(content))
    return (
        F.when(F.coalesce(content, F.lit("")) == "", "CONTENT_MISSING").when(F.length(trimmed(content)) < least, "CONTENT_TOO_SHORT")
        .when(F.coalesce(used, F.lit(0)) + size > limit, "PLAN_LIMIT_EXCEEDED").otherwise(OK)
    )


def _least(kind: Column) -> Column:
    out = F.lit(OTHER)
    for name, n in LEAST.items():
        out = F.when(kind == name, n).otherwise(out)
    return out


def faq_code(question: Column, answer: Column, used: Column, limit: Column) -> Column:
    """A pair of question and answer: both there, then each by itself, then both as they are stored."""
    both = F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer)
    codes = [content_code(c, "faq", used, limit) for c in (question, answer, both)]
    incomplete = (F.coalesce(question, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == "")
    return F.when(incomplete, "FAQ_INCOMPLETE").otherwise(F.coalesce(*[F.nullif(c, F.lit(OK)) for c in codes], F.lit(OK)))


def file_code(content: Column, name: Column, used: Column, limit: Column) -> Column:
    """A file's content, then the kind that its name ends in."""
    code = content_code(content, "file", used, limit)
    return F.when((code == OK) & ~F.lower(F.substring_index(name, ".", -1)).isin(*FILES), "UNSUPPORTED_FILE_TYPE").otherwise(code)
