"""Predicate builders."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of the predicates that are given; true if none is."""
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def any_of(*predicates: Column) -> Column:
    """Disjunction; false if there is none."""
    return reduce(or_, predicates, F.lit(False))


def half_open(ts: Column, start=None, end=None) -> Column:
    """``start <= ts < end`` for the bounds that are given."""
    return all_of(ts >= F.lit(start) if start is not None else None, ts < F.lit(end) if end is not None else None)


def closed(ts: Column, start=None, end=None) -> Column:
    """``start <= ts <= end`` for the bounds that are given."""
    return all_of(ts >= F.lit(start) if start is not None else None, ts <= F.lit(end) if end is not None else None)


def not_true(c: Column) -> Column:
    """False or missing."""
    return ~c.eqNullSafe(F.lit(True))


def differs(c: Column, value) -> Column:
    """Another value or missing."""
    return ~c.eqNullSafe(F.lit(value))


def contains_any(term: str, *columns: Column) -> Column:
    """Case-insensitive substring of any column; the term is plain text."""
    return any_of(*[F.coalesce(F.lower(c).contains(term.lower()), F.lit(False)) for c in columns])


def words_match(search: str, column: Column) -> Column:
    """Any word of the search, as a case-insensitive pattern; no words match nothing."""
    return any_of(*[F.coalesce(column.rlike(f"(?i){w}"), F.lit(False)) for w in search.split()])


def truthy(c: Column, kind: str = "string") -> Column:
    """Null where the value counts as false: empty text, zero or false."""
    empty = {"string": "", "number": 0, "boolean": False}[kind]
    return F.when(c != F.lit(empty), c)


#: Labels of the training list: fixed values.
TYPE_CODES = {"Pages": 0, "Files": 1, "Snippets": 2, "FAQs": 3}
STATUS_CODES = {"Failed": [2], "Trained": [1], "In progress": [0]}


def type_filter(label: str, column: Column) -> Column:
    """A label's code; labels that are not listed do not filter."""
    return column == TYPE_CODES[label] if label in TYPE_CODES else F.lit(True)


def status_filter(label: str, column: Column, default: tuple[int, ...] = (1, 2)) -> Column:
    return column.isin(*STATUS_CODES.get(label, default))
