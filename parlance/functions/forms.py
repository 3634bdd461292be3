"""Checks of form values, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of valid values
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE = r"^[\+]?[1-9][\d]{0,15}$"
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^\s/?#]+|[^/\s])\S*$"


@dataclass(frozen=True)
class Field:
    """A field of a form: where its value is, and what it must be."""

    label: str
    kind: str = "text"
    required: bool = False
    least: int | None = None
    most: int | None = None
    pattern: str | None = None


def kind_error(field: Field, value: Column) -> Column:
    if field.kind == "email":
        return F.when(~value.rlike(EMAIL), f"{field.label} is no e-mail address")
    if field.kind == "tel":
        return F.when(~F.regexp_replace(value, r"[\s\-\(\)]", "").rlike(PHONE), f"{field.label} is no phone number")
    if field.kind == "number":
        return F.when((F.trim(value) != "") & F.trim(value).try_cast("double").isNull(), f"{field.label} is no number")
    if field.kind == "url":
        return F.when(~F.trim(value).rlike(URL), f"{field.label} is no address")
    return F.lit(None).cast("string")


def errors(fields: list[tuple[Field, Column]]) -> Column:
    """All errors of a form, in the order of its fields; an array.

    A required value that is missing or blank is one error; values that are there, blank
    ones too, are checked for their kind, their length and their pattern, each of
    which may be an error of its own.
    """
    found: list[Column] = []
    for field, value in fields:
        there = F.coalesce(value, F.lit("")) != ""
        blank = F.trim(F.coalesce(value, F.lit(""))) == ""
        checked = there & ~blank if field.required else there
        if field.required:
            found.append(F.when(blank, f"{field.label} is missing"))
        found.append(F.when(checked, kind_error(field, value)))
        if field.least:
            found.append(F.when(checked & (F.length(value) < field.least), f"{field.label} has fewer than {field.least} characters"))
        if field.most:
            found.append(F.when(checked & (F.length(value) > field.most), f"{field.label} has more than {field.most} characters"))
        if field.pattern:
            found.append(F.when(checked & ~value.rlike(field.pattern), f"{field.label} has another form"))
    return F.filter(F.array(*found), lambda e: e.isNotNull())
