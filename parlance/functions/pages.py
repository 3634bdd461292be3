"""What a page's html says about its site."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = r"""(?:[^>"']|"[^"]*"|'[^']*')*>"""
#: Links of menus that name no service.
STOP = ("home", "about", "contact", "blog", "login", "sign up", "sign in")
#: Words in a class or id of sections that list services; longest names; names of a site.
SECTIONS, LONGEST, SHORTEST_HEADING, MOST = ("service", "product"), 50, 3, 10
YEAR = r"(?i)(?:founded|established|since|©)\s*(?:in\s*)?(\d{4})"


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, in any quoting; empty if it is not there."""
    at = rf"""(?is)^<[a-z0-9]+(?:[^>"']|"[^"]*"|'[^']*')*?\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, at, k) for k in (1, 2, 3)])


def meta(page: Column, kind: str, name: str) -> Column:
    """Trimmed content of the first meta tag whose ``kind`` (name, property) is ``name``, whatever the order of attributes; else null."""
    tags = F.regexp_extract_all(page, F.lit(rf"(?is)<meta\s{TAG}"), F.lit(0))
    ours = F.filter(tags, lambda t: F.lower(F.trim(attribute(t, kind))) == name.lower())
    return F.nullif(F.trim(attribute(F.get(ours, 0), "content")), F.lit(""))


def inner_text(markup: Column) -> Column:
    """Text of markup: comments and tags go, the common character references are decoded."""
    text = F.regexp_replace(F.regexp_replace(markup, r"(?s)<!--.*?-->", ""), rf"(?s)</?[a-zA-Z]{TAG}", "")
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&#169;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def first_element(page: Column, name: str) -> Column:
    """Trimmed text of the first element of a name; null if it is empty or not there."""
    return F.nullif(F.trim(inner_text(F.regexp_extract(page, rf"(?is)<{name}(?:\s{TAG}|>)(.*?)</{name}\s*>", 1))), F.lit(""))


def site_name(page: Column) -> Column:
    """The name that the page gives its site, else its title's, else the first part of the title, else the first heading."""
    title = first_element(page, "title")
    short = F.nullif(F.trim(F.substring_index(F.substring_index(title, "|", 1), "-", 1)), F.lit(""))
    return F.coalesce(meta(page, "property", "og:site_name"), meta(page, "property", "og:title"), short, first_element(page, "h1"), title)


def described(page: Column) -> Column:
    """Meta keywords and description, in lower case."""
    return F.lower(F.concat_ws(" ", F.coalesce(meta(page, "name", "keywords"), F.lit("")), F.coalesce(meta(page, "name", "description"), F.lit(""))))


def founded_year(page: Column) -> Column:
    """The year after the first words of a foundation, in the footers, then in the body."""
    footers = F.array_join(F.regexp_extract_all(page, F.lit(rf"(?is)<footer(?:\s{TAG}|>)(.*?)</footer\s*>"), F.lit(1)), "")
    body = F.regexp_extract(page, rf"(?is)<body(?:\s{TAG}|>)(.*)", 1)
    return F.nullif(F.regexp_extract(F.concat_ws(" ", inner_text(footers), inner_text(body)), YEAR, 1), F.lit(""))


class _Services(HTMLParser):
    """Links inside menus and headers, headings inside sections of services."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, inside a menu, inside a section
        self.texts: list[tuple[str, int, list[str]]] = []  # kind, depth, pieces
        self.links: list[str] = []
        self.headings: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        menu, section = self.open[-1][1:] if self.open else (False, False)
        if (tag == "a" and menu) or (tag in ("h2", "h3", "h4") and section):
            self.texts.append(("link" if tag == "a" else "heading", len(self.open), []))
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        self.open.append((tag, menu or tag in ("nav", "header"), section or any(s in names for s in SECTIONS)))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
            self._close()

    def handle_data(self, data):
        for _, _, pieces in self.texts:
            pieces.append(data)

    def _close(self):
        while self.texts and self.texts[-1][1] >= len(self.open):
            kind, _, pieces = self.texts.pop()
            (self.links if kind == "link" else self.headings).append("".join(pieces).strip())

    def found(self) -> list[str]:
        self.close()
        self.open.clear()
        self._close()
        links = [t for t in self.links if t and t.lower() not in STOP and len(t) < LONGEST]
        return list(dict.fromkeys([*links, *(t for t in self.headings if SHORTEST_HEADING < len(t) < LONGEST)]))[:MOST]


@F.pandas_udf(T.ArrayType(T.StringType()))
def services(pages: pd.Series) -> pd.Series:
    """Up to ten services: texts of menu links, then headings of the sections that list them."""

    def of(page: str | None) -> list[str]:
        parser = _Services()
        parser.feed(page or "")
        return parser.found()

    return pages.map(of)
