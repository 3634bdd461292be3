"""Page text, chunks and vectors on the way into a collection."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, OVERLAP = 2000, 400
#: Separators in their order: fixed values.
SEPARATORS = ["\n\n", "\n", ". ", " "]
DIMENSIONS = 64


# fixed values: elements and classes that pages lose, and elements without content
DROPPED = {"script", "style", "noscript", "iframe", "svg", "canvas", "form", "button", "select", "textarea", "title"}
DROPPED_CLASSES = {"ad", "advertisement", "popup", "modal"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that end where their parent or a sibling does.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


class _Markdown(HTMLParser):
    """A small helper: headings, lists, links, images and paragraphs of one page, its first footer apart."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.body, self.footer = base, [], []
        self.skipped: list[str] = []  # open elements from the one that is left out on
        self.links: list[tuple[str, int]] = []
        self.footers = self.inside = 0

    @property
    def out(self) -> list[str]:
        return self.footer if self.inside and self.footers == 1 else self.body

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skipped:
            if tag not in EMPTY:
                self.skipped.append(tag)
            return
        if tag in DROPPED or DROPPED_CLASSES & set((a.get("class") or "").split()):
            if tag not in EMPTY:
                self.skipped.append(tag)
            return
        if tag == "footer":
            self.footers += not self.inside
            self.inside += 1
        if tag in ("p", "div", "footer", "section", "article", "ul", "ol", "table", "blockquote", "header", "main", "nav"):
            self.out.append("\n\n")
        elif tag in ("li", "tr"):
            self.out.append("\n- " if tag == "li" else "\n")
        elif tag == "br":
            self.out.append("\n")
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "a":
            self.links.append((self.absolute(a.get("href")), len(self.out)))
            self.out.append("[" if a.get("href") else "")
        elif tag == "img" and a.get("src"):
            alt = (a.get("alt") or "").strip()
            self.out.append(f"\n\nImage{f' ({alt})' if alt else ''}: {self.absolute(a['src'])}\n\n")

    def absolute(self, link: str | None) -> str:
        link = (link or "").strip()
        return link if not link or link.startswith(("http", "data:")) else urljoin(self.base, link)

    def handle_endtag(self, tag):
        if self.skipped:
            # loose elements end with their parent; a tag that closes nothing here is ignored
            k = next((k for k in range(len(self.skipped) - 1, -1, -1) if self.skipped[k] == tag or self.skipped[k] not in LOOSE), None)
            if k is not None and self.skipped[k] == tag:
                del self.skipped[k:]
            elif tag in self.skipped and len(self.skipped) > 1:
                del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]
            elif len(self.skipped) == 1 and self.skipped[0] in LOOSE:
                self.skipped.clear()  # its parent ends
            return
        if tag == "a" and self.links:
            href, at = self.links.pop()
            if href:
                shown = "".join(self.out[at + 1 :]).strip()
                self.out.append(f"]({href})" if shown else f"Link: {href}]({href})")
        elif tag == "footer" and self.inside:
            self.inside -= 1

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data)


def markdown(url: str | None, page: str | None) -> tuple[str, str]:
    """Markdown of a page without its footers, and of its first footer."""
    parser = _Markdown(url or "")
    parser.feed(page or "")
    parser.close()
    return "".join(parser.body), "".join(parser.footer)


@F.pandas_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("footer", T.StringType())]))
def html_to_md(url: pd.Series, page: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([markdown(u, p) for u, p in zip(url, page)], columns=["body", "footer"])


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute address, as a page at ``base`` means it; null without a base."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    whole = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    local = F.when(link.startswith("/"), link).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), link))
    parts = F.split(F.regexp_extract(local, r"^([^?#]*)", 1), "/")
    last = F.get(parts, F.size(parts) - 1)

    def step(acc: Column, x: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(x == "..", up).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))

    tidy = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    tidy = F.concat(F.array_join(tidy, "/"), F.when(last.isin("..", "."), "/").otherwise(F.when(F.size(parts) < 2, "/").otherwise("")))
    rest = F.regexp_extract(local, r"^[^?#]*(.*)$", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return F.when(origin == "", None).otherwise(
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), link))
        .when(link.startswith("?"), F.concat(whole, link))
        .otherwise(F.concat(origin, tidy, rest))
    )


def origin_of(url: Column) -> Column:
    """Scheme and host in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))


#: The address of each link of a page, in double, single or no quotes.
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def links_of(page: Column) -> Column:
    found = [F.regexp_extract_all(page, F.lit(HREF), F.lit(k)) for k in (1, 2, 3)]
    joined = F.zip_with(F.zip_with(*found[:2], lambda x, y: F.concat(x, y)), found[2], lambda x, y: F.concat(x, y))
    return F.filter(F.transform(joined, lambda x: F.trim(x)), lambda x: x != "")


#: Where a page names its logo, in the order of preference: element, pattern of its tag, attribute.
LOGOS = [
    ("link", r"""\brel\s*=\s*["']?apple-touch-icon["'\s>]""", "href"), ("link", r"""\brel\s*=\s*["']?icon["'\s>]""", "href"),
    ("link", r"""\brel\s*=\s*["']shortcut icon["']""", "href"), ("meta", r"""\bproperty\s*=\s*["']?og:image["'\s>]""", "content"),
    *[("img", rf"""\b{a}\s*=\s*("[^"]*logo|'[^']*logo|[^\s"'>]*logo)""", "src") for a in ("alt", "class", "id")],
]


def logo_of(url: Column, page: Column) -> Column:
    """The first logo that a page names, as an absolute address; null if it names none."""
    found = []
    for element, pattern, attribute in LOGOS:
        tag = F.get(F.filter(F.regexp_extract_all(page, F.lit(rf"(?is)<{element}\b[^>]*>"), F.lit(0)), lambda t: t.rlike(f"(?i){pattern}")), 0)
        value = rf"""(?is)\s{attribute}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
        found.append(F.nullif(F.trim(F.concat(*[F.regexp_extract(tag, value, k) for k in (1, 2, 3)])), F.lit("")))
    return resolved(F.concat(origin_of(url), F.lit("/")), F.coalesce(*found))


def robots_addresses(robots: Column) -> Column:
    """Addresses of the ``Sitemap:`` lines of a robots file, in order; any case, blanks around the colon."""
    lines = F.split(robots, r"\r\n|\r|\n")
    return F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"(?i)^\s*sitemap\s*:\s*(\S+)", 1)), lambda x: x != "")


def sitemap_addresses(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, url``: the addresses below each root sitemap, through nested indexes.

    ``documents`` has ``url, xml``, ``roots`` has ``root``.  An index names further
    documents; a document is read once for each root, so circles end.  Addresses are
    trimmed, distinct, and start with ``http``.
    """
    locs = F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    parsed = documents.select("url", F.col("xml").contains("<sitemapindex").alias("nested"), locs.alias("locs"))
    now = roots.select("root", F.col("root").alias("url")).distinct()
    seen, found = now, None
    while True:
        level = now.join(parsed, "url").select("root", "nested", F.explode("locs").alias("url"))
        pages = level.filter(~F.col("nested")).select("root", "url")
        found = pages if found is None else found.unionByName(pages)
        now = level.filter("nested").select("root", "url").distinct().join(seen, ["root", "url"], "left_anti")
        if now.isEmpty():
            return found.filter(F.col("url").startswith("http")).distinct()
        seen = seen.unionByName(now)


def split(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that the text has; neighbours overlap."""
    if len(text) <= size:
        return [text] if text.strip() else []
    rest = SEPARATORS if separators is None else separators
    mark = next((s for s in rest if s in text), None)
    if mark is None:
        return [text[k : k + size] for k in range(0, max(1, len(text) - overlap), size - overlap)]
    deeper = rest[rest.index(mark) + 1 :]
    parts = [q for p in text.split(mark) for q in ([p] if len(p) <= size else split(p, size, overlap, deeper))]
    out: list[str] = []
    held: list[str] = []
    length = 0
    for p in parts:
        if held and length + len(mark) + len(p) > size:
            out.append(mark.join(held))
            while held and (length > overlap or length + len(mark) + len(p) > size):
                length -= len(held.pop(0)) + len(mark)
            length = max(length, 0)
        length += len(p) + (len(mark) if held else 0)
        held.append(p)
    return [x for x in [*out, mark.join(held)] if x.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_chunks(text: pd.Series) -> pd.Series:
    return pd.Series([split(t or "") for t in text])


def chunked(df: DataFrame, text: str) -> DataFrame:
    """A row for each chunk with its place and the number of chunks."""
    return df.withColumn("__chunks", split_chunks(F.col(text))).select(
        *df.columns, F.posexplode("__chunks").alias("chunk_index", "chunk"), F.size("__chunks").alias("total_chunks")
    )


def embed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Hashed bag of words, a stand-in for a model: counts of words by hash, in the JVM."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.size(F.filter(cells, lambda c: c == k)).cast("float"))
