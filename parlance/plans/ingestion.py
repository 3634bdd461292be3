"""Pages to chunks to points."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import clean_markdown
from parlance.operators.ingest import chunked, embed, html_to_md, links_of, logo_of, origin_of, resolved, robots_addresses, sitemap_addresses
from parlance.plans.registry import query
from parlance.sources.views import Views

C = F.col


def pages(v: Views):
    """Pages as markdown; a site's footer stands behind its first page that has one."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    made = v.webpages.select("id", "url", host.alias("host"), html_to_md(C("url"), C("html")).alias("md"))
    made = made.select("id", "url", "host", "md.body", F.nullif(clean_markdown(C("md.footer")), F.lit("")).alias("footer"))
    first = made.filter("footer is not null").groupBy("host").agg(F.min("id").alias("first"))
    shown = F.when((C("id") == C("first")) & C("footer").isNotNull(), F.concat(F.lit("\n\n---\n**Footer Links (from "), "host", F.lit(")**\n"), "footer"))
    whole = F.concat("body", F.coalesce(shown, F.lit("")))
    return made.join(first, "host", "left").select("id", "url", clean_markdown(whole).alias("text"))


@query("html_to_md")
def html_to_markdown(v: Views):
    """Pages as markdown with absolute links."""
    return pages(v)


@query("split_chunks")
def split_into_chunks(v: Views):
    """Chunks of at most 2000 characters with their places."""
    return chunked(v.tdocs.select("id", "content"), "content").drop("content")


@query("chunk_counts")
def chunk_counts(v: Views):
    return split_into_chunks(v).groupBy("id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk").cast("long")).alias("chars"))


@query("w_chunk_index")
def w_chunk_index(v: Views):
    return split_into_chunks(v).select("id", "chunk_index", "total_chunks", F.crc32(C("chunk").cast("binary")).alias("chunk_crc32"))


@query("embed_chunks")
def embed_chunks(v: Views):
    """Chunks of pages as points."""
    return chunked(pages(v), "text").select("id", "url", "chunk_index", "total_chunks", "chunk", embed(C("chunk")).alias("vector"))


@query("same_origin_links", """SELECT DISTINCT id, link FROM (SELECT id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS origin, regexp_extract(url, '^([a-zA-Z]+:)', 1) AS scheme, unnest(regexp_extract_all(html, '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*"([^"]*)"', 1)) AS h,
 CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN scheme || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || h END AS link FROM webpages)
 WHERE link IS NOT NULL AND origin <> '' AND lower(regexp_extract(link, '^([a-zA-Z]+://[^/?#]*)', 1)) = origin""")
def same_origin_links(v: Views):
    """Links of each page, resolved against its address, that stay on its origin."""
    links = v.webpages.select("id", "url", F.explode(links_of(C("html"))).alias("link"))
    links = links.select("id", "url", resolved(C("url"), C("link")).alias("link"))
    return links.filter((origin_of(C("url")) != "") & (origin_of(C("link")) == origin_of(C("url")))).select("id", "link").distinct()


@query("sitemap_urls", """SELECT host, count(DISTINCT url) AS urls, min(url) AS first_url FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, url FROM webpages) WHERE host <> '' AND starts_with(url, 'http') GROUP BY host""")
def sitemap_urls(v: Views):
    """Addresses out of sitemaps with nested indexes.

    The documents are made of the pages: each site has an index that names an index
    for each part of the site, which names lists of the pages.
    """
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    place = v.webpages.select(host.alias("host"), "url", F.regexp_extract("url", "://[^/?#]*/?([^/?#]*)", 1).alias("part"), F.expr("id div 1000").alias("n")).filter("host <> ''")
    name = lambda *p: F.concat(F.lit("https://"), "host", F.lit("/sitemap"), *[F.concat(F.lit("-"), C(x).cast("string")) for x in p], F.lit(".xml"))

    def document(rows, address, kind: str, item: str, loc):
        entry = F.concat(F.lit(f"<{item}><loc> "), F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit(f" </loc></{item}>"))
        body = F.array_join(F.collect_list(entry), "")
        return rows.groupBy(address.alias("url")).agg(F.concat(F.lit(f"<{kind}>"), body, F.lit(f"</{kind}>")).alias("xml"))

    lists = document(place, name("part", "n"), "urlset", "url", C("url"))
    parts = document(place.select("host", "part", "n").distinct(), name("part"), "sitemapindex", "sitemap", name("part", "n"))
    tops = document(place.select("host", "part").distinct(), name(), "sitemapindex", "sitemap", name("part"))
    roots = place.select(name().alias("root")).distinct()
    found = sitemap_addresses(lists.unionByName(parts).unionByName(tops), roots)
    return found.groupBy(F.regexp_extract("root", "://([^/?#]*)", 1).alias("host")).agg(F.count(F.lit(1)).alias("urls"), F.min("url").alias("first_url"))


@query("robots_sitemaps", r"""SELECT id, len(string_split_regex(content, '\r\n|\r|\n')) AS n_lines, coalesce(string_agg(trim(regexp_extract(line, '(?i)^\s*sitemap\s*:\s*(\S+)', 1)), ' ') FILTER (WHERE regexp_matches(line, '(?i)^\s*sitemap\s*:\s*\S')), '') AS sitemaps
 FROM (SELECT id, content, unnest(string_split_regex(content, '\r\n|\r|\n')) AS line FROM tdocs) GROUP BY id, content""")
def robots_sitemaps(v: Views):
    """Addresses of the ``Sitemap:`` lines of each text, read as a robots file (the given texts have none; tests do)."""
    lines = F.split("content", r"\r\n|\r|\n")
    return v.tdocs.select("id", F.size(lines).cast("long").alias("n_lines"), F.array_join(robots_addresses(C("content")), " ").alias("sitemaps"))


@query("logo_pick", """SELECT id, CASE WHEN id % 4 = 0 THEN o || '/touch.png' WHEN id % 4 = 1 THEN 'https://cdn.test/og.png' WHEN id % 4 = 2 THEN o || '/pic/l.png' END AS logo FROM (SELECT id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS o FROM webpages)""")
def logo_pick(v: Views):
    """The first logo candidate that a page has, resolved; pages get some, as they have none."""
    extra = F.when(C("id") % 4 == 0, "<link href=/fav.ico rel='icon'><link rel=apple-touch-icon href='touch.png'>").when(C("id") % 4 == 1, "<img id=LOGO src=x.png><meta content='https://cdn.test/og.png' property='og:image'>")
    extra = extra.when(C("id") % 4 == 2, '<img src="a.png"><img class="big Site-Logo" src="./pic/l.png">').otherwise("")
    return v.webpages.select("id", logo_of(C("url"), F.concat("html", extra)).alias("logo"))
