"""Functions of URLs and host names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of two parts.
TWO_PART = ["co.uk", "com.au", "co.nz", "co.jp", "com.br", "co.in", "net.au", "org.uk", "ac.uk", "gov.uk"]


def hostname(c: Column) -> Column:
    """Host of a URL-like text without ``www.``; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#:\s]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def primary_label(host: Column) -> Column:
    """The label in front of the public suffix."""
    parts = F.split(host, r"\.")
    two = F.substring_index(host, ".", -2).isin(TWO_PART) & (F.size(parts) >= 3)
    return F.when(two, F.try_element_at(parts, F.lit(-3))).when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(host)


def display_name(website: Column, onboarding: Column, name: Column) -> Column:
    """The label of the first address that has a host, else the name, the website, or ``client``."""
    own = [F.nullif(F.trim(c), F.lit("")) for c in (name, website)]
    return F.coalesce(primary_label(F.coalesce(hostname(website), hostname(onboarding))), *own, F.lit("client"))


def is_domain(c: Column) -> Column:
    return F.trim(c).rlike(r"^[\w.-]+\.[\w.-]+$")


def with_scheme(c: Column) -> Column:
    return F.when(c.startswith("http://") | c.startswith("https://"), c).otherwise(F.concat(F.lit("https://"), c))


def is_sitemap(c: Column) -> Column:
    return F.lower(c).endswith(".xml")


def is_homepage(c: Column) -> Column:
    """At most one segment in the path."""
    path = F.regexp_extract(c, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    return F.size(F.filter(F.split(path, "/"), lambda p: p != "")) <= 1
