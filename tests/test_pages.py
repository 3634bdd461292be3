"""Literal pages, names, contents and colours; expectations written by hand or by Python's own modules."""

import colorsys

import pytest
from pyspark.sql import functions as F

from parlance.functions import colors, pages, urls, validation
from parlance.operators.ingest import robots_addresses

PAGE = """<!doctype html><head><META content='Acme &amp; sons' PROPERTY=og:title ><meta charset=utf-8><meta name="Keywords" content="Online Store, shoes">
<meta data-x="a>b" content="We sell it's best" name='description'><title> Shoes - Acme | Home </title></head><body class=x><header><a href=/>Home</a><a href=/r>Repairs <b>now</b></a></header>
<nav><ul><li><a>ABOUT</a></li><li><a>Boots &amp; more</a></li><li><a>Repairs now</a></li></ul></nav><div id="our-services"><h2>Fitting</h2><div><h3>abc</h3><h4>Sole care</h4></div></div><h2>Not this</h2>
<h1>All <i>shoes</i></h1><p>Open since 1987.</p><footer>&copy; 2019 Acme</footer></body>"""


@pytest.fixture(scope="module")
def one(spark):
    rows = [("full", PAGE), ("none", None), ("empty", ""), ("plain", "<title>Only - this</title><body>established in 1901 <footer>no year</footer>"), ("broken", "<meta name=description content=short><title></title><h1> Head </h1><nav><a>open")]
    return spark.createDataFrame(rows, "k string, p string").cache()


def test_site_metadata(one):
    c = F.col("p")
    got = {r.k: r for r in one.select("k", pages.meta(c, "name", "description").alias("d"), pages.meta(c, "name", "keywords").alias("w"), pages.site_name(c).alias("n"), pages.founded_year(c).alias("y"), pages.services(c).alias("s"), pages.described(c).alias("x")).collect()}
    assert (got["full"].d, got["full"].w, got["full"].n, got["full"].y) == ("We sell it's best", "Online Store, shoes", "Acme &amp; sons", "2019")
    assert got["full"].s == ["Repairs now", "Boots & more", "Fitting", "Sole care"]
    assert got["full"].x == "online store, shoes we sell it's best"
    assert (got["plain"].n, got["plain"].y, got["plain"].d) == ("Only", "1901", None)
    assert (got["broken"].n, got["broken"].d, got["broken"].s) == ("Head", "short", ["open"])
    assert (got["none"].n, got["none"].y, got["none"].s, got["empty"].n, got["empty"].s) == (None, None, [], None, [])


def test_display_names(spark):
    rows = [
        ("https://www.shop.com", None, "x", "shop"), ("a.co.uk", None, None, "a"), (None, "http://my.site.de/x", "Bot", "site"), ("", "", " Bot ", "Bot"), (None, None, "", "client"), ("localhost", None, None, "localhost"),
    ]
    df = spark.createDataFrame(rows, "w string, o string, n string, want string")
    for r in df.select("want", urls.display_name(F.col("w"), F.col("o"), F.col("n")).alias("got")).collect():
        assert r.got == r.want


def test_contents(spark):
    rows = [
        (None, "snippet", 0, 100, "CONTENT_MISSING"), ("", "faq", 0, 100, "CONTENT_MISSING"), ("   ", "faq", 0, 100, "CONTENT_TOO_SHORT"), ("  123456789﻿\n", "webpage", 0, 100, "CONTENT_TOO_SHORT"), ("1234567890", "file", 0, 100, "OK"),
        ("a", "faq", 0, 1, "OK"), ("é", "faq", 0, 1, "PLAN_LIMIT_EXCEEDED"), ("1234", "other", 0, 100, "CONTENT_TOO_SHORT"), ("12345", "other", 95, 100, "OK"), ("12345", "other", 96, 100, "PLAN_LIMIT_EXCEEDED"), ("12345", None, None, None, "OK"),
    ]
    df = spark.createDataFrame(rows, "t string, kind string, used long, room long, want string")
    for r in df.select("*", validation.content_code(F.col("t"), F.col("kind"), F.col("used"), F.col("room")).alias("got")).collect():
        assert r.got == r.want, r
    pairs = [("q", None, 100, "FAQ_INCOMPLETE"), (" ", "a", 100, "CONTENT_TOO_SHORT"), ("q", "a", 22, "OK"), ("q", "a", 20, "PLAN_LIMIT_EXCEEDED"), ("q", "a", 21, "OK")]
    df = spark.createDataFrame(pairs, "q string, a string, room long, want string")
    assert [(r.want, r.got) for r in df.select("want", validation.faq_code(F.col("q"), F.col("a"), F.lit(0), F.col("room")).alias("got")).collect()] == [(w, w) for *_, w in pairs]
    files = [("1234567890", "a.PDF", "OK"), ("1234567890", "a.exe", "UNSUPPORTED_FILE_TYPE"), ("1234567890", "noend", "UNSUPPORTED_FILE_TYPE"), ("12", "a.exe", "CONTENT_TOO_SHORT")]
    df = spark.createDataFrame(files, "t string, n string, want string")
    assert all(r.got == r.want for r in df.select("want", validation.file_code(F.col("t"), F.col("n"), F.lit(0), F.lit(100)).alias("got")).collect())


def test_hsl_against_the_standard_library(spark):
    """Every hue, channels to within one step where halves round."""
    rows = [(h, s, l) for h in range(0, 361, 7) for s in (0, 13, 50, 100) for l in (0, 21, 50, 77, 100)]
    df = spark.createDataFrame(rows, "h int, s int, l int").withColumn("got", colors.to_hex(F.format_string("hsl(%d, %d%%, %d%%)", "h", "s", "l")))
    for r in df.collect():
        want = [x * 255 for x in colorsys.hls_to_rgb(r.h / 360 % 1, r.l / 100, r.s / 100)]
        assert all(abs(int(r.got[1 + 2 * k : 3 + 2 * k], 16) - want[k]) <= 0.5 + 1e-6 for k in range(3)), r
    odd = spark.createDataFrame([("hsl()",), ("hsl(1.2.3, 5%, 5%)",), ("hsl(120,100%,50%)",)], "c string").select(colors.to_hex(F.col("c")).alias("x")).collect()
    assert [r.x for r in odd] == [None, None, "#00ff00"]


def test_robots(spark):
    text = "User-agent: *\r\n SITEMAP : https://a.test/1.xml extra\rsitemap:https://a.test/2.xml\nDisallow: /sitemap: x\n#sitemap: no"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(robots_addresses(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [["https://a.test/1.xml", "https://a.test/2.xml"], None, []]
