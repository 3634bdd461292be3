"""Scalar queries over literal edge cases, against their oracles over the same rows."""

import pytest

from harness import connect, difference
from parlance.plans import QUERIES
from parlance.plans.registry import OVER_VIEWS
from parlance.sources import views

EDGES = {
    "questions": (
        "id, q",
        "(1, 'hi'), (2, 'hi there'), (3, 'hi!'), (4, 'hint'), (5, 'aaaabbbbaaaabbbba'), (6, 'asdfasdf'), (7, '10 best t-shirts links'), "
        "(8, 'list all urls'), (9, 'agent'), (10, ''), (11, NULL), (12, 'Explain how it works in full'), (13, 'top 3 pages please'), "
        "(14, 'what is the price of shipping'), (15, 'Good Morning team'), (16, 'I want to talk to a real person'), (17, 'show me 25 items'), "
        "(18, 'compare plans'), (19, 'a--b c_d  é'), (20, 'give me 0 links'), (21, 'Asdfasdf'), (22, 'ASDFASDF'), (23, 'id 12345678901234567890123 or 7'), "
        "(24, ' AbAbAbAbAbAbA '), (25, 'call 0005 or 6'), (26, 'order 12345678901 and 2')",
    ),
    "hosts": (
        "id, u",
        "(1, 'https://www.a.co.uk/x'), (2, 'a.com'), (3, '//a.b.com'), (4, 'localhost'), (5, 'not a url'), (6, ''), (7, 'http://shop.example.com.au:80/p?q=1'), (8, 'https://x.org/a/b')",
    ),
    "shades": (
        "id, c",
        "(1, '#abc'), (2, '#AABBCC'), (3, 'rgb(300,0,0)'), (4, '#f0f0f2'), (5, '#101010'), (6, '#808285'), (7, 'rgb(10, 120, 200)'), (8, 'red'), (9, '#ffd700')",
    ),
    "snippets": (
        "id, t",
        "(1, '<p>Price?</p>'), (2, 'price?'), (3, 'PRICE?&nbsp;'), (4, 'a  <b>b</b> &amp;lt; &quot;x&quot;'), (5, ''), (6, NULL), (7, '&lt;i&gt; it&#39;&#39;s'), (8, ' x <br/> y ')",
    ),
}
NAMES = [n for n, sql in OVER_VIEWS.items() if any(f"FROM {e}" in sql for e in EDGES)]


def test_all_edges_are_met():
    assert len(NAMES) >= 19


@pytest.mark.parametrize("name", sorted(NAMES))
def test_edges(spark, sf_dir, monkeypatch, name):
    for table, rows in EDGES.items():
        monkeypatch.setitem(views.LITERALS, table, rows)
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), views.with_views(OVER_VIEWS[name])) == ""


def test_fixed_answers(spark, sf_dir, monkeypatch):
    """What the platform says to a few of them, not by the oracles."""
    for table, rows in EDGES.items():
        monkeypatch.setitem(views.LITERALS, table, rows)
    got = lambda name, column: {r["id"]: r[column] for r in QUERIES[name](spark, sf_dir).collect()}
    hits = got("is_accidental", "hit")
    assert [hits[k] for k in (5, 6, 21, 22, 24, 3)] == [True, True, False, True, True, False]
    counts = got("requested_count", "n")
    assert [counts[k] for k in (7, 20, 25, 26, 1)] == [10, 5, 5, 12345678901, 5] and counts[23] == 10**18 - 1
    assert got("contrast_text", "ink")[2] == "#1F2937" and got("contrast_text", "ink")[5] == "#FFFFFF"


def test_spam_and_repetition(spark):
    from pyspark.sql import functions as F

    from parlance.functions import text

    cases = [("buy buy buy now and then", True), ("to to to to be", False), ("", False), (None, False), ("A" * 101, True), ("one two three four", False), ("wow!! " * 6 + " a b c d e f g h i j k l m n o p q r s t", True)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert all(r.s == r.want for r in df.select("want", text.spam(F.col("t")).alias("s")).collect())
