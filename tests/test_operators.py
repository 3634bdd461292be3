"""Properties, edge cases and plans of the library's operators."""

import datetime as dt

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import dates, text
from parlance.operators import state
from parlance.operators.ingest import markdown, split
from parlance.operators.lookups import latest
from parlance.plans import QUERIES
from parlance.sources.views import Views
from parlance.streaming.messages import conversation_state, handoffs, limited, not_expired, throttled


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=900), st.integers(20, 60))
def test_split_keeps_all_words(t, size):
    pieces = split(t, size, 5)
    assert all(len(p) <= size for p in pieces)
    assert set("".join(t.split())) == set("".join("".join(pieces).split()))


def test_split_overlaps():
    words = " ".join(f"w{k}" for k in range(2000))
    pieces = split(words)
    assert all(len(p) <= 2000 for p in pieces) and len(pieces) > 4
    assert all(a.split()[-1] in b.split() for a, b in zip(pieces, pieces[1:]))
    assert {w for p in pieces for w in p.split()} == set(words.split())


def test_markdown():
    page = "<h1>T</h1><script>x</script><p>a &amp; <a href='/b'>l</a></p><div class='ad'>no</div>"
    got, footer = markdown("https://h.test/x", page)
    assert "# T" in got and "a & [l](https://h.test/b)" in got and "no" not in got and "x<" not in got and footer == ""
    for page in ("<p class='ad'>buy</p><p>rest</p>", "<span class='x ad'><b>buy</b></span><p>rest</p>", "<div><p class=ad>buy</div><p>rest", "<ul class=popup><li>buy<li>now</ul>rest", "<form><div>buy</form>rest"):
        assert markdown("", page)[0].split() == ["rest"], page
    got, footer = markdown("https://h.test/d/x", "<p>a</p><img src=i.png alt=' pic '><a href='y'></a><footer>one <a href=/t>t</a></footer><footer>two</footer>")
    assert got.split() == ["a", "Image", "(pic):", "https://h.test/d/i.png", "[Link:", "https://h.test/d/y](https://h.test/d/y)", "two"] and footer.split() == ["one", "[t](https://h.test/t)"]


def test_links_are_resolved(spark):
    from urllib.parse import urljoin

    from parlance.operators.ingest import links_of, origin_of, resolved

    bases = ["https://h.test", "https://h.test/", "https://H.test/a/b?q#f", "http://h.test/a/b/c/", "h.test/x", ""]
    links = ["/x", "y", "../z", "./w?q=1", "?p=2", "#top", "//other.test/x", "https://h.test/abs", "mailto:a@b.test", "../../../up", "a/../b/./c", "..", "d/"]
    df = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, x string")
    for r in df.select("b", "x", resolved(F.col("b"), F.col("x")).alias("r")).collect():
        assert r.r == (urljoin(r.b, r.x) if "://" in r.b else None), (r.b, r.x)
    page = "<a href=\"/1\">x</a><a class=c href='2'>y</a><A HREF=3>z</A><link href='/no'><a name=n>n</a><a href=' '>w</a><a\nhref=https://h.test.evil/x>e</a>"
    got = spark.createDataFrame([(page,)], "p string").select(F.explode(links_of(F.col("p"))).alias("x")).collect()
    assert [r.x for r in got] == ["/1", "2", "3", "https://h.test.evil/x"]
    origins = spark.createDataFrame([("https://h.test.evil/x",), ("HTTPS://H.test?x",)], "u string").select(origin_of(F.col("u")).alias("o")).collect()
    assert [r.o for r in origins] == ["https://h.test.evil", "https://h.test"]


def test_nested_sitemaps(spark):
    from parlance.operators.ingest import sitemap_addresses

    index = lambda *x: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in x) + "</sitemapindex>"
    urls = lambda *x: "<urlset>" + "".join(f"<url><loc>\n {u} </loc></url>" for u in x) + "</urlset>"
    docs = [("r", index("a", "b", "missing")), ("a", index("c", "r")), ("b", urls("http://1", "ftp://2")), ("c", urls("http://1", "http://3?a&amp;b")), ("s", urls("http://4"))]
    got = sitemap_addresses(spark.createDataFrame(docs, "url string, xml string"), spark.createDataFrame([("r",), ("s",), ("none",)], "root string")).collect()
    assert {tuple(r) for r in got} == {("r", "http://1"), ("r", "http://3?a&b"), ("s", "http://4")} and len(got) == 3


@pytest.mark.parametrize("base,months,want", [
    ("2024-01-31 10:00:00", 1, "2024-03-02 10:00:00"), ("2023-01-31 00:00:00", 1, "2023-03-03 00:00:00"),
    ("2024-03-31 00:00:00", 1, "2024-05-01 00:00:00"), ("2024-12-31 05:00:00", 2, "2025-03-03 05:00:00"), ("2024-01-15 00:00:00", 12, "2025-01-15 00:00:00"),
])
def test_months_overflow(spark, base, months, want):
    row = spark.range(1).select(dates.add_months_overflow(F.lit(base).cast("timestamp"), F.lit(months)).cast("string")).first()
    assert row[0] == want


def test_token_budget(spark):
    cases = {"10 best t-shirts links": 1700, "hello": 200, "list all urls": 950, "compare them": 400, "explain the difference": 600}
    df = spark.createDataFrame(list(cases.items()), "q string, n long")
    assert all(r.n == r.t for r in df.select("n", text.max_tokens(F.col("q")).alias("t")).collect())


def test_nulls_in_text_functions(spark):
    df = spark.createDataFrame([(None,), ("",), ("  A  b",)], "c string")
    for f in (text.norm_question, text.is_greeting, text.is_accidental, text.is_agent_request, text.max_tokens, text.word_count, text.strip_html):
        assert all(r[0] is not None for r in df.select(f(F.col("c"))).collect())
    assert df.select(text.norm_question(F.col("c"))).collect()[2][0] == "a b"


def test_fold_ignores_arrival(spark):
    rows = [(1, 3, None, 1), (1, 1, "a", 1), (1, 2, "b", 1), (2, 1, None, 5)]
    for r in (rows, rows[::-1]):
        got = state.fold(spark.createDataFrame(r, "k long, t long, v string, n long"), "k", ["t"], ["v"], ["n"]).orderBy("k").collect()
        assert [tuple(x) for x in got] == [(1, "b", 3), (2, None, 5)]
    rows = [(1, 1, "a", False), (1, 2, None, True), (2, 1, None, True), (2, 2, "b", False), (3, 1, "c", False), (3, 2, None, False)]
    got = state.fold(spark.createDataFrame(rows, "k long, t long, v string, gone boolean"), "k", ["t"], ["v"], [], {"v": "gone"}).orderBy("k").collect()
    assert [tuple(x) for x in got] == [(1, None), (2, "b"), (3, "c")]


def test_latest_is_idempotent(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1)], "k long, t long")
    one = latest(df, ["k"], [F.desc("t")])
    assert one.count() == 2 and latest(one, ["k"], [F.desc("t")]).count() == 2


def test_quota_never_exceeds(spark, sf_dir):
    rows = QUERIES["w_quota_prefix"](spark, sf_dir).filter("admitted").groupBy("userId").agg(F.sum("size").alias("s")).collect()
    assert rows and all(r.s <= 40000 for r in rows)


def test_topk_is_in_the_scan(spark, sf_dir):
    ids = {r.id for r in Views(spark, sf_dir).points.filter("user_id = 3").collect()}
    top = [r.id for r in QUERIES["vector_topk"](spark, sf_dir).collect()]
    assert len(top) == 5 and set(top) <= ids


def test_policy_keeps_all_hits_of_relevant_owners(spark, sf_dir):
    assert QUERIES["threshold_policy"](spark, sf_dir).filter("NOT irrelevant AND NOT kept").count() == 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    assert "PushedFilters: [IsNotNull" in plan_of(QUERIES["filter_eq"](spark, sf_dir)) or "PushedFilters" in plan_of(QUERIES["filter_eq"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan_of(QUERIES["topk"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan_of(QUERIES["seed_limits"](spark, sf_dir))
    assert plan_of(QUERIES["global_counts"](spark, sf_dir)).count("FileScan") == 1


def test_rate_limit(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t + dt.timedelta(seconds=k)) for k in range(60)] + [("b", t)], "ip string, ts timestamp")
    got = {r.ip: r.limited for r in limited(df, 50).collect() if r.requests > 50 or r.ip == "b"}
    assert got == {"a": True, "b": False}


def run_stream(spark, tmp_path, frames, schema, make, name, mode):
    folder = str(tmp_path / name)
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(folder)
    make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-c")).start().awaitTermination()
    return spark.table(name)


def test_conversation_stream(spark, tmp_path):
    frames = [[(1, "visitor", "a", 1), (1, "ai", "b", 2)], [(1, "visitor", "c", 3), (2, "visitor", "x", 1)], [(1, "seen", "", 4)]]
    got = run_stream(spark, tmp_path, frames, "conversation_id long, sender_type string, message string, seq long", conversation_state, "convstate", "update")
    last = {}
    for r in got.orderBy("last_seq", F.desc("unread")).collect():
        last[r.conversation_id] = (r.messages, r.unread, r.started, r.last_message)
    assert last == {1: (3, 0, True, "c"), 2: (1, 1, False, "x")}


def test_handoff_timer(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    frames = [[(1, "request", at(0)), (2, "request", at(1))], [(1, "accept", at(5))], [(3, "request", at(100))], [(3, "accept", at(101))]]
    got = run_stream(spark, tmp_path, frames, "conversation_id long, kind string, ts timestamp", lambda s: handoffs(s.withWatermark("ts", "1 second")), "handoff", "append")
    assert {(r.conversation_id, r.outcome) for r in got.collect()} == {(1, "accepted"), (2, "apology"), (3, "accepted")}


def test_colours(spark):
    from parlance.functions import colors

    cases = [("hsl(0,0%,50%)", "#808080"), ("hsl(210, 100%, 40%)", "#0066cc"), ("hsla(120,50%,75%,.5)", "#9fdf9f"), ("hsl(300, 60%, 20%)", "#521452"), ("#AbC", "#aabbcc"), ("rgb(300,0,7)", "#ff0007"), ("red", None), ("hsl(1)", None), (None, None)]
    df = spark.createDataFrame(cases, "c string, want string")
    assert [r.h for r in df.select(colors.to_hex(F.col("c")).alias("h")).collect()] == [w for _, w in cases]
    page = (
        "<meta content='#0a64c8' name='theme-color'><style>a{color:#c80a0a} b{background : rgb(10,200,10); margin:0} i{background-color:#ffffff;border:#808080}</style>"
        "<p>color: #00ff00</p><STYLE type=x>u{fill:#c80a0a;stroke:hsl(300, 60%, 40%)} v{xcolor:#123456}</STYLE>"
    )
    got = spark.createDataFrame([(page,), ("",), (None,)], "p string").select(colors.brand_colors(F.col("p")).alias("x")).collect()
    assert [tuple(x) for x in got[0].x] == [("#0a64c8", 30), ("#c80a0a", 4), ("#0ac80a", 3), ("#a329a3", 1)] and not got[1].x and not got[2].x


def test_throttled_progress(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    row = lambda job, s, k, n=9: (job, t + dt.timedelta(seconds=s), k, n)
    frames = [[row(1, 0, 0), row(1, 1, 1), row(1, 2.5, 2), row(2, 0, 0, 2)], [row(1, 3, 3), row(1, 4.6, 4), row(2, 0.1, 1, 2)], [row(1, 5, 9), row(2, 0.2, 2, 2)]]
    got = run_stream(spark, tmp_path, frames, "job long, ts timestamp, current long, total long", throttled, "throttle", "append")
    assert {(r.job, r.current) for r in got.collect()} == {(1, 0), (1, 2), (1, 4), (1, 9), (2, 0), (2, 2)}


def test_blocks_expire(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 3)), (3, None)], "id long, expiresAt timestamp")
    assert [r.id for r in not_expired(df, F.lit("2024-01-02").cast("timestamp")).collect()] == [2]


def test_forms(spark):
    from parlance.functions.forms import Field, errors

    cases = [("a@b.c", "+1 (234)-5", "1.5", "https://h.test/x", ""), ("no", "0", "x", "h.test", "n"), (None, "", " ", "mailto:a@b", "n n")]
    want = [
        ["N is missing"], ["E is no e-mail address", "E has fewer than 3 characters", "T is no phone number", "C is no number", "U is no address"],
        ["E is missing", "N has another form"],
    ]
    df = spark.createDataFrame(cases, "e string, t string, c string, u string, n string")
    fields = [Field("E", "email", True, 3), Field("T", "tel"), Field("C", "number"), Field("U", "url"), Field("N", "text", True, None, 5, r"^\S*$")]
    assert [r.x for r in df.select(errors(list(zip(fields, map(F.col, "etcun")))).alias("x")).collect()] == want


def test_chunks_and_get_or_create(spark, sf_dir):
    """Chunk queries against the plain splitter, and rows made or patched."""
    rows = Views(spark, sf_dir).tdocs.select("id", "content").collect()
    plain = {r.id: split(r.content or "") for r in rows}
    got = QUERIES["split_chunks"](spark, sf_dir).collect()
    assert {(r.id, r.chunk_index): (r.chunk, r.total_chunks) for r in got} == {(i, k): (c, len(x)) for i, x in plain.items() for k, c in enumerate(x)}
    assert {r.id: (r.chunks, r.chars) for r in QUERIES["chunk_counts"](spark, sf_dir).collect()} == {i: (len(x), sum(map(len, x))) for i, x in plain.items() if x}
    old = spark.createDataFrame([(1, 7), (2, None), (3, 5)], "k long, a long")
    asked = spark.createDataFrame([(1, 7), (2, 9), (4, None), (5, 1)], "k long, a long")
    assert sorted(map(tuple, state.get_or_create(old, asked, "k", "a").collect()), key=lambda r: r[0]) == [
        (1, 7, False, False), (2, 9, False, True), (3, 5, False, False), (4, None, True, False), (5, 1, True, False)
    ]


def test_pandas_has_no_part_in_simple_plans(spark, sf_dir):
    assert isinstance(QUERIES["csat"](spark, sf_dir).toPandas(), pd.DataFrame)
    assert "Python" not in plan_of(QUERIES["dashboard_tenant"](spark, sf_dir))


def test_files(spark, tmp_path):
    from parlance.sources.files import read_documents

    for name, body in (("a.txt", "x\r\n\r\n\r\n\r\ny\tz"), ("b.md", "   "), ("c.bin", "q")):
        (tmp_path / name).write_text(body, newline="")
    got = {r.path.rsplit("/", 1)[1]: (r.error, r.content) for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (None, "x\n\ny z"), "b.md": ("EMPTY", None), "c.bin": ("UNSUPPORTED", None)}
