"""Scans, filters and projections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.operators.filters import (
    all_of, any_of, closed, contains_any, differs, half_open, not_true, status_filter, truthy, type_filter, words_match,
)
from parlance.plans.registry import query
from parlance.sources.views import Views

C = F.col


@query("scan_filter", "SELECT id, status, score FROM convs WHERE userId = 3 AND status = 'open'")
def scan_filter(v: Views):
    """Collection scan with a conjunctive filter."""
    return v.convs.filter((C("userId") == 3) & (C("status") == "open")).select("id", "status", "score")


@query("point_lookup", "SELECT id, name, email FROM visitors WHERE id = 42 ORDER BY id LIMIT 1")
def point_lookup(v: Views):
    """One row by key; absent gives no row."""
    return v.visitors.filter(C("id") == 42).orderBy("id").limit(1).select("id", "name", "email")


@query("scroll_scan", "SELECT id, url, title, text FROM points WHERE user_id = 4")
def scroll_scan(v: Views):
    """A whole collection under a payload filter; paging is partitioning here."""
    return v.points.filter(C("user_id") == 4).select("id", "url", "title", "text")


@query("legacy_align", "SELECT id, coalesce(nullif(agentName, ''), siteName, 'right') AS align FROM agents")
def legacy_align(v: Views):
    """A legacy field, else its successor, else a constant."""
    return v.agents.select("id", F.coalesce(truthy(C("agentName")), "siteName", F.lit("right")).alias("align"))


@query("filter_eq", "SELECT id FROM convs WHERE userId = 3 AND agentId = 13 AND status = 'close'")
def filter_eq(v: Views):
    return v.convs.filter((C("userId") == 3) & (C("agentId") == 13) & (C("status") == "close")).select("id")


@query("filter_range_halfopen", "SELECT id FROM convs WHERE createdAt >= TIMESTAMP '1996-01-01 00:00:00' AND createdAt < TIMESTAMP '1997-01-01 00:00:00'")
def filter_range_halfopen(v: Views):
    at = C("createdAt")
    return v.convs.filter(half_open(at, F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00")))).select("id")


@query("filter_range_closed", "SELECT id FROM convs WHERE createdAt BETWEEN TIMESTAMP '1995-03-01 00:00:00' AND TIMESTAMP '1995-09-30 00:00:00'")
def filter_range_closed(v: Views):
    at = C("createdAt")
    return v.convs.filter(closed(at, F.to_timestamp_ntz(F.lit("1995-03-01 00:00:00")), F.to_timestamp_ntz(F.lit("1995-09-30 00:00:00")))).select("id")


@query("filter_optional", "SELECT id, tokens FROM llm_usage WHERE date >= TIMESTAMP '2024-01-10 00:00:00'")
def filter_optional(v: Views):
    """Bounds and owner apply only if they are given; here only a start is."""
    owner, start, end = None, F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")), None
    return v.llm_usage.filter(all_of(C("userId") == owner if owner is not None else None, closed(C("date"), start, end))).select("id", "tokens")


@query("filter_in", "SELECT id, trainingStatus FROM tdocs WHERE trainingStatus IN (1, 2)")
def filter_in(v: Views):
    return v.tdocs.filter(C("trainingStatus").isin(1, 2)).select("id", C("trainingStatus"))


@query("filter_ne_nullsafe", "SELECT id FROM convs WHERE visitorClosed IS DISTINCT FROM true")
def filter_ne_nullsafe(v: Views):
    return v.convs.filter(not_true(C("visitorClosed"))).select("id")


@query("filter_notnull", "SELECT id, humanAgentId FROM convs WHERE humanAgentId IS NOT NULL")
def filter_notnull(v: Views):
    return v.convs.filter(C("humanAgentId").isNotNull()).select("id", "humanAgentId")


@query("filter_or", "SELECT userId, plan FROM clients WHERE planStatus = 'inactive' OR plan = 'free' OR totalAmountPaid < 0")
def filter_or(v: Views):
    return v.clients.filter(any_of(C("planStatus") == "inactive", C("plan") == "free", C("totalAmountPaid") < 0)).select("userId", "plan")


@query("filter_word_or_regex", "SELECT id, name FROM visitors WHERE userId = 2 AND (regexp_matches(name, '(?i)00012') OR regexp_matches(name, '(?i)7$'))")
def filter_word_or_regex(v: Views):
    """Tenant and any word of the search as a pattern."""
    return v.visitors.filter((C("userId") == 2) & words_match("00012 7$", C("name"))).select("id", "name")


@query("filter_contains_any", "SELECT id FROM tdocs WHERE contains(lower(content), 'the') OR contains(lower(title), 'title 1') OR coalesce(contains(lower(url), 'site7'), false)")
def filter_contains_any(v: Views):
    hit = any_of(*[contains_any(t, C(c)) for t, c in (("THE", "content"), ("Title 1", "title"), ("site7", "url"))])
    return v.tdocs.filter(hit).select("id")


@query("filter_contains_client", "SELECT userId, email FROM clients WHERE contains(lower(email), 'client1') OR coalesce(contains(lower(plan), 'client1'), false)")
def filter_contains_client(v: Views):
    return v.clients.filter(contains_any("Client1", C("email"), C("plan"))).select("userId", "email")


@query("filter_regex_plan", "SELECT id, name FROM offers WHERE regexp_matches(name, '(?i)^(A1|b)') OR regexp_matches(status, '(?i)^(INA)')")
def filter_regex_plan(v: Views):
    return v.offers.filter(C("name").rlike("(?i)^(A1|b)") | C("status").rlike("(?i)^(INA)")).select("id", "name")


@query("filter_array_contains", "SELECT id, name FROM hagents WHERE list_contains([a1, a2, a3], 30)")
def filter_array_contains(v: Views):
    return v.hagents.filter(F.array_contains(F.array("a1", "a2", "a3"), F.lit(30).cast("long"))).select("id", "name")


@query("filter_nested", "SELECT id FROM tdocs WHERE url = 'https://www.site3.example.com/p/1'")
def filter_nested(v: Views):
    """A predicate on a field inside a struct."""
    nested = v.tdocs.select("id", F.struct("url", "content").alias("webPage"))
    return nested.filter(C("webPage.url") == "https://www.site3.example.com/p/1").select("id")


@query("project_select", "SELECT id, userId, name, location FROM visitors")
def project_select(v: Views):
    return v.visitors.drop("email", "ip", "agentId", "balance")


@query("project_struct", "SELECT id, name, maxQueries AS limits_queries, maxAgents AS limits_agents, sort AS position FROM offers WHERE status = 'active'")
def project_struct(v: Views):
    """A public shape rebuilt as a struct, flattened for the result."""
    shaped = v.offers.filter("status = 'active'").select("id", "name", F.struct(C("maxQueries").alias("queries"), C("maxAgents").alias("agents")).alias("limits"), C("sort").alias("position"))
    return shaped.select("id", "name", C("limits.queries").alias("limits_queries"), C("limits.agents").alias("limits_agents"), "position")


@query("filter_label_code", "SELECT id, type, trainingStatus FROM tdocs WHERE type = 2 AND trainingStatus IN (1, 2)")
def filter_label_code(v: Views):
    """A label's type code, and the default statuses for an unknown label."""
    return v.tdocs.filter(type_filter("Snippets", C("type")) & status_filter("All", C("trainingStatus"))).select("id", "type", "trainingStatus")


@query("filter_dynamic", "SELECT id FROM convs WHERE status = 'close' AND feedback = true AND aiChat = true")
def filter_dynamic(v: Views):
    """Predicates from a dictionary of chosen filters."""
    chosen = {"status": "close", "feedback": True, "aiChat": True, "agentId": None}
    return v.convs.filter(all_of(*[C(k) == F.lit(x) for k, x in chosen.items() if x is not None])).select("id")


@query("filter_cross_field", "SELECT id, success, failed, total FROM agents WHERE success + failed < total AND isDeleted IS DISTINCT FROM true")
def filter_cross_field(v: Views):
    return v.agents.filter((C("success") + C("failed") < C("total")) & not_true(C("isDeleted"))).select("id", "success", "failed", "total")


@query("coalesce_falsy", "SELECT id, coalesce(failed, 0) AS failed, coalesce(nullif(agentName, ''), siteName) AS shown, coalesce(nullif(filesAdded, 0), -1) AS files FROM agents")
def coalesce_falsy(v: Views):
    """Defaults for null, and for values that count as false."""
    return v.agents.select(
        "id", F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce(truthy(C("agentName")), "siteName").alias("shown"),
        F.coalesce(truthy(C("filesAdded"), "number"), F.lit(-1)).cast("long").alias("files"),
    )


@query("filter_keyword_any", "SELECT DISTINCT id FROM points, (VALUES ('title 1'), ('/3'), ('text 44')) AS w(k) WHERE contains(lower(url), k) OR contains(lower(title), k) OR contains(lower(text), k)")
def filter_keyword_any(v: Views):
    """Any keyword inside any field."""
    words = F.array(*[F.lit(w) for w in ("title 1", "/3", "text 44")])
    return v.points.filter(F.exists(words, lambda k: any_of(*[F.lower(c).contains(k) for c in ("url", "title", "text")]))).select("id")


@query("filter_payload", "SELECT id FROM points WHERE user_id = 2 AND type = 'webpage'")
def filter_payload(v: Views):
    return v.points.filter((C("user_id") == 2) & (C("type") == "webpage")).select("id")


@query("clean_urls", """SELECT url, min(id) AS position FROM (SELECT id, trim(url) AS url FROM webpages)
 WHERE url LIKE 'http%' AND url <> '' GROUP BY url""")
def clean_urls(v: Views):
    """Trimmed http urls, each once, with their first position."""
    trimmed = v.webpages.select("id", F.trim("url").alias("url"))
    return trimmed.filter(C("url").startswith("http")).groupBy("url").agg(F.min("id").alias("position"))


@query("filter_webpages", "SELECT id, url FROM tdocs WHERE type = 0 AND url IS NOT NULL")
def filter_webpages(v: Views):
    return v.tdocs.filter((C("type") == 0) & C("url").isNotNull()).select("id", "url")


@query("filter_expired", "SELECT userId, plan FROM clients WHERE planExpiry IS NOT NULL AND planExpiry <= TIMESTAMP '2025-01-20 00:00:00' AND plan <> 'free'")
def filter_expired(v: Views):
    """Expired and not on the default plan; the strict comparison leaves out missing plans."""
    now = F.lit("2025-01-20 00:00:00").cast("timestamp")
    return v.clients.filter(C("planExpiry").isNotNull() & (C("planExpiry") <= now) & (C("plan") != "free")).select("userId", "plan")


@query("filter_transcript", "SELECT id FROM msgs WHERE is_note IS DISTINCT FROM 'true' AND sender_type IS DISTINCT FROM 'agent-connect' AND sender_type IS DISTINCT FROM 'system'")
def filter_transcript(v: Views):
    return v.msgs.filter(differs(C("is_note"), "true") & differs(C("sender_type"), "agent-connect") & differs(C("sender_type"), "system")).select("id")


@query("open_conversation", "SELECT id, visitor FROM convs WHERE status = 'open' AND visitorClosed IS DISTINCT FROM true AND visitor = 37")
def open_conversation(v: Views):
    return v.convs.filter((C("status") == "open") & not_true(C("visitorClosed")) & (C("visitor") == 37)).select("id", "visitor")


@query("filter_score", "SELECT id, score FROM convs WHERE score >= 200000")
def filter_score(v: Views):
    return v.convs.filter(C("score") >= 200000).select("id", "score")


# sorting, paging, top rows


@query("sort_desc", "SELECT id, score FROM convs WHERE agentId = 5 ORDER BY score DESC, id")
def sort_desc(v: Views):
    return v.convs.filter("agentId = 5").select("id", "score").orderBy(F.desc("score"), "id")


@query("sort_multi", "SELECT id, name, sort AS position FROM offers ORDER BY sort ASC, name DESC")
def sort_multi(v: Views):
    return v.offers.orderBy("sort", F.desc("name")).select("id", "name", C("sort").alias("position"))


@query("page_offset", """SELECT id, title, (SELECT count(*) FROM tdocs WHERE type = 0) AS total,
 (SELECT cast(ceil(count(*) / 20.0) AS BIGINT) FROM tdocs WHERE type = 0) AS pages FROM tdocs WHERE type = 0 ORDER BY id DESC LIMIT 20 OFFSET 40""")
def page_offset(v: Views):
    """The third page of 20, with the total and the number of pages."""
    rows = v.tdocs.filter("type = 0")
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    page = rows.select("id", "title").orderBy(F.desc("id")).offset(40).limit(20)
    return page.join(F.broadcast(total)).withColumn("pages", F.ceil(C("total") / 20.0).cast("long"))


@query("sort_dynamic", "SELECT userId, email, currentDataSize FROM clients ORDER BY currentDataSize DESC, userId LIMIT 10")
def sort_dynamic(v: Views):
    """A sort field from a list of allowed ones, else the creation time."""
    allowed = {"dataSize": "currentDataSize", "email": "email", "createdAt": "createdAt"}
    return v.clients.orderBy(F.desc(allowed.get("dataSize", "createdAt")), "userId").limit(10).select("userId", "email", "currentDataSize")


@query("topk", "SELECT id, score FROM convs ORDER BY score DESC, id LIMIT 5")
def topk(v: Views):
    return v.convs.select("id", "score").orderBy(F.desc("score"), "id").limit(5)


@query("slice_cap", """SELECT userId, string_agg(cast(id AS VARCHAR), ',' ORDER BY id) AS firsts FROM
 (SELECT userId, id, row_number() OVER (PARTITION BY userId ORDER BY id) AS r FROM tdocs) WHERE r <= 3 GROUP BY userId""")
def slice_cap(v: Views):
    """The first three ids of each owner."""
    first = v.tdocs.withColumn("r", F.row_number().over(W.partitionBy("userId").orderBy("id"))).filter("r <= 3")
    return first.groupBy("userId").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("firsts"))


@query("default_plan", "SELECT userId, arg_min(name, (CASE WHEN isDefault THEN 0 ELSE 1 END, sort, id)) AS name FROM offers WHERE status = 'active' GROUP BY userId")
def default_plan(v: Views):
    """Each tenant's plan for new clients: the default one, else the first of those on offer."""
    first = F.struct(F.when(C("isDefault"), 0).otherwise(1), "sort", "id")
    return v.offers.filter("status = 'active'").groupBy("userId").agg(F.min_by("name", first).alias("name"))


@query("active_plans", "SELECT id, userId, name, sort AS position, maxQueries FROM offers WHERE status = 'active' ORDER BY userId, sort, id")
def active_plans(v: Views):
    return v.offers.filter("status = 'active'").orderBy("userId", "sort", "id").select("id", "userId", "name", C("sort").alias("position"), "maxQueries")
