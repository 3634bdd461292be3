"""Lookups between collections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.text import norm_question
from parlance.operators.filters import not_true
from parlance.operators.lookups import counts_by, latest, signed_in
from parlance.operators.prefix import running
from parlance.plans.registry import query
from parlance.sources.views import Views

C = F.col


@query("join_populate", """SELECT c.id, h.name AS human_name, h.status AS human_status, h.isActive AS human_active FROM convs c LEFT JOIN hagents h ON c.humanAgentId = h.id""")
def join_populate(v: Views):
    """Conversations with three columns of their human agent."""
    h = v.hagents.select(C("id").alias("humanAgentId"), C("name").alias("human_name"), C("status").alias("human_status"), C("isActive").alias("human_active"))
    return v.convs.select("id", "humanAgentId").join(h, "humanAgentId", "left").drop("humanAgentId")


@query("join_self_reply", """SELECT m.id, h.name AS human_name, a.siteName AS agent_name, r.message AS reply_message, rh.name AS reply_human_name
 FROM msgs m LEFT JOIN hagents h ON m.humanAgentId = h.id LEFT JOIN agents a ON m.agentId = a.id LEFT JOIN msgs r ON m.replyTo = r.id LEFT JOIN hagents rh ON r.humanAgentId = rh.id""")
def join_self_reply(v: Views):
    """A thread: agents of each message, the message it answers, and that one's agent."""
    h = v.hagents.select("id", "name")
    replies = v.msgs.join(h.select(C("id").alias("humanAgentId"), C("name").alias("reply_human_name")), "humanAgentId", "left").select(
        C("id").alias("replyTo"), C("message").alias("reply_message"), "reply_human_name"
    )
    return (
        v.msgs.join(h.select(C("id").alias("humanAgentId"), C("name").alias("human_name")), "humanAgentId", "left")
        .join(v.agents.select(C("id").alias("agentId"), C("siteName").alias("agent_name")), "agentId", "left")
        .join(replies, "replyTo", "left")
        .select("id", "human_name", "agent_name", "reply_message", "reply_human_name")
    )


@query("join_embed", "SELECT c.id, p.name AS visitor_name, p.location AS visitor_location FROM convs c LEFT JOIN visitors p ON c.visitor = p.id WHERE c.status = 'open'")
def join_embed(v: Views):
    """The whole visitor as a struct; two of its fields are shown."""
    p = v.visitors.select(C("id").alias("visitor"), F.struct("name", "location", "email").alias("v"))
    return v.convs.filter("status = 'open'").join(p, "visitor", "left").select("id", C("v.name").alias("visitor_name"), C("v.location").alias("visitor_location"))


@query("join_semi_signed", "SELECT id, visitor FROM convs WHERE visitor IN (SELECT id FROM visitors WHERE email IS NOT NULL)")
def join_semi_signed(v: Views):
    return signed_in(v.convs, v.visitors).select("id", "visitor")


@query("join_location", "SELECT c.id, coalesce(nullif(p.location, ''), 'UNKNOWN') AS location FROM convs c LEFT JOIN visitors p ON c.visitor = p.id")
def join_location(v: Views):
    p = v.visitors.select(C("id").alias("visitor"), "location")
    return v.convs.select("id", "visitor").join(p, "visitor", "left").select("id", F.coalesce(F.nullif("location", F.lit("")), F.lit("UNKNOWN")).alias("location"))


@query("location_hist", """SELECT coalesce(nullif(p.location, ''), 'UNKNOWN') AS location, count(*) AS conversations
 FROM convs c LEFT JOIN visitors p ON c.visitor = p.id GROUP BY 1""")
def location_hist(v: Views):
    return join_location(v).groupBy("location").agg(F.count(F.lit(1)).alias("conversations"))


@query("join_default", """SELECT a.id, coalesce(w.isActive, 1) AS widget_active FROM agents a LEFT JOIN
 (SELECT agentId, arg_max(isActive, id) AS isActive FROM widgets GROUP BY agentId) w ON a.id = w.agentId""")
def join_default(v: Views):
    """The last widget of each agent decides; without one it counts as active."""
    last = v.widgets.groupBy("agentId").agg(F.max_by("isActive", "id").alias("widget_active"))
    return v.agents.select("id").join(last, C("id") == C("agentId"), "left").select("id", F.coalesce("widget_active", F.lit(1)).cast("long").alias("widget_active"))


@query("lookup_count_agents", "SELECT userId, email, (SELECT count(*) FROM agents a WHERE a.userId = c.userId AND a.isDeleted IS DISTINCT FROM true) AS agents FROM clients c")
def lookup_count_agents(v: Views):
    n = counts_by(v.agents.filter(not_true(C("isDeleted"))), "userId", "agents")
    return v.clients.select("userId", "email").join(n, "userId", "left").fillna(0, ["agents"])


@query("lookup_count_convs", "SELECT userId, email, (SELECT count(*) FROM convs a WHERE a.userId = c.userId AND a.is_started) AS conversations FROM clients c")
def lookup_count_convs(v: Views):
    n = counts_by(v.convs.filter("is_started"), "userId", "conversations")
    return v.clients.select("userId", "email").join(n, "userId", "left").fillna(0, ["conversations"])


@query("sort_by_lookup", """SELECT userId, email, (SELECT count(*) FROM agents a WHERE a.userId = c.userId AND a.isDeleted IS DISTINCT FROM true) AS agents
 FROM clients c ORDER BY agents DESC, userId LIMIT 5 OFFSET 2""")
def sort_by_lookup(v: Views):
    return lookup_count_agents(v).orderBy(F.desc("agents"), "userId").offset(2).limit(5)


@query("client_enrich", """SELECT c.userId, coalesce(a.pages, 0) AS pages, coalesce(a.files, 0) AS files, coalesce(a.agents, 0) AS agents, coalesce(h.humans, 0) AS humans,
 coalesce(n.convs, 0) AS conversations, coalesce(p.name, 'free') AS plan_name, CASE WHEN c.isCustomLimits THEN coalesce(c.customMaxQueries, p.maxQueries, 1000) ELSE coalesce(p.maxQueries, 1000) END AS max_queries
 FROM clients c
 LEFT JOIN (SELECT userId, sum(coalesce(success, 0))::BIGINT AS pages, sum(filesAdded)::BIGINT AS files, count(*) AS agents FROM agents WHERE isDeleted IS DISTINCT FROM true GROUP BY userId) a ON a.userId = c.userId
 LEFT JOIN (SELECT userId, count(*) AS humans FROM hagents WHERE isDeleted IS DISTINCT FROM true GROUP BY userId) h ON h.userId = c.userId
 LEFT JOIN (SELECT userId, count(*) AS convs FROM convs WHERE is_started GROUP BY userId) n ON n.userId = c.userId
 LEFT JOIN plans p ON p.name = c.plan AND p.status = 'active'""")
def client_enrich(v: Views):
    """A client listing in one plan: grouped agents, humans and conversations, plan and limits."""
    live = v.agents.filter(not_true(C("isDeleted")))
    a = live.groupBy("userId").agg(F.sum(F.coalesce("success", F.lit(0))).alias("pages"), F.sum("filesAdded").alias("files"), F.count(F.lit(1)).alias("agents"))
    h = counts_by(v.hagents.filter(not_true(C("isDeleted"))), "userId", "humans")
    n = counts_by(v.convs.filter("is_started"), "userId", "conversations")
    p = v.plans.filter("status = 'active'").select(C("name").alias("plan_name"), "maxQueries")
    own = F.when(C("isCustomLimits"), C("customMaxQueries"))
    return (
        v.clients.join(a, "userId", "left").join(h, "userId", "left").join(n, "userId", "left").join(F.broadcast(p), C("plan") == C("plan_name"), "left")
        .select(
            "userId", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("pages", "files", "agents", "humans", "conversations")],
            F.coalesce("plan_name", F.lit("free")).alias("plan_name"), F.coalesce(own, "maxQueries", F.lit(1000)).alias("max_queries"),
        )
    )


@query("join_plan_fallback", """SELECT c.userId, coalesce(p.name, d.name) AS plan_name, coalesce(p.maxQueries, d.maxQueries) AS max_queries
 FROM clients c LEFT JOIN plans p ON lower(c.plan) = p.name AND p.status = 'active' CROSS JOIN (SELECT * FROM plans WHERE status = 'active' ORDER BY isDefault DESC, sort LIMIT 1) d""")
def join_plan_fallback(v: Views):
    """The named active plan, else the default one."""
    active = v.plans.filter("status = 'active'")
    d = active.orderBy(F.desc("isDefault"), "sort").limit(1).select(C("name").alias("d_name"), C("maxQueries").alias("d_max"))  # one row
    p = active.select(C("name").alias("p_name"), "maxQueries")
    return v.clients.join(F.broadcast(p), F.lower("plan") == C("p_name"), "left").join(F.broadcast(d)).select(
        "userId", F.coalesce("p_name", "d_name").alias("plan_name"), F.coalesce("maxQueries", "d_max").alias("max_queries")
    )


@query("join_latest", """SELECT c.conversation_id, m.message AS last_message FROM (SELECT DISTINCT conversation_id FROM msgs) c LEFT JOIN
 (SELECT conversation_id, arg_max(message, turn) AS message FROM msgs WHERE is_note IS DISTINCT FROM 'true' GROUP BY conversation_id) m USING (conversation_id)""")
def join_latest(v: Views):
    """Latest message that is no note, else null, in one pass."""
    spoken = F.when(~C("is_note").eqNullSafe("true"), C("turn"))
    return v.msgs.groupBy("conversation_id").agg(F.max_by("message", spoken).alias("last_message"))


@query("join_same_ip", """SELECT a.id AS id, b.id AS other FROM visitors a JOIN visitors b ON a.ip = b.ip AND a.userId = b.userId AND a.agentId = b.agentId AND b.id > a.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.id) = 1""")
def join_same_ip(v: Views):
    """Every visitor's next one from the same address: a chain through all of a group, never its pairs."""
    w = W.partitionBy("ip", "userId", "agentId").orderBy("id")
    return v.visitors.select("id", F.lead("id").over(w).alias("other")).filter("other is not null")


@query("same_ip_all", """SELECT a.id AS id, count(*) AS others, min(b.id) AS first_other FROM visitors a JOIN visitors b ON a.ip = b.ip AND a.userId = b.userId AND a.agentId = b.agentId AND a.id <> b.id GROUP BY a.id""")
def same_ip_all(v: Views):
    """Of every visitor, how many others share the address, and the first of them; a group's pairs are never made."""
    keys = ["ip", "userId", "agentId"]
    a = v.visitors.select("id", *keys)
    groups = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    rest = a.join(groups, keys).filter("n > 1")
    second = rest.filter("id <> low").groupBy(*keys).agg(F.min("id").alias("next"))
    return rest.join(second, keys).select("id", (C("n") - 1).alias("others"), F.when(C("id") == C("low"), C("next")).otherwise(C("low")).alias("first_other"))


@query("join_first_conv", """SELECT visitor, id AS first_conversation FROM (SELECT visitor, id, row_number() OVER (PARTITION BY visitor ORDER BY createdAt, id) AS r FROM convs
 WHERE is_started AND visitor IN (SELECT id FROM visitors)) WHERE r = 1""")
def join_first_conv(v: Views):
    first = v.convs.filter("is_started").groupBy("visitor").agg(F.min(F.struct("createdAt", "id")).alias("f"))
    return first.join(v.visitors.select(C("id").alias("visitor")), "visitor", "left_semi").select("visitor", C("f.id").alias("first_conversation"))


@query("join_tags", """SELECT t.id AS tag_id, t.name AS tag, c.id AS conversation, p.name AS visitor_name FROM tags t JOIN convs c ON t.conversation = c.id AND c.is_started
 LEFT JOIN visitors p ON c.visitor = p.id WHERE t.userId = 4""")
def join_tags(v: Views):
    t = v.tags.filter("userId = 4").select(C("id").alias("tag_id"), C("name").alias("tag"), "conversation")
    c = v.convs.filter("is_started").select(C("id").alias("conversation"), "visitor")
    return t.join(c, "conversation").join(v.visitors.select(C("id").alias("visitor"), C("name").alias("visitor_name")), "visitor", "left").drop("visitor")


@query("array_semi", """SELECT h.id, string_agg(cast(a.id AS VARCHAR), ',' ORDER BY a.id) AS kept FROM hagents h LEFT JOIN agents a ON a.id IN (h.a1, h.a2, h.a3) GROUP BY h.id""")
def array_semi(v: Views):
    """Assigned ids that still exist."""
    parts = v.hagents.select("id", F.explode(F.array("a1", "a2", "a3")).alias("agent"))
    there = parts.join(v.agents.select(C("id").alias("agent")), "agent", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("agent")).alias("k"))
    return v.hagents.select("id").join(there, "id", "left").select("id", F.array_join("k", ",").alias("kept"))


@query("plan_breakdown", "SELECT p.name, (SELECT count(*) FROM clients c WHERE coalesce(c.plan, 'free') = p.name) AS clients FROM plans p")
def plan_breakdown(v: Views):
    n = v.clients.groupBy(F.coalesce("plan", F.lit("free")).alias("name")).agg(F.count(F.lit(1)).alias("clients"))
    return v.plans.select("name").join(n, "name", "left").fillna(0, ["clients"])


@query("join_exact_norm", """WITH q AS (SELECT id, lower(trim(regexp_replace(regexp_replace(replace(question, '&nbsp;', ' '), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM asked),
 r AS (SELECT id, answer, lower(trim(regexp_replace(original_question, '\\s+', ' ', 'g'))) AS n FROM revised)
 SELECT q.id, min(r.id) AS revised_id FROM q JOIN r ON q.n = r.n AND r.answer <> '' GROUP BY q.id""")
def join_exact_norm(v: Views):
    """Revised answers for questions that are equal once normalised; the first one counts."""
    q = v.asked.select("id", norm_question(C("question")).alias("n"))
    r = v.revised.filter("answer <> ''").select(C("id").alias("r"), norm_question(C("original_question")).alias("n"))
    return q.join(r, "n").groupBy("id").agg(F.min("r").alias("revised_id"))


@query("join_notifications", """SELECT n.id, c.status, p.name AS visitor_name FROM notifs n LEFT JOIN convs c ON n.conversationId = c.id LEFT JOIN visitors p ON n.visitorId = p.id WHERE n.humanAgentId = 7""")
def join_notifications(v: Views):
    return (
        v.notifs.filter("humanAgentId = 7").select("id", "conversationId", "visitorId")
        .join(v.convs.select(C("id").alias("conversationId"), "status"), "conversationId", "left")
        .join(v.visitors.select(C("id").alias("visitorId"), C("name").alias("visitor_name")), "visitorId", "left")
        .select("id", "status", "visitor_name")
    )


@query("join_m2n", """SELECT h.id, string_agg(a.siteName, '|' ORDER BY a.id) AS sites FROM hagents h LEFT JOIN agents a ON a.id IN (h.a1, h.a2, h.a3) GROUP BY h.id""")
def join_m2n(v: Views):
    """Many-to-many: the sites of each human agent's assigned agents."""
    parts = v.hagents.select("id", F.explode_outer(F.array("a1", "a2", "a3")).alias("agent"))
    named = parts.join(v.agents.select(C("id").alias("agent"), "siteName"), "agent", "left").filter(C("siteName").isNotNull())
    lists = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("agent", "siteName"))).alias("s"))
    return v.hagents.select("id").join(lists, "id", "left").select("id", F.array_join(F.transform("s", lambda x: x["siteName"]), "|").alias("sites"))


@query("join_blocked", "SELECT id, name FROM visitors p WHERE EXISTS (SELECT 1 FROM blocked b WHERE b.ip = p.ip AND b.userId = p.userId AND b.expiresAt > TIMESTAMP '2024-01-25 00:00:00')")
def join_blocked(v: Views):
    now = F.lit("2024-01-25 00:00:00").cast("timestamp")
    return v.visitors.join(v.blocked.filter(C("expiresAt") > now).select("ip", "userId"), ["ip", "userId"], "left_semi").select("id", "name")


@query("join_expired_users", "SELECT c.userId, u.email AS user_email FROM clients c JOIN clients u ON c.userId = u.userId WHERE c.planExpiry <= TIMESTAMP '2025-01-20 00:00:00' AND c.plan <> 'free' AND u.isDeleted IS DISTINCT FROM true")
def join_expired_users(v: Views):
    now = F.lit("2025-01-20 00:00:00").cast("timestamp")
    users = v.clients.filter(not_true(C("isDeleted"))).select("userId", C("email").alias("user_email"))
    return v.clients.filter((C("planExpiry") <= now) & (C("plan") != "free")).select("userId").join(users, "userId")


@query("join_anti_unique", "SELECT id, name FROM hagents h WHERE NOT EXISTS (SELECT 1 FROM visitors v2 WHERE lower(v2.name) = lower(h.name)) AND NOT EXISTS (SELECT 1 FROM clients c WHERE c.userId = h.id AND c.planStatus = 'active')")
def join_anti_unique(v: Views):
    """Names that nobody has yet, and ids that no client with an active plan has."""
    names = v.visitors.select(F.lower("name").alias("n"))
    held = v.clients.filter("planStatus = 'active'").select(C("userId").alias("u"))
    return v.hagents.join(names, F.lower("name") == C("n"), "left_anti").join(held, C("id") == C("u"), "left_anti").select("id", "name")


@query("sender_name", """SELECT m.id, CASE WHEN m.sender_type = 'visitor' THEN 'Visitor' WHEN m.sender_type = 'system' THEN 'System' ELSE coalesce(h.name, a.siteName, 'AI Agent') END AS sender
 FROM msgs m LEFT JOIN hagents h ON m.humanAgentId = h.id LEFT JOIN agents a ON m.agentId = a.id""")
def sender_name(v: Views):
    """Display name of a message's sender."""
    t = C("sender_type")
    return (
        v.msgs.join(v.hagents.select(C("id").alias("humanAgentId"), "name"), "humanAgentId", "left")
        .join(v.agents.select(C("id").alias("agentId"), "siteName"), "agentId", "left")
        .select("id", F.when(t == "visitor", "Visitor").when(t == "system", "System").otherwise(F.coalesce("name", "siteName", F.lit("AI Agent"))).alias("sender"))
    )


# one row per key, repeated rows, set operations


@query("w_latest", "SELECT conversation_id, id FROM (SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY createdAt DESC, id DESC) AS r FROM msgs) WHERE r = 1")
def w_latest(v: Views):
    return latest(v.msgs, ["conversation_id"], [F.desc("createdAt"), F.desc("id")]).select("conversation_id", "id")


@query("w_first_n", "SELECT conversation_id, id FROM (SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY createdAt, id) AS r FROM msgs) WHERE r <= 12")
def w_first_n(v: Views):
    """The oldest twelve messages of each conversation."""
    return latest(v.msgs, ["conversation_id"], [C("createdAt"), C("id")], 12).select("conversation_id", "id")


@query("w_dedupe_first", "SELECT url, min(id) AS id FROM points GROUP BY url")
def w_dedupe_first(v: Views):
    return latest(v.points, ["url"], [C("id")]).select("url", "id")


@query("w_dedupe_last", "SELECT url, min(id) AS position, max(id) AS id FROM points GROUP BY url")
def w_dedupe_last(v: Views):
    """Place of the first occurrence, value of the last."""
    return v.points.groupBy("url").agg(F.min("id").alias("position"), F.max_by("id", "id").alias("id"))


@query("union_dedupe", """SELECT id, min(source) AS source FROM (SELECT id, 1 AS source FROM convs WHERE status = 'open' AND userId = 1 UNION ALL SELECT id, 2 FROM convs WHERE feedback AND userId = 1) GROUP BY id""")
def union_dedupe(v: Views):
    own = v.convs.filter("userId = 1")
    both = own.filter("status = 'open'").select("id", F.lit(1).alias("source")).unionByName(own.filter("feedback").select("id", F.lit(2).alias("source")))
    return both.groupBy("id").agg(F.min("source").alias("source"))


@query("dedupe_url", "SELECT maybe_url AS url, min(id) AS id FROM points WHERE maybe_url IS NOT NULL GROUP BY maybe_url")
def dedupe_url(v: Views):
    return latest(v.points.filter("maybe_url is not null"), ["maybe_url"], [C("id")]).select(C("maybe_url").alias("url"), "id")


@query("array_distinct", "SELECT id, concat_ws(',', a1, CASE WHEN a2 <> a1 THEN a2 END, a3) AS ids FROM (SELECT id, a1, a1 + id % 2 AS a2, a3 FROM hagents)")
def array_distinct(v: Views):
    """Distinct elements in the order of their first place."""
    return v.hagents.select("id", F.array_join(F.array_distinct(F.array(C("a1"), C("a1") + C("id") % 2, C("a3"))), ",").alias("ids"))


@query("emails_distinct", "SELECT userId, string_agg(email, ';' ORDER BY email) AS emails FROM (SELECT DISTINCT userId, email FROM visitors WHERE email IS NOT NULL) GROUP BY userId")
def emails_distinct(v: Views):
    return v.visitors.filter("email is not null").groupBy("userId").agg(F.array_join(F.array_sort(F.collect_set("email")), ";").alias("emails"))


@query("supplemental", "SELECT id FROM points WHERE user_id = 3 AND id NOT IN (SELECT id FROM points WHERE user_id = 3 AND type = 'webpage') ORDER BY id LIMIT 5")
def supplemental(v: Views):
    """Candidates that were not chosen yet."""
    own = v.points.filter("user_id = 3").select("id", "type")
    return own.join(own.filter("type = 'webpage'").select("id"), "id", "left_anti").select("id").orderBy("id").limit(5)


@query("source_dedupe", "SELECT key, min(id) AS id FROM (SELECT id, coalesce(nullif(maybe_url, ''), nullif(title, '')) AS key FROM points) WHERE key IS NOT NULL GROUP BY key")
def source_dedupe(v: Views):
    """Sources by url, else title; without either they go."""
    keyed = v.points.select("id", F.coalesce(F.nullif("maybe_url", F.lit("")), F.nullif("title", F.lit(""))).alias("key")).filter("key is not null")
    return keyed.groupBy("key").agg(F.min("id").alias("id"))


@query("array_set_ops", "SELECT id, a1 || ',' || a2 || ',' || a3 || CASE WHEN id = 7 THEN '' ELSE ',7' END AS added, a1 || ',' || a2 AS pulled FROM hagents")
def array_set_ops(v: Views):
    """Adding to a set, and pulling a value."""
    own = F.array("a1", "a2", "a3")
    return v.hagents.select("id", F.array_join(F.array_union(own, F.array(F.lit(7).cast("long"))), ",").alias("added"), F.array_join(F.array_remove(own, F.lit(999999).cast("long")), ",").alias("pulled"))


@query("distinct_visitors", "SELECT DISTINCT visitor FROM convs WHERE visitor IS NOT NULL AND userId = 5")
def distinct_visitors(v: Views):
    return v.convs.filter("userId = 5 AND visitor is not null").select("visitor").distinct()


@query("distinct_vals", "SELECT DISTINCT name FROM tags")
def distinct_vals(v: Views):
    return v.tags.select("name").distinct()


@query("w_quota_prefix", """SELECT id, userId, size, running <= 40000 AS fits, min(CASE WHEN running <= 40000 THEN 1 ELSE 0 END) OVER (PARTITION BY userId ORDER BY id ROWS UNBOUNDED PRECEDING) = 1 AS admitted
 FROM (SELECT id, userId, strlen(content) AS size, sum(strlen(content)) OVER (PARTITION BY userId ORDER BY id ROWS UNBOUNDED PRECEDING) AS running FROM tdocs)""")
def w_quota_prefix(v: Views):
    """Documents are admitted in order until the first overflow."""
    sized = v.tdocs.select("id", "userId", F.octet_length("content").cast("long").alias("size"))
    # sizes are not negative: what comes behind an overflow does not fit either
    fits = running(sized, ["userId"], [C("id").asc()], {"so_far": C("size")}).withColumn("fits", C("so_far") <= 40000)
    return fits.select("id", "userId", "size", "fits", C("fits").alias("admitted"))


@query("w_footer_once", """SELECT id, regexp_extract(url, '://([^/]*)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]*)', 1) ORDER BY id) = 1 AS keeps_footer FROM webpages""")
def w_footer_once(v: Views):
    """The first page of a host keeps its footer."""
    host = F.regexp_extract("url", "://([^/]*)", 1)
    return v.webpages.select("id", host.alias("host")).withColumn("keeps_footer", F.row_number().over(W.partitionBy("host").orderBy("id")) == 1)


@query("w_plan_rank", "SELECT id, userId, row_number() OVER (PARTITION BY userId ORDER BY sort, id) AS rank FROM offers WHERE status = 'active'")
def w_plan_rank(v: Views):
    """Place of each plan among those that its tenant offers."""
    offered = v.offers.filter("status = 'active'").select("id", "userId", "sort")
    return running(offered, ["userId"], [C("sort").asc(), C("id").asc()], {"rank": F.lit(1).cast("long")}).select("id", "userId", "rank")


@query("w_duration", """SELECT conversation_id, date_diff('second', min(CASE WHEN r = 2 THEN createdAt END), max(createdAt)) AS seconds FROM
 (SELECT conversation_id, createdAt, row_number() OVER (PARTITION BY conversation_id ORDER BY createdAt, id) AS r FROM msgs) GROUP BY conversation_id""")
def w_duration(v: Views):
    """Seconds from the second message to the last."""
    w = W.partitionBy("conversation_id").orderBy("createdAt", "id")
    second = F.min(F.when(C("r") == 2, C("createdAt"))).cast("long")
    return v.msgs.withColumn("r", F.row_number().over(w)).groupBy("conversation_id").agg((F.max("createdAt").cast("long") - second).alias("seconds"))


@query("w_numbered", """SELECT user_id, string_agg(r || '. ' || title || ' - ' || url, chr(10) ORDER BY r) AS listed FROM
 (SELECT user_id, title, url, row_number() OVER (PARTITION BY user_id ORDER BY id) AS r FROM points) WHERE r <= 5 GROUP BY user_id""")
def w_numbered(v: Views):
    """A numbered list of the first five items of each owner."""
    top = v.points.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("id"))).filter("r <= 5")
    line = F.concat(C("r").cast("string"), F.lit(". "), "title", F.lit(" - "), "url")
    return top.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))).alias("x")).select("user_id", F.array_join(F.transform("x", lambda y: y["l"]), "\n").alias("listed"))
