"""Counts, sums, dashboards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import dates, text
from parlance.operators.filters import not_true
from parlance.operators.lookups import by_key, counts_by, signed_in
from parlance.operators.metrics import count_where, rounded, share, total, zero_filled_days
from parlance.operators.prefix import running
from parlance.plans.registry import query
from parlance.plans.scalars import WINDOW_SQL, _plus, billing
from parlance.sources.views import Views

C = F.col


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN floor({part} * 100.0 / {whole} * 100 + 0.5) / 100 ELSE 0.0 END"


def since(day: str):
    return C("createdAt") >= F.to_timestamp_ntz(F.lit(f"{day} 00:00:00"))


@query("global_counts", """SELECT count(*) AS total, count_if(status = 'open') AS open_, count_if(status = 'close') AS closed, count_if(is_started) AS started, count_if(aiChat) AS ai, count_if(NOT aiChat) AS human,
 count_if(aiChat IS NULL) AS unset, count_if(feedback) AS liked, count_if(NOT feedback) AS disliked, count_if(visitorClosed IS DISTINCT FROM true) AS still_there, count_if(humanAgentId IS NOT NULL) AS handed,
 count_if(createdAt >= TIMESTAMP '1998-01-01 00:00:00') AS recent, count_if(createdAt >= TIMESTAMP '1998-07-15 00:00:00') AS today, count_if(createdAt >= TIMESTAMP '1998-07-12 00:00:00') AS week, count_if(createdAt >= TIMESTAMP '1998-07-01 00:00:00') AS month_, count(feedback) AS rated FROM convs""")
def global_counts(v: Views):
    """Sixteen filtered counts in one scan; today is 15 July 1998."""
    return v.convs.agg(
        F.count(F.lit(1)).alias("total"),
        *count_where(
            open_=C("status") == "open", closed=C("status") == "close", started=C("is_started"), ai=C("aiChat"), human=~C("aiChat"), unset=C("aiChat").isNull(),
            liked=C("feedback"), disliked=~C("feedback"), still_there=not_true(C("visitorClosed")), handed=C("humanAgentId").isNotNull(),
            recent=since("1998-01-01"), today=since("1998-07-15"), week=since("1998-07-12"), month_=since("1998-07-01"), rated=C("feedback").isNotNull(),
        ),
    )


@query("sum_revenue", "SELECT round(coalesce(sum(totalAmountPaid), 0), 2) AS revenue FROM clients WHERE isDeleted IS DISTINCT FROM true")
def sum_revenue(v: Views):
    return v.clients.filter(not_true(C("isDeleted"))).agg(F.round(total(C("totalAmountPaid")), 2).alias("revenue"))


@query("usage_llm", "SELECT coalesce(sum(tokens), 0)::BIGINT AS tokens, coalesce(sum(requests), 0)::BIGINT AS requests, round(coalesce(sum(cost), 0), 4) AS cost FROM llm_usage WHERE date >= TIMESTAMP '2024-01-05 00:00:00' AND date <= TIMESTAMP '2024-01-20 00:00:00'")
def usage_llm(v: Views):
    span = C("date").between(F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00")), F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")))
    return v.llm_usage.filter(span).agg(total(C("tokens")).alias("tokens"), total(C("requests")).alias("requests"), F.round(total(C("cost")), 4).alias("cost"))


@query("usage_vector", "SELECT sum(vectorsAdded)::BIGINT AS added, sum(vectorsDeleted)::BIGINT AS deleted, round(sum(storageMB), 4) AS storage_mb, round(sum(costRequests), 4) AS cost_requests, round(sum(costStorage), 4) AS cost_storage FROM vec_usage")
def usage_vector(v: Views):
    """Sums that include values of a map."""
    costs = F.create_map(F.lit("requests"), C("costRequests"), F.lit("storage"), C("costStorage"))
    rows = v.vec_usage.select("vectorsAdded", "vectorsDeleted", "storageMB", costs.alias("estimatedCost"))
    return rows.agg(
        total(C("vectorsAdded")).alias("added"), total(C("vectorsDeleted")).alias("deleted"), F.round(total(C("storageMB")), 4).alias("storage_mb"),
        F.round(total(C("estimatedCost")["requests"]), 4).alias("cost_requests"), F.round(total(C("estimatedCost")["storage"]), 4).alias("cost_storage"),
    )


@query("conv_stats", "SELECT userId, count(*) AS total, count_if(aiChat) AS ai, count_if(NOT aiChat) AS human, count_if(status = 'open') AS open_ FROM convs GROUP BY userId")
def conv_stats(v: Views):
    """Conversations of each tenant; an unset mode counts in neither branch."""
    return v.convs.groupBy("userId").agg(F.count(F.lit(1)).alias("total"), *count_where(ai=C("aiChat"), human=~C("aiChat"), open_=C("status") == "open"))


@query("group_count", "SELECT coalesce(plan, 'free') AS plan, count(*) AS clients FROM clients GROUP BY 1")
def group_count(v: Views):
    return v.clients.groupBy(F.coalesce("plan", F.lit("free")).alias("plan")).agg(F.count(F.lit(1)).alias("clients"))


@query("group_sums", "SELECT userId, sum(coalesce(success, 0))::BIGINT AS success, sum(coalesce(failed, 0))::BIGINT AS failed, sum(total)::BIGINT AS total, sum(filesAdded)::BIGINT AS files, sum(faqsAdded)::BIGINT AS faqs FROM agents WHERE isDeleted IS DISTINCT FROM true GROUP BY userId")
def group_sums(v: Views):
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    live = v.agents.filter(not_true(C("isDeleted")))
    return live.groupBy("userId").agg(zero("success").alias("success"), zero("failed").alias("failed"), zero("total").alias("total"), zero("filesAdded").alias("files"), zero("faqsAdded").alias("faqs"))


@query("csat", f"SELECT userId, {pct('count(*) FILTER (WHERE feedback)', 'count(feedback)')} AS csat FROM convs GROUP BY userId")
def csat(v: Views):
    return v.convs.groupBy("userId").agg(share(F.count_if(F.coalesce("feedback", F.lit(False))), F.count("feedback")).alias("csat"))


@query("chat_ratio", f"SELECT n - h AS ai, h AS human, {pct('(n - h)', 'n')} AS ai_share, {pct('h', 'n')} AS human_share FROM (SELECT count(*) AS n, count(humanAgentId) AS h FROM convs WHERE is_started)")
def chat_ratio(v: Views):
    n = v.convs.filter("is_started").agg(F.count(F.lit(1)).alias("n"), F.count("humanAgentId").alias("human"))
    ai = C("n") - C("human")
    return n.select(ai.alias("ai"), "human", share(ai, C("n")).alias("ai_share"), share(C("human"), C("n")).alias("human_share"))


@query("daily_zero_fill", """SELECT strftime(d, '%Y-%m-%d') AS day, count(o.id) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS d) LEFT JOIN
 (SELECT event_id AS id, ts FROM events) o ON cast(o.ts AS DATE) = cast(d AS DATE) GROUP BY d""")
def daily_zero_fill(v: Views):
    """Seven days, those without rows too."""
    return zero_filled_days(v.events.filter("ts >= '2024-01-28' AND ts < '2024-02-04'"), "ts", "2024-01-28", 7)


@query("period_counts", """SELECT count_if(ts >= TIMESTAMP '2024-01-17 00:00:00') AS today, count_if(ts >= TIMESTAMP '2024-01-14 00:00:00') AS week, count_if(ts >= TIMESTAMP '2024-01-01 00:00:00') AS month FROM events WHERE ts <= TIMESTAMP '2024-01-17 15:00:00'""")
def period_counts(v: Views):
    """Since midnight, since Sunday, since the first of the month."""
    now = F.lit("2024-01-17 15:00:00").cast("timestamp")
    ts = C("ts").cast("timestamp")
    return v.events.filter(ts <= now).agg(*count_where(today=ts >= F.date_trunc("day", now), week=ts >= dates.week_start(now), month=ts >= F.date_trunc("month", now)))


@query("timeframe_stats", """SELECT count_if(ts >= TIMESTAMP '2024-01-17 00:00:00') AS today, count_if(ts >= TIMESTAMP '2024-01-10 15:00:00') AS last_7_days, count_if(ts >= TIMESTAMP '2024-01-01 00:00:00') AS this_month, count(*) AS all_time FROM events WHERE ts <= TIMESTAMP '2024-01-17 15:00:00'""")
def timeframe_stats(v: Views):
    now = F.lit("2024-01-17 15:00:00").cast("timestamp")
    ts = C("ts").cast("timestamp")
    past = v.events.filter(ts <= now)
    counts = count_where(today=ts >= F.date_trunc("day", now), last_7_days=ts >= now - F.expr("INTERVAL 7 DAYS"), this_month=ts >= F.date_trunc("month", now))
    return past.agg(*counts, F.count(F.lit(1)).alias("all_time"))


BILLED = f"""SELECT w.userId, count(c.id) AS conversations FROM (SELECT userId, s - INTERVAL 27 YEAR AS s, {_plus('s', '1')} - INTERVAL 27 YEAR AS e FROM {WINDOW_SQL}) w LEFT JOIN
 (SELECT id, userId, createdAt FROM convs WHERE is_started AND visitor IN (SELECT id FROM visitors WHERE email IS NOT NULL)) c ON c.userId = w.userId AND c.createdAt >= w.s AND c.createdAt < w.e GROUP BY w.userId"""


@query("billing_cycle_count", BILLED)
def billing_cycle_count(v: Views):
    """Started conversations of signed-in visitors in the current billing month (moved 27 years back, to the data)."""
    back = F.expr("INTERVAL 27 YEARS")
    w = billing(v).select("userId", (C("start") - back).alias("s"), (C("end") - back).alias("e"))
    c = signed_in(v.convs.filter("is_started"), v.visitors).select("id", C("userId").alias("u"), C("createdAt").cast("timestamp").alias("at"))
    return w.join(c, (C("userId") == C("u")) & (C("at") >= C("s")) & (C("at") < C("e")), "left").groupBy("userId").agg(F.count("id").alias("conversations"))


def dashboard(v: Views, keys: list[str]):
    """Figures of each key: conversations in one pass, messages, agents and the most common location joined."""
    started = v.convs.filter("is_started")
    base = started.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_chat"), *count_where(ai_assists=C("aiChat")), F.sum("newMessage").alias("total_message"),
        share(F.count_if(F.coalesce("feedback", F.lit(False))), F.count("feedback")).alias("csat"),
    )
    places = started.select("visitor", *keys).join(v.visitors.select(C("id").alias("visitor"), "location"), "visitor", "left")
    named = F.coalesce(F.nullif("location", F.lit("")), F.lit("UNKNOWN"))
    hist = places.groupBy(*keys, named.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    top = hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("locations"), F.max("n").alias("top_location_chats"))
    return base.join(top, keys, "left")


def dashboard_sql(keys: str) -> str:
    on = " AND ".join(f"b.{k} = t.{k}" for k in keys.split(", "))
    shown = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""SELECT {shown}, total_chat, ai_assists, total_message, csat, locations, top_location_chats%s FROM
 (SELECT {keys}, count(*) AS total_chat, count(*) FILTER (WHERE aiChat) AS ai_assists, sum(newMessage)::BIGINT AS total_message, {pct('count(*) FILTER (WHERE feedback)', 'count(feedback)')} AS csat FROM convs WHERE is_started GROUP BY {keys}) b
 LEFT JOIN (SELECT {keys}, count(*) AS locations, max(n) AS top_location_chats FROM (SELECT {', '.join('c.' + k for k in keys.split(', '))}, coalesce(nullif(p.location, ''), 'UNKNOWN') AS place, count(*) AS n
 FROM convs c LEFT JOIN visitors p ON c.visitor = p.id WHERE c.is_started GROUP BY {', '.join('c.' + k for k in keys.split(', '))}, place) GROUP BY {keys}) t ON {on}"""


OWNER_SQL = f""", coalesce(a.agents, 0) AS agents, coalesce(i.ai_agents, 0) AS ai_agents, coalesce(pc.chats_in_plan, 0) AS chats_in_plan%s LEFT JOIN (SELECT userId, count(*) AS agents FROM hagents WHERE isDeleted IS DISTINCT FROM true GROUP BY userId) a ON a.userId = b.userId
 LEFT JOIN (SELECT userId, count(*) AS ai_agents FROM agents WHERE isDeleted IS DISTINCT FROM true GROUP BY userId) i ON i.userId = b.userId LEFT JOIN (SELECT userId, conversations AS chats_in_plan FROM ({BILLED})) pc ON pc.userId = b.userId"""


def owner_figures(v: Views, df):
    """Figures of a tenant joined: people, AI agents, and the chats of the billing month."""
    live = not_true(C("isDeleted"))
    people, bots = counts_by(v.hagents.filter(live), "userId", "agents"), counts_by(v.agents.filter(live), "userId", "ai_agents")
    plan = billing_cycle_count(v).withColumnRenamed("conversations", "chats_in_plan")
    for part in (people, bots, plan):
        df = df.join(part, "userId", "left")
    return df.fillna(0, ["agents", "ai_agents", "chats_in_plan"])


def _dashboard_oracle(keys: str) -> str:
    shown, joined = OWNER_SQL.split("%s")
    return dashboard_sql(keys) % shown + joined


@query("dashboard_agent", _dashboard_oracle("userId, agentId"))
def dashboard_agent(v: Views):
    return owner_figures(v, dashboard(v, ["userId", "agentId"]))


@query("dashboard_tenant", _dashboard_oracle("userId"))
def dashboard_tenant(v: Views):
    return owner_figures(v, dashboard(v, ["userId"]))


@query("dashboard_admin", f"""SELECT n.*, c.clients, c.active, c.revenue, a.agents, a.active_agents, h.humans, h.online, h.approved, u.tokens, u.cost, q.*, m.* FROM (SELECT count(*) AS conversations, count_if(status = 'open') AS open_, {pct('count_if(humanAgentId IS NOT NULL)', 'count(*)')} AS human_share,
 count_if(createdAt >= TIMESTAMP '1998-07-15 00:00:00') AS today, count_if(createdAt >= TIMESTAMP '1998-07-12 00:00:00') AS week, count_if(createdAt >= TIMESTAMP '1998-07-01 00:00:00') AS month_ FROM convs) n,
 (SELECT count(*) AS clients, count_if(planStatus = 'active') AS active, round(coalesce(sum(totalAmountPaid), 0), 2) AS revenue FROM clients WHERE isDeleted IS DISTINCT FROM true) c,
 (SELECT count(*) AS agents, count_if(isActive) AS active_agents FROM agents WHERE isDeleted IS DISTINCT FROM true) a, (SELECT count(*) AS humans, count_if(isActive) AS online, count_if(status = 'Approved') AS approved FROM hagents WHERE isDeleted IS DISTINCT FROM true) h,
 (SELECT sum(tokens)::BIGINT AS tokens, round(sum(cost), 2) AS cost FROM llm_usage) u, (SELECT sum(vectorsAdded)::BIGINT AS vectors_added, sum(vectorsDeleted)::BIGINT AS vectors_deleted, round(sum(storageMB), 2) AS storage_mb FROM vec_usage) q,
 (SELECT count(*) AS messages, count_if(sender_type = 'ai') AS ai_messages, count_if(humanAgentId IS NOT NULL) AS human_messages, count_if(sender_type = 'visitor') AS visitor_messages FROM msgs) m""")
def dashboard_admin(v: Views):
    """Platform figures: one scan of each collection; every part is a single row.  Today is 15 July 1998."""
    live = not_true(C("isDeleted"))
    n = F.count(F.lit(1))
    parts = [
        v.convs.agg(n.alias("conversations"), *count_where(open_=C("status") == "open"), share(F.count("humanAgentId"), n).alias("human_share"), *count_where(today=since("1998-07-15"), week=since("1998-07-12"), month_=since("1998-07-01"))),
        v.clients.filter(live).agg(n.alias("clients"), *count_where(active=C("planStatus") == "active"), F.round(total(C("totalAmountPaid")), 2).alias("revenue")),
        v.agents.filter(live).agg(n.alias("agents"), *count_where(active_agents=C("isActive"))),
        v.hagents.filter(live).agg(n.alias("humans"), *count_where(online=C("isActive"), approved=C("status") == "Approved")),
        v.llm_usage.agg(total(C("tokens")).alias("tokens"), F.round(F.sum("cost"), 2).alias("cost")),
        v.vec_usage.agg(total(C("vectorsAdded")).alias("vectors_added"), total(C("vectorsDeleted")).alias("vectors_deleted"), F.round(F.sum("storageMB"), 2).alias("storage_mb")),
        v.msgs.agg(n.alias("messages"), *count_where(ai_messages=C("sender_type") == "ai", human_messages=C("humanAgentId").isNotNull(), visitor_messages=C("sender_type") == "visitor")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


@query("dashboard_admin_days", """SELECT strftime(d, '%Y-%m-%d') AS day, count(o.id) AS n FROM (SELECT unnest(generate_series(DATE '1998-07-09', DATE '1998-07-15', INTERVAL 1 DAY)) AS d) LEFT JOIN convs o ON cast(o.createdAt AS DATE) = cast(d AS DATE) GROUP BY d""")
def dashboard_admin_days(v: Views):
    """Conversations of the last seven days, days without any too."""
    return zero_filled_days(v.convs.filter("createdAt >= '1998-07-09' AND createdAt < '1998-07-16'"), "createdAt", "1998-07-09", 7)


@query("score_stats", "SELECT userId, round(min(score), 2) AS low, round(max(score), 2) AS high, floor(avg(score) * 100 + 0.5) / 100 AS mean FROM convs GROUP BY userId")
def score_stats(v: Views):
    return v.convs.groupBy("userId").agg(F.round(F.min("score"), 2).alias("low"), F.round(F.max("score"), 2).alias("high"), rounded(F.avg("score")).alias("mean"))


@query("delete_stats", "SELECT userId, count_if(type = 0 AND trainingStatus = 1) AS pages_ok, count_if(type = 0 AND trainingStatus = 2) AS pages_failed, count_if(type = 1) AS files, count_if(type = 3) AS faqs, sum(strlen(content))::BIGINT AS bytes FROM tdocs GROUP BY userId")
def delete_stats(v: Views):
    t, s = C("type"), C("trainingStatus")
    counts = count_where(pages_ok=(t == 0) & (s == 1), pages_failed=(t == 0) & (s == 2), files=t == 1, faqs=t == 3)
    return v.tdocs.groupBy("userId").agg(*counts, F.sum(F.octet_length("content").cast("long")).alias("bytes"))


@query("token_batches", "SELECT userId, (r - 1) // 100 AS batch, sum(cast(ceil(length(content) / 4.0) AS BIGINT))::BIGINT AS tokens FROM (SELECT userId, content, row_number() OVER (PARTITION BY userId ORDER BY id) AS r FROM tdocs) GROUP BY 1, 2")
def token_batches(v: Views):
    """Estimated tokens of each hundred documents of an owner."""
    slim = v.tdocs.select("id", "userId", text.token_estimate(C("content")).alias("n"))
    placed = running(slim, ["userId"], [C("id").asc()], {"r": F.lit(1).cast("long")})
    return placed.groupBy("userId", F.floor((C("r") - 1) / 100).alias("batch")).agg(F.sum("n").alias("tokens"))


@query("vector_cost", "SELECT user_id, n, floor(n * 1536 * 4 / 1048576.0 * 10000 + 0.5) / 10000 AS mb, floor(n * 1536 * 4 / 1048576.0 / 1024 * 0.12 * 100000000 + 0.5) / 100000000 AS storage_cost, cast(ceil(n / 256.0) AS BIGINT) * 0.10 / 1000 AS request_cost FROM (SELECT user_id, count(*) AS n FROM points GROUP BY user_id)")
def vector_cost(v: Views):
    mb = C("n") * 1536 * 4 / 1048576.0
    n = v.points.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", "n", rounded(mb, 4).alias("mb"), rounded(mb / 1024 * 0.12, 8).alias("storage_cost"), (F.ceil(C("n") / 256.0) * F.lit(0.10) / 1000).cast("double").alias("request_cost"))


@query("upsert_batches", "SELECT user_id, cast(ceil(count(*) / 256.0) AS BIGINT) AS requests, cast(ceil(count(*) / 100.0) AS BIGINT) AS embed_calls FROM points GROUP BY user_id")
def upsert_batches(v: Views):
    n = F.count(F.lit(1))
    return v.points.groupBy("user_id").agg(F.ceil(n / 256.0).cast("long").alias("requests"), F.ceil(n / 100.0).cast("long").alias("embed_calls"))


@query("even_split", "SELECT id, CASE WHEN r = n THEN t - t // n * (n - 1) ELSE t // n END AS share FROM (SELECT id, row_number() OVER (PARTITION BY userId ORDER BY id) AS r, count(*) OVER (PARTITION BY userId) AS n, 100003 + userId AS t FROM agents)")
def even_split(v: Views):
    """An amount in equal parts; the last row takes the rest."""
    sizes = v.agents.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
    placed = by_key(running(v.agents.select("id", "userId"), ["userId"], [C("id").asc()], {"r": F.lit(1).cast("long")}), sizes, "userId")
    n, t = C("n"), 100003 + C("userId")
    each = F.floor(t / n)
    return placed.select("id", F.when(C("r") == n, t - each * (n - 1)).otherwise(each).cast("long").alias("share"))


@query("plan_totals", "SELECT (SELECT count(*) FROM plans) AS plans, (SELECT count(*) FROM plans WHERE status = 'active') AS active, (SELECT count(*) FROM clients) AS clients")
def plan_totals(v: Views):
    p = v.plans.agg(F.count(F.lit(1)).alias("plans"), *count_where(active=C("status") == "active"))
    return p.join(F.broadcast(v.clients.agg(F.count(F.lit(1)).alias("clients"))))


@query("progress_eta", "SELECT id, cast(floor((success + coalesce(failed, 0)) * 100.0 / total + 0.5) AS BIGINT) AS percent, cast(floor((total - success - coalesce(failed, 0)) * (120.0 / greatest(success + coalesce(failed, 0), 1)) + 0.5) AS BIGINT) AS eta FROM agents")
def progress_eta(v: Views):
    """Percent done, and the seconds left at the mean pace so far (120 s elapsed)."""
    done = C("success") + F.coalesce("failed", F.lit(0))
    return v.agents.select("id", F.floor(done * 100.0 / C("total") + 0.5).alias("percent"), F.floor((C("total") - done) * (F.lit(120.0) / F.greatest(done, F.lit(1))) + 0.5).alias("eta"))


@query("counter_fold", "SELECT conversation_id, cast(sum(CASE WHEN sender_type = 'visitor' THEN 1 ELSE 0 END) AS BIGINT) AS unread, sum(strlen(message))::BIGINT AS bytes FROM msgs GROUP BY conversation_id")
def counter_fold(v: Views):
    return v.msgs.groupBy("conversation_id").agg(F.sum(F.when(C("sender_type") == "visitor", 1).otherwise(0)).alias("unread"), F.sum(F.octet_length("message").cast("long")).alias("bytes"))


@query("plan_usage", "SELECT c.userId, (SELECT count(*) FROM agents a WHERE a.userId = c.userId AND a.isDeleted IS DISTINCT FROM true) AS agents, (SELECT count(*) FROM hagents h WHERE h.userId = c.userId) AS humans, (SELECT count(*) FROM convs n WHERE n.userId = c.userId AND n.is_started) AS chats FROM clients c")
def plan_usage(v: Views):
    out = v.clients.select("userId")
    for df, name in ((v.agents.filter(not_true(C("isDeleted"))), "agents"), (v.hagents, "humans"), (v.convs.filter("is_started"), "chats")):
        out = out.join(counts_by(df, "userId", name), "userId", "left")
    return out.fillna(0)


@query("rate_limit", "SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS slot, count(*) AS requests, count(*) > 2 AS limited FROM events GROUP BY 1, time_bucket(INTERVAL 1 HOUR, ts)")
def rate_limit(v: Views):
    """Requests of a user in fixed windows, and whether they exceed the limit."""
    n = F.count(F.lit(1))
    w = v.events.groupBy("user_id", F.window(C("ts").cast("timestamp"), "1 hour").alias("w")).agg(n.alias("requests"), (n > 2).alias("limited"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("slot"), "requests", "limited")
