"""Column functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import colors, dates, forms, pages, text, urls, validation
from parlance.operators.lookups import by_key
from parlance.plans.registry import query
from parlance.sources.views import Views

C = F.col


def _sql_any(expression: str, phrases: list[str]) -> str:
    return " OR ".join(f"contains({expression}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases)


Q = "lower(trim(coalesce(q, '')))"


def _number(c: str) -> str:
    found = f"regexp_extract(coalesce({c}, ''), '\\b(\\d+)\\b', 1)"
    return f"CASE WHEN length(ltrim({found}, '0')) > 18 THEN 999999999999999999 ELSE try_cast({found} AS BIGINT) END"


@query("norm_question", "SELECT id, lower(trim(regexp_replace(regexp_replace(replace(coalesce(t, ''), '&nbsp;', ' '), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM snippets")
def norm_question(v: Views):
    return v.snippets.select("id", text.norm_question(C("t")).alias("n"))


@query("strip_html", """SELECT id, trim(replace(replace(replace(replace(replace(regexp_replace(coalesce(t, ''), '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''')) AS plain FROM snippets""")
def strip_html(v: Views):
    return v.snippets.select("id", text.strip_html(C("t")).alias("plain"))


@query("clean_content", """SELECT id, trim(regexp_replace(replace(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(9), ' '), ' {2,}', ' ', 'g')) AS content FROM tdocs""")
def clean_content(v: Views):
    return v.tdocs.select("id", text.clean_content(C("content")).alias("content"))


@query("clean_markdown", """SELECT id, trim(regexp_replace(regexp_replace(content, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS content FROM tdocs""")
def clean_markdown(v: Views):
    return v.tdocs.select("id", text.clean_markdown(C("content")).alias("content"))


@query("is_greeting", "SELECT id, " + " OR ".join(f"{Q} = '{g}' OR starts_with({Q}, '{g} ') OR {Q} = '{g}!'" for g in (x.replace("'", "''") for x in text.GREETINGS)) + " AS hit FROM questions")
def is_greeting(v: Views):
    return v.questions.select("id", text.is_greeting(C("q")).alias("hit"))


@query("is_accidental", """SELECT id, length(x) >= 3 AND ((NOT contains(x, ' ') AND length(x) > 10 AND len(list_distinct(string_split(lower(x), ''))) < 0.4 * length(x))
 OR (length(x) > 6 AND length(x) % 2 = 0 AND left(x, length(x) // 2) = right(x, length(x) // 2))) AS hit FROM (SELECT id, regexp_replace(coalesce(q, ''), '^\\s+|\\s+$', '', 'g') AS x FROM questions)""")
def is_accidental(v: Views):
    return v.questions.select("id", text.is_accidental(C("q")).alias("hit"))


@query("is_agent_request", f"SELECT id, {_sql_any(Q, text.AGENT_PHRASES)} AS hit FROM questions")
def is_agent_request(v: Views):
    return v.questions.select("id", text.is_agent_request(C("q")).alias("hit"))


@query("max_tokens", f"""SELECT id, cast(CASE WHEN (regexp_matches(q, '{text.QUANTITY}') OR (long AND (lists OR links))) AND links THEN least(2000, 200 + n * 150)
 WHEN regexp_matches(q, '{text.QUANTITY}') OR (long AND (lists OR links)) THEN least(1000, 200 + n * 80) WHEN links AND long THEN 800
 WHEN lists OR (long AND regexp_matches(q, '{text.DETAILED}')) THEN 600 WHEN long THEN 400 ELSE 200 END AS BIGINT) AS tokens FROM
 (SELECT id, coalesce(q, '') AS q, {_sql_any(Q, text.LONG_WORDS)} AS long, regexp_matches(coalesce(q, ''), '{text.LISTING}') AS lists, regexp_matches(coalesce(q, ''), '{text.LINKING}') AS links,
 coalesce({_number('q')}, 5) AS n FROM questions)""")
def max_tokens(v: Views):
    return v.questions.select("id", text.max_tokens(C("q")).alias("tokens"))


@query("detect_intent", f"SELECT id, CASE WHEN {_sql_any("lower(coalesce(q, ''))", text.STRUCTURE_HINTS)} THEN 'STRUCTURAL' ELSE 'SEMANTIC' END AS intent FROM questions")
def detect_intent(v: Views):
    return v.questions.select("id", text.detect_intent(C("q")).alias("intent"))


@query("requested_count", "SELECT id, cast(CASE WHEN n > 0 THEN n ELSE 5 END AS BIGINT) AS n FROM (SELECT id, " + _number("q") + " AS n FROM questions)")
def requested_count(v: Views):
    return v.questions.select("id", text.requested_count(C("q")).alias("n"))


@query("keywords", f"""SELECT id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS words FROM (SELECT id, unnest(string_split_regex(regexp_replace(lower(coalesce(q, '')), '[^\\w\\s-]', ' ', 'g'), '\\s+')) AS w,
 generate_subscripts(string_split_regex(regexp_replace(lower(coalesce(q, '')), '[^\\w\\s-]', ' ', 'g'), '\\s+'), 1) AS i FROM questions)
 WHERE length(w) > 2 AND w NOT IN ({', '.join(f"'{w}'" for w in text.STOP_WORDS)}) GROUP BY id""")
def keywords(v: Views):
    return v.questions.select("id", F.array_join(text.keywords(C("q")), " ").alias("words")).filter("words <> ''")


@query("format_history", r"""WITH current_q AS (SELECT conversation_id, arg_max(message, turn) AS question FROM msgs WHERE sender_type = 'visitor' GROUP BY conversation_id),
 kept AS (SELECT m.* FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS r FROM msgs) m LEFT JOIN current_q a ON a.conversation_id = m.conversation_id WHERE r <= 12 AND regexp_replace(message, '^\s+|\s+$', '', 'g') IS DISTINCT FROM regexp_replace(question, '^\s+|\s+$', '', 'g')),
 h AS (SELECT conversation_id, string_agg(CASE sender_type WHEN 'ai' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE 'User' END || ': ' || message, chr(10) || chr(10) ORDER BY turn) AS history, count(*) AS n FROM kept GROUP BY conversation_id)
 SELECT conversation_id, coalesce(history, 'No previous conversation.') AS history, CASE WHEN n > 10 THEN 'long' WHEN n > 5 THEN 'medium' WHEN n > 0 THEN 'short' ELSE 'none' END AS header FROM (SELECT DISTINCT conversation_id FROM msgs) LEFT JOIN h USING (conversation_id)""")
def format_history(v: Views):
    """The oldest messages of a conversation with the names of their roles, without the question that is being asked: the last of the visitor.

    ``history`` has twelve messages at most; ``header`` says how long it is.
    """
    from pyspark.sql import Window as W

    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    asked = v.msgs.filter("sender_type = 'visitor'").groupBy("conversation_id").agg(F.max_by("message", "turn").alias("question"))
    first = v.msgs.withColumn("r", F.row_number().over(W.partitionBy("conversation_id").orderBy("turn"))).filter("r <= 12").join(asked, "conversation_id", "left")
    line = F.when(~bare(C("message")).eqNullSafe(bare(C("question"))), F.struct("turn", F.concat(text.role_name(C("sender_type")), F.lit(": "), "message").alias("l")))
    rows = first.groupBy("conversation_id").agg(F.array_sort(F.collect_list(line)).alias("x"))
    n = F.size("x")
    return rows.select(
        "conversation_id", F.when(n == 0, "No previous conversation.").otherwise(F.array_join(F.transform("x", lambda y: y["l"]), "\n\n")).alias("history"),
        F.when(n > 10, "long").when(n > 5, "medium").when(n > 0, "short").otherwise("none").alias("header"),
    )


@query("role_map", "SELECT id, CASE sender_type WHEN 'ai' THEN 'Assistant' WHEN 'visitor' THEN 'User' WHEN 'system' THEN 'System' ELSE 'User' END AS role FROM msgs")
def role_map(v: Views):
    return v.msgs.select("id", text.role_name(C("sender_type")).alias("role"))


@query("context_join", "SELECT user_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS r FROM points WHERE text <> '') WHERE r <= 5 GROUP BY user_id")
def context_join(v: Views):
    """The texts of the first five hits of each owner: an answer's context has five at most."""
    from pyspark.sql import Window as W

    first = v.points.filter("text <> ''").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("id"))).filter("r <= 5")
    some = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("x"))
    return some.select("user_id", F.array_join(F.transform("x", lambda y: y["text"]), "\n\n---\n\n").alias("context"))


@query("context_join_all", "SELECT user_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY id) AS context FROM points WHERE text <> '' GROUP BY user_id")
def context_join_all(v: Views):
    """Texts of all points of an owner."""
    some = v.points.filter("text <> ''").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("x"))
    return some.select("user_id", F.array_join(F.transform("x", lambda y: y["text"]), "\n\n---\n\n").alias("context"))


@query("prompt_build", """SELECT id, 'You answer for ' || coalesce(nullif(agentName, ''), 'the company') || CASE WHEN success > 20 THEN ' with ' || success || ' pages.' ELSE '.' END AS prompt FROM agents""")
def prompt_build(v: Views):
    """A prompt from a tenant's metadata, in words of our own."""
    name = F.coalesce(F.nullif("agentName", F.lit("")), F.lit("the company"))
    return v.agents.select("id", F.concat(F.lit("You answer for "), name, F.when(C("success") > 20, F.concat(F.lit(" with "), C("success").cast("string"), F.lit(" pages."))).otherwise(".")).alias("prompt"))


HOST = "nullif(regexp_replace(regexp_extract(lower(trim(coalesce(u, ''))), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#:\\s]+)', 1), '^www\\.', ''), '')"


@query("hostname", f"SELECT id, {HOST} AS host FROM hosts")
def hostname(v: Views):
    return v.hosts.select("id", urls.hostname(C("u")).alias("host"))


@query("primary_label", f"""SELECT id, CASE WHEN h IS NULL THEN NULL WHEN len(p) >= 3 AND p[-2] || '.' || p[-1] IN ({', '.join(f"'{x}'" for x in urls.TWO_PART)}) THEN p[-3] WHEN len(p) >= 2 THEN p[-2] ELSE h END AS label
 FROM (SELECT id, h, string_split(h, '.') AS p FROM (SELECT id, {HOST} AS h FROM hosts))""")
def primary_label(v: Views):
    return v.hosts.select("id", urls.primary_label(urls.hostname(C("u"))).alias("label"))


@query("is_domain", "SELECT id, regexp_matches(trim(u), '^[\\w.-]+\\.[\\w.-]+$') AS hit FROM hosts")
def is_domain(v: Views):
    return v.hosts.select("id", urls.is_domain(C("u")).alias("hit"))


LABEL = f"""CASE WHEN len(p) >= 3 AND p[-2] || '.' || p[-1] IN ({', '.join(f"'{x}'" for x in urls.TWO_PART)}) THEN p[-3] WHEN len(p) >= 2 THEN p[-2] ELSE h END"""


@query("display_name", f"""SELECT id, coalesce(CASE WHEN h IS NOT NULL THEN {LABEL} END, nullif(trim(agentName), ''), nullif(trim(website), ''), 'client') AS shown FROM
 (SELECT *, string_split(h, '.') AS p FROM (SELECT a.id, agentName, website, coalesce({HOST.replace('coalesce(u,', 'coalesce(website,')}, {HOST.replace('coalesce(u,', 'coalesce(onboarding,')}) AS h FROM agents a LEFT JOIN (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE u END AS website, CASE WHEN id % 2 = 0 THEN u END AS onboarding FROM hosts) s ON s.id = a.id))""")
def display_name(v: Views):
    """A client's name: the label of its website's host, of the address it began with, else what it calls itself."""
    sites = v.hosts.select("id", F.when(C("id") % 3 != 0, C("u")).alias("website"), F.when(C("id") % 2 == 0, C("u")).alias("onboarding"))
    named = v.agents.select("id", "agentName").join(sites, "id", "left")
    return named.select("id", urls.display_name(C("website"), C("onboarding"), C("agentName")).alias("shown"))


def _meta(kind: str, name: str) -> str:
    """SQL: trimmed content of the first meta tag whose ``kind`` is ``name``."""
    of = lambda t, a: " || ".join(f"""regexp_extract({t}, '(?is)^<[a-z0-9]+(?:[^>"'']|"[^"]*"|''[^'']*'')*?\\s{a}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', {k})""" for k in (1, 2, 3))
    tags = """regexp_extract_all(html, '(?is)<meta\\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>')"""
    ours = f"list_filter({tags}, lambda t: lower(trim({of('t', kind)})) = '{name}')[1]"
    return f"""nullif(trim({of(ours, 'content')}), '')"""


def _element(name: str) -> str:
    text = f"""regexp_replace(regexp_extract(html, '(?is)<{name}(?:\\s[^>]*>|>)(.*?)</{name}\\s*>', 1), '(?s)<!--.*?-->|</?[a-zA-Z][^>]*>', '', 'g')"""
    for mark, char in (("&nbsp;", " "), ("&copy;", "©"), ("&#169;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{mark}', '{char}')"
    return f"nullif(trim({text}), '')"


@query("page_title", f"SELECT id, {_element('title')} AS title, {_meta('name', 'description')} AS description FROM webpages")
def page_title(v: Views):
    """Title and description of each page."""
    return v.webpages.select("id", pages.first_element(C("html"), "title").alias("title"), pages.meta(C("html"), "name", "description").alias("description"))


@query("site_name", f"""SELECT id, coalesce({_meta('property', 'og:site_name')}, {_meta('property', 'og:title')}, nullif(trim(string_split(string_split(title, '|')[1], '-')[1]), ''), h1, title) AS name FROM (SELECT id, html, {_element('title')} AS title, {_element('h1')} AS h1 FROM webpages)""")
def site_name(v: Views):
    return v.webpages.select("id", pages.site_name(C("html")).alias("name"))


#: Words of company types and industries, in their order.
TYPES = [("SaaS company", ["saas", "software"]), ("e-commerce platform", ["e-commerce", "online store", "shop"]), ("service provider", ["service", "consulting"]), ("agency", ["agency"])]
INDUSTRIES = [
    ("technology", ["tech", "software", "it", "saas", "platform"]), ("healthcare", ["health", "medical", "hospital", "clinic", "wellness"]),
    ("real estate", ["real estate", "property", "realty", "housing"]), ("finance", ["finance", "financial", "banking", "investment", "fintech"]),
    ("education", ["education", "learning", "school", "university", "course"]), ("retail", ["retail", "store", "shop", "e-commerce", "shopping"]),
]


def _cascade(c, table, default):
    out = F.lit(default)
    for name, words in reversed(table):
        hit = F.lit(False)
        for w in words:
            hit = hit | c.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def _sql_cascade(expression, table, default):
    return "CASE " + " ".join(f"WHEN {_sql_any(expression, words)} THEN '{name}'" for name, words in table) + f" ELSE {default} END"


SAID = f"(SELECT id, lower(coalesce({_meta('name', 'keywords')}, '') || ' ' || coalesce({_meta('name', 'description')}, '')) AS said FROM webpages)"


@query("company_type", f"SELECT id, {_sql_cascade('said', TYPES, chr(39) + 'company' + chr(39))} AS kind FROM {SAID}")
def company_type(v: Views):
    """By the words of the page's keywords and description."""
    return v.webpages.select("id", _cascade(pages.described(C("html")), TYPES, "company").alias("kind"))


@query("industry", f"SELECT id, {_sql_cascade('said', INDUSTRIES, 'NULL')} AS industry FROM {SAID}")
def industry(v: Views):
    return v.webpages.select("id", _cascade(pages.described(C("html")), INDUSTRIES, None).alias("industry"))


@query("founded_year", r"""SELECT id, nullif(regexp_extract(regexp_replace(array_to_string(regexp_extract_all(html, '(?is)<footer(?:\s[^>]*>|>)(.*?)</footer\s*>', 1), '') || ' ' || regexp_extract(html, '(?is)<body(?:\s[^>]*>|>)(.*)', 1), '<[^>]*>', '', 'g'), '(?i)(?:founded|established|since|©|&copy;|&#169;)\s*(?:in\s*)?(\d{4})', 1), '') AS year FROM webpages""")
def founded_year(v: Views):
    """The year of foundation that the footer or the text states."""
    return v.webpages.select("id", pages.founded_year(C("html")).alias("year"))


MENU = "regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<(?:nav|header)(?:\\s[^>]*>|>).*?</(?:nav|header)>'), ''), '(?is)<a(?:\\s[^>]*>|>)(.*?)</a>', 1)"


@query("services_list", f"""SELECT id, coalesce(services, '') AS services FROM webpages LEFT JOIN (SELECT id, string_agg(s, '|' ORDER BY i) AS services FROM (SELECT id, s, min(i) AS i, row_number() OVER (PARTITION BY id ORDER BY min(i)) AS r FROM
 (SELECT id, trim(unnest(x)) AS s, generate_subscripts(x, 1) AS i FROM (SELECT id, {MENU} AS x FROM webpages)) WHERE length(s) < 50 AND s <> '' AND lower(s) NOT IN ('home', 'about', 'contact', 'blog', 'login', 'sign up', 'sign in') GROUP BY id, s) WHERE r <= 10 GROUP BY id) USING (id)""")
def services_list(v: Views):
    """The first ten services of each page: links of menus and headers but for common ones, headings of service sections (the pages have none)."""
    return v.webpages.select("id", F.array_join(pages.services(C("html")), "|").alias("services"))


@query("is_homepage", "SELECT id, len(list_filter(string_split(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')) <= 1 AS home FROM webpages")
def is_homepage(v: Views):
    return v.webpages.select("id", urls.is_homepage(C("url")).alias("home"))


@query("word_token_count", "SELECT id, cast(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words, cast(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM tdocs")
def word_token_count(v: Views):
    return v.tdocs.select("id", text.word_count(C("content")).alias("words"), text.token_estimate(C("content")).alias("tokens"))


@query("meaningful", """SELECT id, len(list_distinct(string_split(b, ''))) >= 2 AND len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) >= 2 AND length(regexp_replace(b, '[^a-zA-Z]', '', 'g')) >= 0.3 * length(b) AS ok
 FROM (SELECT id, content, regexp_replace(content, '\\s', '', 'g') AS b FROM tdocs)""")
def meaningful(v: Views):
    return v.tdocs.select("id", text.meaningful(C("content")).alias("ok"))


def _dominated(table: str, column: str) -> str:
    return f"""SELECT t.id, coalesce(max(n) > 0.3 * any_value(total), false) AS dominated FROM (SELECT id, len(string_split_regex(lower({column}), '\\s+')) AS total FROM {table}) t
 LEFT JOIN (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(string_split_regex(lower({column}), '\\s+')) AS w FROM {table}) WHERE length(w) > 2 GROUP BY id, w) f ON f.id = t.id GROUP BY t.id"""


@query("word_freq", _dominated("msgs", "message"))
def word_freq(v: Views):
    """Whether one word makes up more than three tenths of a message; no word leaves its row."""
    return v.msgs.select("id", text.dominated(C("message")).alias("dominated"))


@query("spam", f"""SELECT c.id, dominated OR len(regexp_extract_all(content, '[!?]{{2,}}')) > 5 OR (length(regexp_replace(content, '[^A-Z]', '', 'g')) > 0.5 * length(content) AND length(content) > 100) AS spam
 FROM tdocs c JOIN ({_dominated('tdocs', 'content')}) d ON c.id = d.id""")
def spam(v: Views):
    """Repetition, punctuation and capitals of documents."""
    return v.tdocs.select("id", text.spam(C("content")).alias("spam"))


ROOM = "(SELECT userId AS owner, currentDataSize AS used, CASE WHEN isCustomLimits THEN 4000000 ELSE 6000000 END AS room FROM clients)"
KIND = "CASE id % 4 WHEN 0 THEN 'snippet' WHEN 1 THEN 'webpage' WHEN 2 THEN 'faq' ELSE 'other' END"
SPACE = "'^[\\s\u00a0\ufeff]+|[\\s\u00a0\ufeff]+$'"


def _owners(v: Views):
    """Clients with what they store and what their plans allow."""
    return v.clients.select(C("userId").alias("owner"), C("currentDataSize").alias("used"), F.when(C("isCustomLimits"), 4_000_000).otherwise(6_000_000).alias("room"))


@query("validate_content", f"""SELECT id, kind, CASE WHEN coalesce(q, '') = '' THEN 'CONTENT_MISSING' WHEN length(t) < CASE kind WHEN 'snippet' THEN 10 WHEN 'webpage' THEN 10 WHEN 'faq' THEN 1 ELSE 5 END THEN 'CONTENT_TOO_SHORT'
 WHEN coalesce(used, 0) + strlen(t) > room THEN 'PLAN_LIMIT_EXCEEDED' ELSE 'OK' END AS code FROM (SELECT id, q, {KIND} AS kind, regexp_replace(q, {SPACE}, '', 'g') AS t FROM questions) LEFT JOIN {ROOM} ON owner = id % 17""")
def validate_content(v: Views):
    """Missing, too short for its kind, beyond what its owner's plan has room for, or fine."""
    rows = by_key(v.questions.withColumn("owner", C("id") % 17), _owners(v), "owner").withColumn("kind", F.expr(KIND))
    return rows.select("id", "kind", validation.content_code(C("q"), C("kind"), C("used"), C("room")).alias("code"))


@query("validate_faq", f"""SELECT id, CASE WHEN coalesce(original_question, '') = '' OR coalesce(answer, '') = '' THEN 'FAQ_INCOMPLETE' WHEN length(a) < 1 OR length(b) < 1 THEN 'CONTENT_TOO_SHORT'
 WHEN greatest(strlen(a), strlen(b), strlen('Question: ' || original_question || chr(10) || 'Answer: ' || answer)) + coalesce(used, 0) > room THEN 'PLAN_LIMIT_EXCEEDED' ELSE 'OK' END AS code FROM
 (SELECT *, regexp_replace(original_question, {SPACE}, '', 'g') AS a, regexp_replace(answer, {SPACE}, '', 'g') AS b FROM revised) LEFT JOIN {ROOM} ON owner = id % 17""")
def validate_faq(v: Views):
    """Question and answer, each by itself, then both as they are stored."""
    rows = by_key(v.revised.withColumn("owner", C("id") % 17), _owners(v), "owner")
    return rows.select("id", validation.faq_code(C("original_question"), C("answer"), C("used"), C("room")).alias("code"))


@query("validate_form", f"""SELECT id, concat_ws('; ', CASE WHEN coalesce(trim(name), '') = '' THEN 'Name is missing' END, CASE WHEN trim(name) <> '' AND NOT regexp_matches(name, '^Customer#\\d+[02468]$') THEN 'Name has another form' END,
 CASE WHEN coalesce(trim(email), '') = '' THEN 'Email is missing' END, CASE WHEN email <> '' AND NOT regexp_matches(email, '{forms.EMAIL}') THEN 'Email is no e-mail address' END, CASE WHEN length(email) < 15 THEN 'Email has fewer than 15 characters' END,
 CASE WHEN NOT regexp_matches(regexp_replace('+' || id || ' (' || (id % 7) || ')-5', '[\\s()-]', '', 'g'), '{forms.PHONE}') THEN 'Phone is no phone number' END,
 CASE WHEN location <> '' AND try_cast(trim(location) AS DOUBLE) IS NULL THEN 'Place is no number' END, CASE WHEN length(location) > 8 THEN 'Place has more than 8 characters' END,
 CASE WHEN NOT regexp_matches(CASE WHEN id % 3 = 0 THEN 'https://' || ip WHEN id % 3 = 1 THEN 'x:' ELSE ip END, '{forms.URL}') THEN 'Site is no address' END) AS errors FROM visitors""")
def validate_form(v: Views):
    """All errors of a form, in the order of its fields."""
    phone = F.concat(F.lit("+"), C("id").cast("string"), F.lit(" ("), (C("id") % 7).cast("string"), F.lit(")-5"))
    site = F.when(C("id") % 3 == 0, F.concat(F.lit("https://"), "ip")).when(C("id") % 3 == 1, "x:").otherwise(C("ip"))
    found = forms.errors([
        (forms.Field("Name", required=True, pattern=r"^Customer#\d+[02468]$"), C("name")),
        (forms.Field("Email", "email", required=True, least=15), C("email")),
        (forms.Field("Phone", "tel"), phone),
        (forms.Field("Place", "number", most=8), C("location")),
        (forms.Field("Site", "url"), site),
    ])
    return v.visitors.select("id", F.array_join(found, "; ").alias("errors"))


@query("regex_checks", "SELECT userId, regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS email_ok, length(name) >= 8 AND regexp_matches(name, '[A-Z]') AND regexp_matches(name, '[0-9]') AND regexp_matches(name, '[^A-Za-z0-9]') AS strong FROM clients")
def regex_checks(v: Views):
    """E-mail addresses, and strong words: eight characters, a capital, a digit and another sign."""
    e, w = C("email"), C("name")
    return v.clients.select("userId", e.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$").alias("email_ok"), ((F.length(w) >= 8) & w.rlike("[A-Z]") & w.rlike("[0-9]") & w.rlike("[^A-Za-z0-9]")).alias("strong"))


@query("detail_email", "SELECT id, coalesce(email, 'N/A') AS email FROM visitors")
def detail_email(v: Views):
    """The value of the first detail whose name holds ``email``."""
    details = F.array(F.struct(F.lit("Name").alias("field"), C("name").alias("value")), F.struct(F.lit("Your Email").alias("field"), C("email").alias("value")))
    hit = F.filter(details, lambda d: F.lower(d["field"]).contains("email") & d["value"].isNotNull())
    return v.visitors.select("id", F.coalesce(F.get(hit, 0)["value"], F.lit("N/A")).alias("email"))


@query("initials", "SELECT id, upper(left(array_to_string(list_transform(list_filter(string_split_regex(trim(name), '[\\s#]+'), lambda w: w <> ''), lambda w: left(w, 1)), ''), 2)) AS letters FROM visitors")
def initials(v: Views):
    return v.visitors.select("id", text.initials(C("name")).alias("letters"))


@query("html_encode", """SELECT id, '<p>' || replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</p>' AS coded FROM snippets""")
def html_encode(v: Views):
    return v.snippets.select("id", text.html_encode(C("t")).alias("coded"))


@query("format_bytes", "SELECT userId, CASE WHEN currentDataSize >= 1048576 THEN cast(floor(currentDataSize * 10 / 1048576 + 0.5) / 10 AS VARCHAR) || ' MB' ELSE cast(floor(currentDataSize * 10 / 1024 + 0.5) / 10 AS VARCHAR) || ' KB' END AS shown FROM clients")
def format_bytes(v: Views):
    return v.clients.select("userId", text.format_bytes(C("currentDataSize")).alias("shown"))


@query("url_scheme", "SELECT id, CASE WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') THEN u ELSE 'https://' || u END AS full_url, lower(u) LIKE '%.xml' AS sitemap FROM hosts")
def url_scheme(v: Views):
    return v.hosts.select("id", urls.with_scheme(C("u")).alias("full_url"), urls.is_sitemap(C("u")).alias("sitemap"))


HEX = """CASE WHEN regexp_matches(lower(trim(c)), '^#[0-9a-f]{6}$') THEN lower(trim(c)) WHEN regexp_matches(lower(trim(c)), '^#[0-9a-f]{3}$') THEN '#' || repeat(lower(c)[2], 2) || repeat(lower(c)[3], 2) || repeat(lower(c)[4], 2)
 WHEN regexp_matches(c, '^rgba?\\(') THEN '#' || lower(printf('%02x%02x%02x', least(255, try_cast(regexp_extract_all(c, '\\d+')[1] AS INT)), least(255, try_cast(regexp_extract_all(c, '\\d+')[2] AS INT)), least(255, try_cast(regexp_extract_all(c, '\\d+')[3] AS INT)))) END"""


@query("color_hex", f"SELECT id, {HEX} AS h FROM shades")
def color_hex(v: Views):
    return v.shades.select("id", colors.to_hex(C("c")).alias("h"))


RGB = f"(SELECT id, h, ('0x' || h[2:3])::INT AS r, ('0x' || h[4:5])::INT AS g, ('0x' || h[6:7])::INT AS b FROM (SELECT id, {HEX} AS h FROM shades))"


@query("color_useful", f"SELECT id, NOT (least(r, g, b) > 210) AND NOT (greatest(r, g, b) < 40) AND greatest(r, g, b) - least(r, g, b) >= 30 AS useful FROM {RGB} WHERE h IS NOT NULL")
def color_useful(v: Views):
    h = v.shades.select("id", colors.to_hex(C("c")).alias("h")).filter("h is not null")
    return h.select("id", colors.useful(C("h")).alias("useful"))


@query("contrast_text", f"SELECT id, CASE WHEN (0.299 * r + 0.587 * g + 0.114 * b) / 255 > 0.55 THEN '#1F2937' ELSE '#FFFFFF' END AS ink FROM {RGB} WHERE h IS NOT NULL")
def contrast_text(v: Views):
    h = v.shades.select("id", colors.to_hex(C("c")).alias("h")).filter("h is not null")
    return h.select("id", colors.contrast_text(C("h")).alias("ink"))


@query("map_to_details", """SELECT id, CASE WHEN id % 3 = 0 THEN ' Name =' || name || ' II;email=' || coalesce(email, '') WHEN id % 3 = 1 THEN 'NAME=;email=' || coalesce(email, '') ELSE 'email=' || coalesce(email, '') || ';surname=' || name END AS details,
 CASE WHEN id % 3 = 0 THEN name || ' II' WHEN id % 3 = 1 THEN '' ELSE name END AS name FROM visitors""")
def map_to_details(v: Views):
    """A map of fields as a list of field and value, by field name; a field called name, in any case, is the visitor's new name."""
    field = F.when(C("id") % 3 == 0, " Name ").when(C("id") % 3 == 1, "NAME").otherwise("surname")
    given = F.when(C("id") % 3 == 0, F.concat("name", F.lit(" II"))).when(C("id") % 3 == 1, "").otherwise(C("name"))
    m = F.create_map(field, given, F.lit("email"), F.coalesce("email", F.lit("")))
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"))))
    named = F.get(F.filter(pairs, lambda p: F.lower(F.trim(p["field"])) == "name"), 0)["value"]
    return v.visitors.select("id", F.array_join(F.transform(pairs, lambda p: F.concat(p["field"], F.lit("="), p["value"])), ";").alias("details"), F.coalesce(named, "name").alias("name"))


@query("to_json_row", """SELECT id, '{"name":"' || name || '","status":"' || status || '"}' AS j FROM hagents""")
def to_json_row(v: Views):
    return v.hagents.select("id", F.to_json(F.struct("name", "status")).alias("j"))


@query("json_parse", "SELECT event_id AS id, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse(v: Views):
    """A number out of JSON text; bad text gives null."""
    return v.events.select(C("event_id").alias("id"), F.from_json("props", "k long")["k"].alias("k"))


#: Opening hours by weekday: open at all, from, to.
HOURS = {
    "Monday": (True, "03:00", "05:30"), "Tuesday": (True, "03:00", "05:30"), "Wednesday": (True, "00:00", "23:59"), "Thursday": (True, "12:15", "18:00"),
    "Friday": (True, "03:00", "04:45"), "Saturday": (True, "10:00", "12:00"), "Sunday": (False, "00:00", "23:59"),
}


@query("working_hours", "SELECT id, CASE dayname(createdAt) " + " ".join(f"WHEN '{d}' THEN {str(on).lower()} AND strftime(createdAt, '%H:%M') BETWEEN '{a}' AND '{b}'" for d, (on, a, b) in HOURS.items()) + " END AS open FROM msgs")
def working_hours(v: Views):
    """Inside the hours of the weekday, both ends included; a day that is off is closed."""
    return v.msgs.select("id", dates.within_hours(C("createdAt"), HOURS).alias("open"))


#: Each page with two colours of parts: the part behind its number, and the next, counted round.
STYLED = f"""(SELECT p.id, a.h AS a, b.h AS b FROM webpages p CROSS JOIN (SELECT max(id) AS n FROM shades) JOIN (SELECT id, {HEX} AS h FROM shades) a ON a.id = p.id % n + 1 JOIN (SELECT id, {HEX} AS h FROM shades) b ON b.id = (p.id + 1) % n + 1)"""


@query("color_freq", f"""SELECT id, color, weight FROM (SELECT id, h AS color, sum(w)::BIGINT AS weight FROM (SELECT id, a AS h, 30 + 3 AS w FROM {STYLED} UNION ALL SELECT id, b, 3 + 1 + 1 FROM {STYLED}) WHERE h IS NOT NULL GROUP BY id, h)
 WHERE NOT (least(('0x' || color[2:3])::INT, ('0x' || color[4:5])::INT, ('0x' || color[6:7])::INT) > 210) AND NOT (greatest(('0x' || color[2:3])::INT, ('0x' || color[4:5])::INT, ('0x' || color[6:7])::INT) < 40)
 AND greatest(('0x' || color[2:3])::INT, ('0x' || color[4:5])::INT, ('0x' || color[6:7])::INT) - least(('0x' || color[2:3])::INT, ('0x' || color[4:5])::INT, ('0x' || color[6:7])::INT) >= 30""")
def color_freq(v: Views):
    """The six colours of the largest weight of each page; pages get a theme and a style sheet, as they have none with colours."""
    n = v.shades.agg(F.max("id")).first()[0]
    one, two = (v.shades.select(C("id").alias(f"i{k}"), C("c").alias(f"c{k}")) for k in (1, 2))
    theme = F.concat(F.lit('<meta name="theme-color" content="'), "c1", F.lit('">'))
    sheet = F.concat(F.lit("<style>a:hover{color: "), "c2", F.lit(";BACKGROUND:"), "c1", F.lit("} .x{border-color:"), "c2", F.lit("} svg{fill :"), "c2", F.lit("}</style>"))
    placed = v.webpages.withColumns({"i1": C("id") % n + 1, "i2": (C("id") + 1) % n + 1})
    styled = by_key(by_key(placed, one, "i1"), two, "i2").select("id", F.concat("html", theme, sheet).alias("html"))
    return styled.select("id", F.explode(colors.brand_colors(C("html"))).alias("x")).select("id", "x.color", C("x.weight").cast("long").alias("weight"))


# dates


@query("fmt_duration", "SELECT id, CASE WHEN s IS NULL THEN '-' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' END AS t FROM (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE greatest(cast(floor(score) AS BIGINT), 0) END AS s FROM convs)")
def fmt_duration(v: Views):
    s = F.when(C("id") % 5 != 0, F.floor("score"))
    return v.convs.select("id", dates.spoken(s).alias("t"))


@query("fmt_hms", "SELECT id, CASE WHEN s // 3600 < 10 THEN '0' ELSE '' END || (s // 3600) || ':' || lpad(cast(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(cast(s % 60 AS VARCHAR), 2, '0') AS t FROM (SELECT id, cast(floor(score) AS BIGINT) AS s FROM convs)")
def fmt_hms(v: Views):
    return v.convs.select("id", dates.hms(F.floor("score")).alias("t"))


@query("fmt_ts", "SELECT id, strftime(createdAt, '%b %d, %Y, %I:%M:%S %p') AS t FROM msgs")
def fmt_ts(v: Views):
    return v.msgs.select("id", F.date_format("createdAt", "MMM dd, yyyy, hh:mm:ss a").alias("t"))


@query("block_expiry", "SELECT id, strftime(expiresAt + INTERVAL 24 HOURS, '%Y-%m-%d %H:%M:%S') AS until FROM blocked")
def block_expiry(v: Views):
    return v.blocked.select("id", F.date_format(C("expiresAt") + F.expr("INTERVAL 24 HOURS"), "yyyy-MM-dd HH:mm:ss").alias("until"))


def _plus(ts: str, months: str) -> str:
    return f"(date_trunc('month', {ts}) + ({months}) * INTERVAL 1 MONTH + ({ts} - date_trunc('month', {ts})))"


BASE = "CASE WHEN coalesce(plan, 'free') = 'free' OR planPurchaseDate IS NULL THEN createdAt ELSE planPurchaseDate END"
MONTHS = "greatest((2025 - year(base)) * 12 + 3 - month(base) - CASE WHEN 15 < day(base) THEN 1 ELSE 0 END, 0)"
WINDOW_SQL = f"(SELECT userId, {_plus('base', MONTHS)} AS s FROM (SELECT userId, {BASE} AS base FROM clients))"


def billing(v: Views):
    """Clients with the bounds of the billing month that holds 15 March 2025."""
    now = F.lit("2025-03-15 12:00:00").cast("timestamp")
    base = F.when((F.coalesce("plan", F.lit("free")) == "free") | C("planPurchaseDate").isNull(), C("createdAt")).otherwise(C("planPurchaseDate"))
    start, end = dates.billing_window(base, now)
    return v.clients.select("userId", start.alias("start"), end.alias("end"))


@query("billing_window", f"SELECT userId, strftime(s, '%Y-%m-%d %H:%M:%S') AS starts, strftime({_plus('s', '1')}, '%Y-%m-%d %H:%M:%S') AS ends FROM {WINDOW_SQL}")
def billing_window(v: Views):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return billing(v).select("userId", shown("start").alias("starts"), shown("end").alias("ends"))


@query("plan_expiry", f"SELECT userId, strftime({_plus('createdAt', 'CASE WHEN userId % 2 = 0 THEN 12 ELSE 1 END')}, '%Y-%m-%d %H:%M:%S') AS expiry FROM clients")
def plan_expiry(v: Views):
    """A year or a month later, by the cycle."""
    months = F.when(C("userId") % 2 == 0, 12).otherwise(1)
    return v.clients.select("userId", F.date_format(dates.add_months_overflow(C("createdAt"), months), "yyyy-MM-dd HH:mm:ss").alias("expiry"))
