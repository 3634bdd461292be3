"""Domain tables as views over the Parquet inputs.

Each view is a base table (or a join of two) and a list of expressions in the
SQL subset that Spark and DuckDB share, so that one definition serves the
DataFrame (:class:`Views`) and the oracle's common table expression
(:func:`with_views`).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name: (FROM clause, expressions)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "convs": ("orders", [
        "o_orderkey AS id", "o_custkey AS visitor", "o_custkey % 10 AS userId", "o_orderkey % 20 AS agentId", "o_orderdate AS createdAt",
        "CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'close' END AS status", "o_orderstatus <> 'P' AS is_started",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN false WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE true END AS aiChat",
        "CASE WHEN o_orderpriority = '2-HIGH' THEN true WHEN o_orderpriority = '5-LOW' THEN false ELSE NULL END AS feedback",
        "CASE WHEN o_orderstatus = 'F' THEN true ELSE NULL END AS visitorClosed",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey % 30 ELSE NULL END AS humanAgentId",
        "o_orderkey % 7 AS newMessage", "o_totalprice AS score",
    ]),
    "visitors": ("customer JOIN nation ON c_nationkey = n_nationkey", [
        "c_custkey AS id", "c_name AS name", "c_custkey % 10 AS userId", "c_custkey % 20 AS agentId",
        "CASE WHEN c_nationkey % 6 = 0 THEN NULL WHEN c_nationkey % 11 = 0 THEN '' ELSE n_name END AS location",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('user', cast(c_custkey AS STRING), '@mail.test') END AS email",
        "concat('10.0.0.', cast(c_custkey % 50 AS STRING)) AS ip", "c_acctbal AS balance",
    ]),
    "clients": ("supplier", [
        "s_suppkey AS userId", "s_name AS name", "concat('client', cast(s_suppkey AS STRING), '@shop.test') AS email",
        "CASE s_nationkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'business' ELSE NULL END AS plan",
        "CASE WHEN s_suppkey % 5 = 0 THEN 'inactive' ELSE 'active' END AS planStatus",
        "s_acctbal AS totalAmountPaid", "cast(floor(abs(s_acctbal) * 1000) AS BIGINT) AS currentDataSize",
        "TIMESTAMP '2024-01-29 10:30:00' + s_suppkey * INTERVAL '1' DAY AS createdAt",
        "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-12-30 00:00:00' + s_suppkey * INTERVAL '1' DAY END AS planExpiry",
        "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-03-31 08:00:00' + (s_suppkey % 40) * INTERVAL '1' DAY END AS planPurchaseDate",
        "CASE WHEN s_suppkey % 7 = 0 THEN true WHEN s_suppkey % 7 = 1 THEN NULL ELSE false END AS isDeleted",
        "s_suppkey % 6 = 0 AS isCustomLimits", "CASE WHEN s_suppkey % 12 = 0 THEN NULL ELSE s_suppkey * 10 END AS customMaxQueries",
        "CASE WHEN s_suppkey % 6 = 0 THEN cast(2 AS BIGINT) ELSE NULL END AS customMaxAgents", "s_nationkey AS nation",
    ]),
    "agents": ("part", [
        "p_partkey AS id", "p_partkey % 10 AS userId", "cast(p_size AS BIGINT) AS success",
        "CASE WHEN p_size % 4 = 0 THEN NULL ELSE cast(p_size % 5 AS BIGINT) END AS failed", "cast(p_size + 3 AS BIGINT) AS total",
        "cast(p_size % 9 AS BIGINT) AS filesAdded", "cast(p_size % 13 AS BIGINT) AS faqsAdded",
        "CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS isDeleted", "p_size % 3 <> 0 AS isActive",
        "CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 6 = 1 THEN NULL ELSE p_brand END AS agentName", "p_name AS siteName",
    ]),
    # plans that tenants offer; their names come in any order
    "offers": ("part", [
        "p_partkey AS id", "cast(p_size AS BIGINT) AS userId", "concat(substring(md5(p_name), 1, 6), '-', cast(p_partkey AS STRING)) AS name", "p_brand AS brand",
        "CASE WHEN p_partkey % 5 = 0 THEN 'inactive' ELSE 'active' END AS status", "p_partkey % 7 AS sort", "p_partkey % 11 = 0 AS isDefault",
        "p_partkey * 10 AS maxQueries", "p_partkey % 4 + 1 AS maxAgents",
    ]),
    "widgets": ("part", [
        "p_partkey AS id", "p_partkey % 150 AS agentId", "cast(p_size % 2 AS BIGINT) AS isActive",
        "CASE WHEN p_size % 3 = 0 THEN NULL ELSE 0.2 + (p_size % 5) * 0.1 END AS scoreThreshold",
    ]),
    "hagents": ("nation", [
        "cast(n_nationkey AS BIGINT) AS id", "cast(n_nationkey % 10 AS BIGINT) AS userId", "n_name AS name",
        "CASE WHEN n_nationkey % 4 = 0 THEN 'Pending' ELSE 'Approved' END AS status", "n_nationkey % 2 = 0 AS isActive", "n_nationkey % 5 = 0 AS isClient",
        "CASE WHEN n_nationkey % 7 = 0 THEN true WHEN n_nationkey % 7 = 1 THEN NULL ELSE false END AS isDeleted",
        "cast(n_nationkey AS BIGINT) AS a1", "cast(n_nationkey + 25 AS BIGINT) AS a2", "cast(999999 AS BIGINT) AS a3",
    ]),
    "msgs": ("conversations", [
        "conv_id * 1000 + turn AS id", "conv_id AS conversation_id", "turn", "text AS message",
        "CASE role WHEN 'user' THEN 'visitor' WHEN 'assistant' THEN 'ai' ELSE 'system' END AS sender_type",
        "TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS createdAt",
        "CASE WHEN turn >= 2 THEN conv_id * 1000 + turn - 2 ELSE NULL END AS replyTo",
        "CASE WHEN (conv_id + turn) % 9 = 0 THEN 'true' WHEN (conv_id + turn) % 9 = 1 THEN NULL ELSE 'false' END AS is_note",
        "CASE WHEN role = 'assistant' THEN conv_id % 30 ELSE NULL END AS humanAgentId", "conv_id % 20 AS agentId",
    ]),
    "tags": ("orders", [
        "o_orderkey AS id", "o_orderpriority AS name", "CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey + 1000000 ELSE o_orderkey END AS conversation",
        "o_custkey % 10 AS userId",
    ]),
    "notifs": ("orders", [
        "o_orderkey AS id", "o_custkey % 25 AS humanAgentId", "CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1000000 ELSE o_orderkey END AS conversationId",
        "o_custkey AS visitorId", "o_orderkey % 4 = 0 AS isSeen", "o_orderdate AS createdAt",
    ]),
    "llm_usage": ("events", [
        "event_id AS id", "user_id AS userId", "ts AS date", "cast(floor(value) AS BIGINT) AS tokens", "cast(1 AS BIGINT) AS requests", "value / 1000 AS cost",
        "event_type AS model",
    ]),
    "vec_usage": ("events", [
        "event_id AS id", "user_id AS userId", "ts AS date", "cast(floor(value) AS BIGINT) AS vectorsAdded", "event_id % 5 AS vectorsDeleted",
        "value / 10 AS storageMB", "value / 1000 AS costRequests", "value / 100 AS costStorage",
    ]),
    "tdocs": ("documents LEFT JOIN labels ON documents.doc_id = labels.doc_id", [
        "documents.doc_id AS id", "source AS userId", "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS type",
        "text AS content", "concat('title ', cast(documents.doc_id % 90 AS STRING)) AS title",
        "CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 0 END AS trainingStatus", "n_chars",
        "CASE WHEN lang = 'en' THEN concat('https://www.site', cast(documents.doc_id % 40 AS STRING), '.example.com/p/', cast(documents.doc_id % 7 AS STRING)) ELSE NULL END AS url",
        "CASE WHEN documents.doc_id % 3 = 0 THEN 'free' ELSE 'paid' END AS tier", "documents.doc_id % 20 AS agentId",
    ]),
    "points": ("embeddings", [
        "vec_id AS id", "embedding AS vector", "label AS user_id", "concat('https://a.test/', cast(vec_id % 50 AS STRING)) AS url",
        "CASE WHEN vec_id % 11 = 0 THEN NULL ELSE concat('https://a.test/', cast(vec_id % 50 AS STRING)) END AS maybe_url",
        "concat('Title ', cast(vec_id % 60 AS STRING)) AS title", "concat('chunk text ', cast(vec_id AS STRING)) AS text",
        "CASE vec_id % 4 WHEN 0 THEN 'webpage' WHEN 1 THEN 'snippet' WHEN 2 THEN 'file' ELSE '4' END AS type",
    ]),
    "revised": ("benchmark", ["item_id AS id", "text AS original_question", "concat('answer ', cast(item_id AS STRING)) AS answer"]),
    "asked": ("benchmark", ["item_id AS id", "concat('<p>', text, '&nbsp;</p>') AS question"]),
    "webpages": ("pages", ["page_id AS id", "url", "html", "page_id % 20 AS agentId"]),
    "sites": ("supplier", ["s_suppkey AS userId", "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 20 END AS agentId"]),
    # texts, addresses and colours that scalar functions run over
    "questions": ("conversations", ["conv_id * 1000 + turn AS id", "CASE WHEN (conv_id + turn) % 23 = 0 THEN NULL ELSE text END AS q"]),
    "snippets": ("pages", ["page_id AS id", "html AS t"]),
    "hosts": ("pages", [
        "page_id AS id",
        "CASE page_id % 6 WHEN 0 THEN replace(url, 'https:', '') WHEN 1 THEN replace(url, 'example.com', 'example.co.uk') WHEN 2 THEN substring(url, 9) ELSE url END AS u",
    ]),
    "shades": ("part", [
        "p_partkey AS id",
        "CASE p_partkey % 5 WHEN 0 THEN concat('#', substring(md5(p_name), 1, 3)) WHEN 1 THEN concat('#', upper(substring(md5(p_name), 1, 6)))"
        " WHEN 2 THEN concat('rgb(', cast(p_size * 7 AS STRING), ', ', cast(p_partkey % 300 AS STRING), ',', cast(p_size AS STRING), ')')"
        " WHEN 3 THEN p_type ELSE concat('#', substring(md5(p_type), 1, 6)) END AS c",
    ]),
    "blocked": ("customer", [
        "c_custkey AS id", "concat('10.0.0.', cast(c_custkey % 50 AS STRING)) AS ip", "c_custkey % 10 AS userId",
        "TIMESTAMP '2024-01-10 00:00:00' + (c_custkey % 20) * INTERVAL '1' DAY AS expiresAt",
    ]),
}

#: Literal tables: name: (columns, rows as SQL).
LITERALS: dict[str, tuple[str, str]] = {
    "plans": (
        "name, status, sort, isDefault, maxQueries, maxAgents, maxHumanAgents, maxStorage",
        "('free', 'active', 0, true, 1000, 1, 1, 1048576), ('pro', 'active', 1, false, 5000, 3, 5, 4194304), "
        "('business', 'active', 2, false, 20000, 10, 20, 8388608), ('legacy', 'inactive', 3, false, 500, 1, 1, 524288)",
    ),
}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


class Views:
    """Lazy DataFrames of the inputs and the domain views, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._make(name)
        return self._known[name]

    def _make(self, name: str) -> DataFrame:
        if name in LITERALS:
            columns, rows = LITERALS[name]
            return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})").select(
                *[F.col(c).cast("long").alias(c) if c == "sort" or c.startswith("max") else F.col(c) for c in columns.split(", ")]
            )
        if name in VIEWS:
            source, expressions = VIEWS[name]
            base = re.match(r"(\w+)(?: (LEFT )?JOIN (\w+) ON (.*))?$", source)
            df = getattr(self, base[1]).alias(base[1])
            if base[3]:
                df = df.join(getattr(self, base[3]).alias(base[3]), F.expr(base[4]), "left" if base[2] else "inner")
            return df.selectExpr(*expressions)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """``sql`` behind the common table expressions of the views that it names."""
    parts = []
    for name, (source, expressions) in VIEWS.items():
        if name not in LITERALS and re.search(rf"\b{name}\b", sql):
            listed = ", ".join(expressions).replace("AS STRING)", "AS VARCHAR)")
            parts.append(f"{name} AS (SELECT {listed} FROM {source})")
    for name, (columns, rows) in LITERALS.items():
        if re.search(rf"\b{name}\b", sql):
            listed = ", ".join(f"{c}::BIGINT AS {c}" if c == "sort" or c.startswith("max") else c for c in columns.split(", "))
            parts.append(f"{name} AS (SELECT {listed} FROM (VALUES {rows}) AS t({columns}))")
    if not parts:
        return sql
    if (m := re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)):
        return f"WITH {m[1] or ''}{', '.join(parts)}, {sql[m.end():]}"
    return f"WITH {', '.join(parts)} {sql}"
