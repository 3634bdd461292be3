"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import codes, quality, trie, urls

QUALITY = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
 windows AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM w WHERE len(w) >= {quality.WINDOW})),
 twins AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
 covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS p FROM twins) GROUP BY doc_id),
 c AS (SELECT w.doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
 b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words
 OR word_chars > 20 * n_words OR 5 * len(regexp_extract_all(t, '[!?]{{2,}}')) > n_words OR 10 * len(regexp_extract_all(t, '(?:^|\\n)[\\x20\\t]*[-*\u2022]')) > 9 * n_lines OR 10 * len(regexp_extract_all(t, '(?:\\.\\.\\.|\u2026)[\\x20\\t]*(?:\\n|$)')) > 3 * n_lines
 OR 2 * length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) < word_chars) AS kept FROM b"""

REVISITS = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest"""


def _strength(table: str) -> str:
    """One row: mean and prior strength of a table with n and bad."""
    low, high = urls.RHO
    return f"""(SELECT m, 1 / least(greatest(CASE WHEN m * (1 - m) * ((n - nn / n) - (k - 1)) > 0 THEN (bb - n * m * m - m * (1 - m) * (k - 1)) / (m * (1 - m) * ((n - nn / n) - (k - 1))) ELSE {high} END, {low}), {high}) - 1 AS s
 FROM (SELECT sum(bad)::DOUBLE / sum(n) AS m, sum(n)::DOUBLE AS n, count(*) AS k, sum(n::DOUBLE * n) AS nn, sum(bad::DOUBLE * bad / n) AS bb FROM {table} WHERE n > 0))"""


def _rules() -> tuple[str, str]:
    ordered = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(v, h, p)}'" for v, h, p in ordered) + " END"
    return case(lambda v, h, p: h + p), case(lambda v, h, p: v)


RULE, VERDICT = _rules()
TWO = ", ".join(f"'{x}'" for x in urls.TWO_PART)
NAME = r"regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '')"

#: Steps of the continued fraction; it needs about the root of the largest count.
STEPS = 600

HOSTS = f"""WITH RECURSIVE p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 o AS (SELECT host, coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS bad FROM p JOIN labels ON page_id = doc_id),
 h AS (SELECT host, coalesce(n, 0) AS n, coalesce(b, 0) AS bad, string_split({NAME}, '.') AS parts FROM (SELECT DISTINCT host FROM p) LEFT JOIN (SELECT host, count(*) AS n, count(*) FILTER (WHERE bad) AS b FROM o GROUP BY host) USING (host)),
 d0 AS (SELECT host, n, bad, array_to_string(CASE WHEN array_to_string(list_slice(parts, -2, -1), '.') IN ({TWO}) THEN list_slice(parts, -3, -1) ELSE list_slice(parts, -2, -1) END, '.') AS domain FROM h),
 hosts AS (SELECT *, CASE WHEN array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') IN ({TWO}) THEN array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') ELSE string_split(domain, '.')[-1] END AS suffix FROM d0),
 domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY 1, 2),
 suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY 1),
 a AS (SELECT suffix, (bad + m * s) / (n + s) AS mean FROM suffixes, {_strength('suffixes')}),
 b AS (SELECT domain, (bad + mean * s) / (n + s) AS mean FROM domains JOIN a USING (suffix), {_strength('domains')}),
 c AS (SELECT host AS named, (bad + mean * s) / (n + s) AS mean, n + s AS size FROM hosts JOIN b USING (domain), {_strength('hosts')}),
 x AS (SELECT {urls.LIFT} * sum(bad) / sum(n) AS x FROM hosts),
 e AS (SELECT *, greatest(mean * size, 1e-9) AS a, greatest((1 - mean) * size, 1e-9) AS b FROM c, x),
 t AS (SELECT named, x > (a + 1) / (a + b + 2) AS turned, CASE WHEN turned THEN b ELSE a END AS p, CASE WHEN turned THEN a ELSE b END AS q, CASE WHEN turned THEN 1 - x ELSE x END AS z FROM e WHERE x > 0 AND x < 1),
 f AS (SELECT *, 0 AS k, 1::DOUBLE AS c, 1 / (1 - (p + q) * z / (p + 1)) AS d, d AS h FROM t
  UNION ALL SELECT named, turned, p, q, z, k, c2, d2, h * c1 * d1 * c2 * d2 FROM (SELECT *, 1 / (1 + e2 * d1) AS d2, 1 + e2 / c1 AS c2 FROM (SELECT *, 1 / (1 + e1 * d) AS d1, 1 + e1 / c AS c1 FROM
   (SELECT named, turned, p, q, z, k + 1 AS k, c, d, h, (k + 1) * (q - k - 1) * z / ((p + 2 * k + 1) * (p + 2 * k + 2)) AS e1, -(p + k + 1) * (p + q + k + 1) * z / ((p + 2 * k + 2) * (p + 2 * k + 3)) AS e2 FROM f WHERE k < {STEPS})))),
 g AS (SELECT named, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(z) + q * ln(1 - z)) / p * h AS v, CASE WHEN turned THEN v ELSE 1 - v END AS above FROM f WHERE k = {STEPS})
SELECT page_id, host, path, {RULE} AS rule, coalesce({VERDICT}, CASE WHEN above >= {urls.SURE} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS host_bad FROM p JOIN c ON host = c.named LEFT JOIN g ON host = g.named"""


def _lloyd() -> str:
    """Lloyd rounds over all pairs of parts and entries; float sums of integers below 2^53 are exact."""
    near = lambda k, more="": f"""SELECT p, vec_id, s, min((xx + zz - 2 * list_inner_product(x, z))::BIGINT * {codes.ENTRIES} + e) AS best{more} FROM parts JOIN book{k} USING (p) GROUP BY ALL"""
    steps = []
    for k in range(codes.ROUNDS):
        steps.append(f"""assigned{k} AS MATERIALIZED ({near(k)}),
 mean{k} AS (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY j) AS c FROM (SELECT p, best % {codes.ENTRIES} AS e, j, sum(s[j])::BIGINT AS t, count(*) AS n FROM assigned{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(s)) FROM parts))) AS j) GROUP BY ALL) GROUP BY ALL),
 book{k + 1} AS MATERIALIZED (SELECT *, list_inner_product(z, z) AS zz FROM (SELECT p, e, coalesce(m.c, b.c) AS c, coalesce(m.c, b.c)::DOUBLE[] AS z FROM book{k} b LEFT JOIN mean{k} m USING (p, e)))""")
    return f"""WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 parts AS MATERIALIZED (SELECT *, s::DOUBLE[] AS x, list_inner_product(s::DOUBLE[], s::DOUBLE[]) AS xx FROM (SELECT vec_id, r, p, v[p * (len(v) // {codes.PARTS}) + 1:(p + 1) * (len(v) // {codes.PARTS})] AS s FROM kept, (SELECT unnest(range({codes.PARTS})) AS p))),
 book0 AS MATERIALIZED (SELECT p, r - 1 AS e, s AS c, x AS z, xx AS zz FROM parts WHERE r <= {codes.ENTRIES}),
 {", ".join(steps)},
 last AS MATERIALIZED ({near(codes.ROUNDS)}),
 coded AS (SELECT vec_id, string_agg(printf('%02x', best % {codes.ENTRIES}), '' ORDER BY p) AS code, sum(best // {codes.ENTRIES})::BIGINT AS error FROM last GROUP BY vec_id),
 digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{codes.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"""


LLOYD = _lloyd()

#: CRC-32 of a decimal number: its digits byte by byte, bit by bit.
CRC = """xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: list_reduce(range(8), lambda r, k: xor(r >> 1, (r & 1) * 3988292384), xor(a, b)), 4294967295), 4294967295)"""

#: Prefixes as lists of all their turns, subtrees by comparing lists: quadratic, for small tables.
TRIE = f"""WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(text, '') AS t, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id AS c, conv_id - conv_id % {trie.GROUP} AS f, count(*) AS n, {CRC} % {trie.HEADS} AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
 rebuilt AS (SELECT c.c, p, t, k FROM c JOIN o ON o.c = c.f AND p <= h UNION ALL SELECT c.c, p - c.h + least(c.h, coalesce(f.n, 0)), t, k FROM c JOIN o ON o.c = c.c AND p > c.h LEFT JOIN c f ON f.c = c.f),
 ends AS (SELECT c.c, coalesce(max(p), 0) AS n FROM c LEFT JOIN rebuilt USING (c) GROUP BY c.c),
 members AS (SELECT c, p AS d, t, list(k) OVER (PARTITION BY c ORDER BY p) AS path FROM rebuilt UNION ALL SELECT c, 0, '', CAST([] AS VARCHAR[]) FROM c),
 nodes AS MATERIALIZED (SELECT d, path, min(c) AS c, count(*) AS n, (count(*) - 1) * len(regexp_extract_all(any_value(t), '[^\\x20\\x09-\\x0D]+')) AS w, count(*) FILTER (WHERE ends.n > d) = 0 AS leaf,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends.n = d), '')) AS ends_sha256 FROM members JOIN ends USING (c) GROUP BY d, path),
 sums AS (SELECT n.d, n.path, sum(u.w)::BIGINT AS saved, count(*) FILTER (WHERE u.leaf) AS leaves, count(*) FILTER (WHERE u.d = n.d + 1) AS children FROM nodes n JOIN nodes u ON u.d >= n.d AND u.path[1:n.d] = n.path GROUP BY n.d, n.path)
SELECT nodes.c AS conv_id, nodes.d AS depth, up.c AS parent_conv_id, nodes.n AS n_convs, children AS n_children, leaves AS n_leaves, saved AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums ON nodes.d = sums.d AND nodes.path = sums.path LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.path = nodes.path[1:nodes.d - 1]"""
