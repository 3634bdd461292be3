"""Search by indexes: vectors by cells, keywords by trigrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import keywords, vectors
from parlance.plans.registry import query
from parlance.sources.views import Views

C = F.col
K, RECALL = 3, 0.95
PAYLOAD = ["id", "user_id", "url", "title", "type", "text"]
FIELDS = ["content", "title", "url"]
WORDS = ["Title 17", "elle", "site7.", "zx", "nothing-like-this"]
ANY = " OR ".join(f"coalesce(contains(lower({f}), '{w.lower()}'), false)" for w in WORDS for f in FIELDS)


@query("vector_index_topk")
def vector_index_topk(v: Views):
    """The three most similar points of every point, by the index, with their payload."""
    points = v.points.select("id", "vector")
    index = vectors.tune(vectors.build(points), points, K, RECALL)
    hits = vectors.search(index, points, K)
    return vectors.with_payload(hits, v.points.select(*PAYLOAD)).select("q", "rank", "score", *PAYLOAD)


@query("vector_index_owner_topk")
def vector_index_owner_topk(v: Views):
    """The same among the points of the question's owner; a point without owner finds none."""
    points = v.points.filter("user_id is not null").select("id", "vector", "user_id")
    index = vectors.tune(vectors.build(points, ["user_id"]), points, K, RECALL)
    hits = vectors.search(index, points, K)
    return vectors.with_payload(hits, v.points.select(*PAYLOAD)).select("q", "rank", "score", *PAYLOAD)


@query("search_indexed", f"SELECT id, title, url FROM tdocs WHERE {ANY}")
def search_indexed(v: Views):
    """Training documents with any keyword in any field, read by candidates of the index."""
    rows = v.tdocs.select("id", *FIELDS)
    return keywords.search(keywords.build(rows, FIELDS), rows, WORDS).select("id", "title", "url")
