"""URL filters: listed rules first, then the host's reputation.

A rule names a host and the start of a path.  It fits its host and all
subdomains; of the rules that fit, the longest decides.  Where none fits, the
host's reputation does: labelled outcomes (bad or not) are counted for each host
and shrunk through beta-binomial priors, from suffix to registered domain to
host.  Each level's prior has the mean of its parent's posterior and a strength
fitted by moments over all groups of the level; a host is blocked if its share of bad
pages lies above ``LIFT`` times that of all pages with a probability of ``SURE`` under
its beta posterior, that is if the lower bound of its credible interval does.
Hosts without labels get their domain's posterior mean, with the prior alone.  Where
outcomes do not depend on hosts, priors are strong and no host is blocked.

Counts cover all labelled pages, are summed before the shuffle, and only a table with a
row per host is joined to the pages; tables of hosts, domains and suffixes are broadcast
if their rows, counted, are few.  The beta distribution is computed for host rows only.

Defined cases: a null url or one without ``://`` has an empty host and path, no
rule and the reputation of the empty host; pages without a label count for
nothing, repeated rows each count; without any label every host is allowed; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.urls import TWO_PART

from .shared import ship_package, stored

#: (verdict, host, path): fixed values.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: A host is judged against so many times the share of bad pages among all labelled ones.
LIFT = 1.0
#: Posterior probability of a larger share from which a host is blocked.
SURE = 0.95
#: Hosts up to which their table (about 60 bytes each) is broadcast.
SMALL = 500_000
#: Bounds of the correlation within groups: a prior counts as one page at least.
RHO = (0.001, 0.5)


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct of ``rule, verdict`` of the longest rule that fits; null if none."""
    case = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        case = F.when(fits, out) if case is None else case.when(fits, out)
    return case


def registered_domain(host: Column) -> Column:
    """The last two labels, or three under a suffix of two; port and user go."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    parts = F.when(F.substring_index(name, ".", -2).isin(TWO_PART), -3).otherwise(-2)
    return F.when(parts == -3, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix_of(domain: Column) -> Column:
    two = F.substring_index(domain, ".", -2)
    return F.when(two.isin(TWO_PART), two).otherwise(F.substring_index(domain, ".", -1))


def strength(groups: DataFrame) -> tuple[float, float]:
    """Mean and prior strength of ``n, bad`` counts, by moments.

    Three sums over all groups give the between-group share ``rho`` of the
    variance; the strength of a beta prior is ``1 / rho - 1``.
    """
    s = groups.agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("bb"),
    ).first()
    if not s["n"]:
        return 0.0, 1.0
    n, k, mean = float(s["n"]), s["k"], s["bad"] / s["n"]
    spread = s["bb"] - n * mean * mean  # the sum of n (p - mean)^2
    scale = mean * (1 - mean) * ((n - s["nn"] / n) - (k - 1))
    rho = (spread - mean * (1 - mean) * (k - 1)) / scale if scale > 0 else RHO[1]
    rho = min(max(rho, RHO[0]), RHO[1])
    return mean, 1 / rho - 1


def beta_below(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """Probability that a beta variable lies below ``x``, by the continued fraction."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if x <= 0 or x >= 1:
        return np.full(len(a), float(x >= 1))
    turned = x > (a + 1) / (a + b + 2)  # the fraction converges fast on one side
    p, q = np.where(turned, b, a), np.where(turned, a, b)
    z = np.where(turned, 1 - x, x)
    log = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log(p + q) - log(p) - log(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(p), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h, k = d.copy(), 0
    while len(h):
        k += 1
        steps = []
        for part in (k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1))):
            d, c = 1 + part * d, 1 + part / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            steps.append(c * d)
            h = h * c * d
        if (np.abs(steps[-1] - 1) < 1e-14).all():
            break
    below = front * h
    return np.where(turned, 1 - below, below)


def few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has ``SMALL`` rows at most."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def host_reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host, n, bad, mean, above`` for every row of ``hosts``.

    ``outcomes`` holds ``host, bad`` for each labelled page; ``above`` is the probability
    that the host's share of bad pages lies above ``LIFT`` times that of all pages.
    """
    ship_package(hosts.sparkSession)
    by_host = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    level = hosts.select("host").join(by_host, "host", "left").select(
        "host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")
    ).withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    level = stored(level, "hosts")
    domains = stored(level.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    seen = F.col("n") > 0
    mean, k_suffix = strength(suffixes.filter(seen))
    _, k_domain = strength(domains.filter(seen))
    _, k_host = strength(level.filter(seen))
    base = level.agg(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0))).first()[0] or 0.0
    limit = LIFT * base

    def shrunk(prior: Column, k: float) -> Column:
        return (F.col("bad") + prior * k) / (F.col("n") + k)

    @F.pandas_udf("double")
    def above(bad: pd.Series, good: pd.Series) -> pd.Series:
        # without a label, or if no page is bad, nothing speaks against a host
        return pd.Series(1 - beta_below(np.maximum(bad, 1e-9), np.maximum(good, 1e-9), limit) if limit else np.zeros(len(bad)))

    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), k_suffix).alias("suffix_mean"))
    domains = domains.join(few(suffixes), "suffix").select("domain", shrunk(F.col("suffix_mean"), k_domain).alias("domain_mean"))
    posterior = level.join(few(domains), "domain").withColumn("mean", shrunk(F.col("domain_mean"), k_host))
    size = F.col("n") + k_host
    return posterior.select("host", "n", "bad", "mean", above(F.col("mean") * size, (1 - F.col("mean")) * size).alias("above"))


def judge_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    ``labels`` has ``page_id, bad``.
    """
    split = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    outcomes = split.join(labels.select("page_id", "bad"), "page_id").select("host", "bad")
    reputation = host_reputation(outcomes, split.select("host").distinct())
    blocked = few(stored(reputation.select("host", (F.col("above") >= SURE).alias("blocked"), "mean"), "reputation"))
    found = rule_of(F.col("host"), F.col("path"))
    return split.join(blocked, "host", "left").select(
        "page_id", "host", "path",
        found["rule"].alias("rule"),
        F.coalesce(found["verdict"], F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.round("mean", 6).alias("host_bad"),
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """``page_id, bad``: a page is bad if its label says low quality or toxic."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return labels.select(F.col("doc_id").cast("long").alias("page_id"), bad.alias("bad"))


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; the labels of equal ids are their outcomes."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, page_outcomes(spark.read.parquet(f"{sf_dir}/labels.parquet")))
