"""URL verdicts: explicit rules first, then trust and distrust that spread over the host graph.

Rules name a host suffix and a path prefix; the longest that fits decides. For pages that no rule
fits, the host decides: trust is a personalised PageRank that starts from the hosts of allowed
pages and follows links; distrust starts from the hosts of blocked pages and follows links
backwards, so a host that links to blocked hosts is suspect. A host's seed is the share of its
pages that rules allow (or block), and both ranks are sums over link paths of that seed, damped
at every step. A host is blocked when its distrust exceeds its trust by ``threshold``, the rank
which a host without links reaches when half of its pages are blocked.

Everything is joins and aggregates. Links are reduced to weighted host pairs before any
iteration, so a host that owns a third of all pages is one row per neighbour; sums per host
combine on the map side; the join of ranks with edges may be split by adaptive execution.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import staged


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The name of the longest rule that fits (host, its subdomains; path prefix), else null."""
    fit = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        covers = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        fit = F.when(covers & F.startswith(path, F.lit(rule.path)), F.lit(rule.name)).otherwise(fit)
    return fit


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links): links between different hosts, counted. Relative links stay on their
    host and are no edges."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""), 1)
    targets = F.filter(F.transform(found, lambda u: host_of(F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("x:"), u)).otherwise(u))), lambda h: h != "")
    pairs = pages.select(host_of(F.col(url)).alias("src"), F.explode(targets).alias("dst"))
    return pairs.filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(seeds: DataFrame, links: DataFrame, tolerance: float, damping: float, label: str) -> DataFrame:
    """Personalised PageRank: (host, seed) and (src, dst, links) -> (host, rank).

    ``rank = (1 - damping) * seed + damping * sum over links of rank * share``, until no host lacks
    ``tolerance``: ranks only grow, and what all steps to come add to all hosts together is at most
    damping / (1 - damping) times what the last step added. Each step's ranks are written to the shared
    folder, so the plan does not grow and a lost executor repeats one step at most.
    """
    share = links.groupBy("src").agg(F.sum("links").alias("out"))
    edges = staged(links.join(share, "src").select("src", "dst", (F.col("links") / F.col("out")).alias("share")), f"{label}-edges")
    base = seeds.select("host", ((1 - damping) * F.col("seed")).alias("base"))
    rank = base.withColumnRenamed("base", "rank")
    if edges.isEmpty():
        return rank  # no step would move anything
    whole, more = base.agg(F.sum("base")).first()[0] or 0.0, float("inf")
    # sums of that many ranks can't be told apart any closer
    while more * damping > (1 - damping) * max(tolerance, 1e-12 * whole):
        sent = edges.join(rank.filter("rank > 0").withColumnRenamed("host", "src"), "src")
        got = sent.groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = base.join(got, "host", "full_outer").select("host", (F.coalesce("base", F.lit(0.0)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        rank = staged(rank, f"{label}-rank")
        before, whole = whole, rank.agg(F.sum("rank")).first()[0] or 0.0
        more = whole - before
    return rank


def judge_urls(pages: DataFrame, rules: list[UrlRule], tolerance: float = 1e-6, damping: float = 0.85, threshold: float = 0.075) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages``
    (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path: no rule fits it, it takes no part
    in the graph and it is allowed, as is any host without evidence. A null html has no links.
    Repeated rows count as often as they occur; an empty table gives an empty result; other
    columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    verdicts = F.lit(None).cast("string")
    for rule in rules:
        verdicts = F.when(F.col("rule") == rule.name, F.lit(rule.verdict)).otherwise(verdicts)
    ruled = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("by_rule", verdicts)
    links = staged(host_links(pages), "url-links")
    seeds = staged(
        ruled.filter("host <> ''").groupBy("host").agg(
            (F.count(F.when(F.col("by_rule") == "allow", 1)) / F.count("*")).alias("allowed"), (F.count(F.when(F.col("by_rule") == "block", 1)) / F.count("*")).alias("blocked"),
        ),
        "url-seeds",
    )
    trust = spread(seeds.select("host", F.col("allowed").alias("seed")), links, tolerance, damping, "trust").withColumnRenamed("rank", "trust")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = spread(seeds.select("host", F.col("blocked").alias("seed")), back, tolerance, damping, "distrust").withColumnRenamed("rank", "distrust")
    hosts = trust.join(distrust, "host", "full_outer").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    by_method = F.when(F.col("distrust") - F.col("trust") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
