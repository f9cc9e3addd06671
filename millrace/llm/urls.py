"""URL filters: rules by host and path, and trust over the link graph of hosts.

Every url gets a host and a path; the longest fitting rule decides. Where none
fits, two personalised PageRanks over host edges decide: trust flows along
links from hosts whose pages rules allow, distrust flows against links from
hosts whose pages rules block (who links to blocked hosts is suspect). A host is
blocked if distrust makes up at least ``threshold`` of both.

Edges are counted by pair of hosts before any shuffle of pages, ranks are joined
to edges by host and salt, so that a host with very many links is several keys,
and rounds are cut from their lineage in the shared checkpoint folder; neither
hosts nor edges reach the driver. Verdicts meet pages by broadcast where a count
shows at most ``FEW_HOSTS``, else by host and salt.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no rule; hosts without links or seeds are allowed; null html has no links;
repeated pages count as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import written


#: Hosts up to which verdicts go out by broadcast, about 5 MB, and parts that a host's links and pages are dealt to.
FEW_HOSTS, SALTS = 100_000, 16


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    return pages.withColumn("host", ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    pick = lambda value: reduce(lambda c, r: c.when(r.fits(), F.lit(value(r))), ordered[1:], F.when(ordered[0].fits(), F.lit(value(ordered[0])))) if ordered else F.lit(None).cast("string")
    return pages.withColumn("rule", pick(lambda r: r.name)).withColumn("rule_verdict", pick(lambda r: r.verdict))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: links between different hosts, counted."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    links = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    return links.select("src", ascii_lower(F.col("dst")).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def page_rank(edges: DataFrame, seeds: DataFrame, rounds: int = 10, damping: float = 0.85, keep_every: int = 3) -> DataFrame:
    """``host, score``: PageRank that restarts at ``seeds`` (host, weight).

    What dangling hosts hold is lost rather than dealt to all hosts, which
    changes no order between hosts.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    # Each host's sum meets its links, and its rank does so in every round.
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"))
    step = written(dealt.join(out.withColumn("salt", parts), ["src", "salt"]).select("src", "salt", "dst", (F.col("weight") / F.col("out")).alias("share")), "steps")
    start = seeds.select("host", F.col("weight").alias("restart"))
    ranks = start.select("host", F.col("restart").alias("score"))
    for i in range(rounds):
        flow = step.join(ranks.select(F.col("host").alias("src"), "score", parts.alias("salt")), ["src", "salt"]).select(F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        restart = start.select("host", ((1 - damping) * F.col("restart")).alias("score"))
        ranks = flow.unionAll(restart).groupBy("host").agg(F.sum("score").alias("score"))
        if (i + 1) % keep_every == 0 and i + 1 < rounds:
            ranks = written(ranks, "ranks")
    return ranks


def host_verdicts(pages: DataFrame, rounds: int = 10, threshold: float = 0.5) -> DataFrame:
    """``host, trust, distrust, host_verdict`` for pages with host and rule_verdict."""
    hosts = pages.filter(F.col("host") != "").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    ruled = F.col("allowed") + F.col("blocked")
    hosts = written(hosts.filter(ruled > 0).select("host", (F.col("allowed") / ruled).alias("good"), (F.col("blocked") / ruled).alias("bad")), "hosts")
    edges = written(host_edges(pages), "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    good = hosts.filter("good > 0").select("host", F.col("good").alias("weight"))
    bad = hosts.filter("bad > 0").select("host", F.col("bad").alias("weight"))
    if edges.isEmpty():  # no flow: one round gives what any number of them does
        rounds = min(rounds, 1)
    trust = page_rank(edges, good, rounds).select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust"))
    distrust = page_rank(back, bad, rounds).select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust"))
    both = trust.unionAll(distrust).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    block = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    return written(both.withColumn("host_verdict", F.when(block, "block").otherwise("allow")), "verdicts")


def judge(pages: DataFrame, rules: list[Rule], rounds: int = 10, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page."""
    ruled = with_rule(split_url(pages.select("page_id", "url", "html")), rules)
    verdicts = host_verdicts(ruled, rounds, threshold)
    light = ruled.drop("html", "url")
    by_rule = light.filter("rule is not null").select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("trust"), F.lit(None).cast("double").alias("distrust"))
    unruled = light.filter("rule is null")
    if verdicts.count() <= FEW_HOSTS:
        met = unruled.join(F.broadcast(verdicts), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
        met = unruled.withColumn("salt", salt).join(verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    rest = met.select("page_id", "host", "path", "rule", F.coalesce("host_verdict", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return by_rule.unionAll(rest)
