"""URL filter: path rules, and link-graph propagation where no rule speaks.

Trust starts at hosts with pages that an allow rule fits and follows links;
distrust starts at hosts with pages that a block rule fits and follows links
backwards (who links to bad hosts is suspect).  Both are personalised PageRanks
over host edges.  A host is blocked when distrust makes up more than a set share
of what reached it; a host that nothing reached stays allowed.

Edges are the absolute links of the pages, summed per pair of hosts, and the ties
between a host and its parent domain, so that a domain vouches for its subdomains.

Masses are whole numbers (``UNITS`` in total), rounded down per edge: their sums
do not depend on the order of rows, so reruns agree to the last unit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, quoted, written

UNITS = 10**15
DAMPING = 0.85
ROUNDS = 10
DOMAIN_LINKS = 1  # a tie to the parent domain weighs as much as one link
DISTRUST_SHARE = 0.5
ROUNDS_PER_CUT = 5
HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (name, verdict), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    if not ordered:
        return F.lit(None).cast("struct<name:string,verdict:string>")
    found = None
    for rule in ordered:
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        what = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, what) if found is None else found.when(fits, what)
    return found


def parent_domain(host: Column) -> Column:
    """The host without its first label, null once fewer than two labels would be left."""
    return F.when(host.rlike(r"^[^.]+\.[^.]+\."), F.regexp_replace(host, r"^[^.]+\.", ""))


def host_edges(pages: DataFrame, *, domain_links: int = DOMAIN_LINKS) -> DataFrame:
    """``(src, dst, links)`` between different hosts; ``pages`` has host and html."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("to"))
    links = links.select("src", F.translate("to", UPPER, LOWER).alias("dst"))
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))
    hosts = pages.select("host").distinct().union(links.select("dst")).distinct()
    ties = []
    for _ in range(3):  # up to three labels above a host
        above = hosts.select(F.col("host").alias("src"), parent_domain(F.col("host")).alias("dst")).filter("dst IS NOT NULL")
        ties += [above, above.select(F.col("dst").alias("src"), F.col("src").alias("dst"))]
        hosts = above.select(F.col("dst").alias("host")).distinct()
    for tie in ties:
        links = links.unionByName(tie.distinct().withColumn("links", F.lit(domain_links).cast("bigint")))
    real = links.filter("src <> dst AND src <> '' AND dst <> ''")
    return real.groupBy("src", "dst").agg(F.sum("links").alias("links"))


def propagate(
    edges: DataFrame,
    seeds: DataFrame,
    *,
    rounds: int = ROUNDS,
    damping: float = DAMPING,
    units: int = UNITS,
) -> DataFrame:
    """``(kind, host, mass)`` after ``rounds`` steps.

    ``seeds`` has kind ('trust' or 'distrust'), host and weight.  Trust leaves a
    host by its links in proportion to their number, distrust by the links that
    point to it.  Mass at a host without way out is lost, as it would say nothing.
    """
    ways = edges.selectExpr("'trust' AS kind", "src AS host", "dst AS target", "links").unionByName(
        edges.selectExpr("'distrust' AS kind", "dst AS host", "src AS target", "links")
    )
    totals = ways.groupBy(F.col("kind").alias("k"), F.col("host").alias("h")).agg(F.sum("links").alias("total"))
    shares = ways.join(totals, (F.col("kind") == F.col("k")) & (F.col("host") == F.col("h")))
    share = F.col("links").cast("double") / F.col("total").cast("double")
    shares = written(shares.select("kind", "host", "target", share.alias("share")), "url-shares")
    sums = seeds.groupBy(F.col("kind").alias("k")).agg(F.sum("weight").alias("total"))
    start = F.floor(F.lit(float(units)) * (F.col("weight").cast("double") / F.col("total").cast("double")))
    start = seeds.join(sums, F.col("kind") == F.col("k")).select("kind", "host", start.cast("bigint").alias("mass"))
    start = written(start, "url-seeds")
    back = start.select("kind", "host", F.floor(F.col("mass").cast("double") * (1.0 - damping)).cast("bigint").alias("mass"))
    mass = start
    for done in range(1, rounds + 1):
        sent = F.floor(F.col("mass").cast("double") * damping * F.col("share")).cast("bigint")
        moved = shares.join(mass, ["kind", "host"]).select("kind", F.col("target").alias("host"), sent.alias("mass"))
        mass = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("mass").alias("mass")).filter("mass > 0")
        if done % ROUNDS_PER_CUT == 0 or done == rounds:
            mass = written(mass, "url-mass")
    return mass


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    rounds: int = ROUNDS,
    damping: float = DAMPING,
    distrust_share: float = DISTRUST_SHARE,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for every page.

    A null url, or one without ``://``, has empty host and path; no rule fits it
    and nothing reaches it, so it is allowed.  A null html has no links.  Repeated
    rows are judged alike and each adds its weight to its host's seed.
    """
    address = quoted(url)
    located = pages.select(quoted(page_id).alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"))
    ruled = located.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"))
    seeds = (
        ruled.filter("fit IS NOT NULL")
        .groupBy(F.when(F.col("fit.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    edges = host_edges(pages.select(host_of(address).alias("host"), quoted(html).alias("html")))
    mass = propagate(edges, seeds, rounds=rounds, damping=damping)
    by_host = mass.groupBy(F.col("host").alias("h")).agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0)).alias("distrust"),
    )
    by_host = written(by_host, "url-hosts")
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    suspect = distrust.cast("double") > F.lit(distrust_share) * (trust + distrust).cast("double")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(suspect, "block").otherwise("allow"))
    return ruled.join(by_host, F.col("host") == F.col("h"), "left").select(
        "page_id", "host", "path", F.col("fit.name").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
