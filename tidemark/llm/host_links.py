"""Operator 2: url rules, and trust of hosts by propagation over the link graph.

Rules decide the urls they fit; the longest fitting rule wins. All other urls get the verdict of
their host: trust flows from trusted seed hosts along links (personalised PageRank), distrust flows
from blocked seed hosts against the links (a host that links to bad hosts is bad), and a host
whose distrust outweighs its trust is blocked.

A host is a seed if rules decide at least half of its pages and more of them one way than the
other; its seed weight is the share of its pages decided that way. Link targets are read from
absolute links (href or src) in the html; relative links stay on their host and carry nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

#: (rule, verdict): host, then the beginning of the path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DAMPING = 0.85
#: The sum of all changes in a round at which propagation has settled, relative to the seeds' mass.
SETTLED = 1e-6
#: Rounds after which it has settled on any graph: each round's changes are at most DAMPING times the last one's.
ROUNDS = math.ceil(math.log(SETTLED) / math.log(DAMPING)) + 1
#: A host without a rule is blocked if distrust > BLOCK_RATIO * trust + BLOCK_FLOOR * mean seed mass.
BLOCK_RATIO = 1.0
BLOCK_FLOOR = 1e-3

_LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: str) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null without one."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        fits = _fits(host, path, text)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def ruled_pages(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (its verdict)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    return split.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts, counted."""
    target = F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link")
    links = pages.where(F.col("html").contains("//")).select(host_of(F.col("url")).alias("src"), target)
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return (
        links.select("src", host_of(absolute).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links")))


def host_seeds(ruled: DataFrame) -> DataFrame:
    """(host, trusted, blocked): seed weights between 0 and 1."""
    counts = ruled.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    decided = 2 * (F.col("good") + F.col("bad")) >= F.col("n")
    return counts.select(
        "host", F.when(decided & (F.col("good") > F.col("bad")), F.col("good") / F.col("n")).otherwise(0.0).alias("trusted"),
        F.when(decided & (F.col("bad") > F.col("good")), F.col("bad") / F.col("n")).otherwise(0.0).alias("blocked"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, mass): personalised PageRank from seeds (host, mass) over edges (src, dst, links).

    mass = (1 - damping) * seed + damping * inflow. A host without links out keeps nothing for
    others: its outflow returns to nobody. The masses of each round are written to the shared
    folder; edges with one hot source or target meet pre-aggregated sums.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("all_links"))
    shares = stage(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("all_links")).alias("share")), "shares")
    base = seeds.select("host", ((1 - damping) * F.col("mass")).alias("mass"))
    current, total = base, seeds.agg(F.sum("mass")).first()[0] or 0.0
    if total == 0 or shares.isEmpty():
        return base
    for _ in range(rounds):
        inflow = current.join(shares, current["host"] == shares["src"]).groupBy("dst").agg(
            F.sum(damping * F.col("mass") * F.col("share")).alias("mass")).select(F.col("dst").alias("host"), "mass")
        after = stage(base.union(inflow).groupBy("host").agg(F.sum("mass").alias("mass")), "masses")
        change = after.alias("a").join(current.alias("b"), "host", "left").agg(
            F.sum(F.abs(F.col("a.mass") - F.coalesce("b.mass", F.lit(0.0))))).first()[0]
        current = after
        if change <= SETTLED * total:
            break
    return current


def host_verdicts(pages: DataFrame, ruled: DataFrame) -> DataFrame:
    """(host, trust, distrust, blocked) of all hosts with pages."""
    seeds = stage(host_seeds(ruled), "seeds")
    edges = stage(host_edges(pages), "edges")
    trust = propagate(seeds.select("host", F.col("trusted").alias("mass")).where("mass > 0"), edges)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = propagate(seeds.select("host", F.col("blocked").alias("mass")).where("mass > 0"), back)
    scores = (
        seeds.select("host").join(trust.select("host", F.col("mass").alias("trust")), "host", "left")
        .join(distrust.select("host", F.col("mass").alias("distrust")), "host", "left").fillna(0.0, ["trust", "distrust"]))
    floor = BLOCK_FLOOR * (1 - DAMPING)
    return scores.withColumn("blocked", F.col("distrust") > BLOCK_RATIO * F.col("trust") + floor)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per row of pages.

    A null url or one without :// has an empty host and path, no rule and the verdict allow: no
    host can speak against it. A null html has no links. Repeated rows count as often as they
    come; other columns are ignored.
    """
    ruled = ruled_pages(pages, rules)
    verdicts = stage(host_verdicts(pages, ruled), "hosts")
    joined = ruled.join(verdicts, "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
