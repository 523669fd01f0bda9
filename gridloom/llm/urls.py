"""Operator 5 [native]: URL filters by host and path rules, and by trust and distrust spread over the link graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import spool, unspool

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_BASE = r"""(?i)<base\b[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
#: Links of one host, one way, that meet its score in a task.
SPLIT = 1 << 20


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_for(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest of the rules (verdict, host/path) that fits, as a struct (rule, verdict); null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Of equally long ones the first in
    the order of text counts. The rules are literals of the plan, meant for hundreds at most.
    """
    chain = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chain.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*chain) if chain else F.lit(None).cast("struct<rule:string,verdict:string>")


def _target(link: Column, base: Column) -> Column:
    """The host that a link leads to; of a relative one the base's, of other schemes (mailto:) none."""
    return (
        F.when(F.regexp_like(link, F.lit("(?i)^[a-z][a-z0-9+.-]*://")), url_host(link))
        .when(F.startswith(link, F.lit("//")), url_host(F.concat(F.lit("http:"), link)))
        .when(F.regexp_like(link, F.lit("(?i)^[a-z][a-z0-9+.-]*:")), F.lit(""))
        .otherwise(base)
    )


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted per pair of hosts before anything is shuffled. Links without
    a scheme count by their host, relative ones by the page's base element, if it has one that names a host."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(url_host(F.col(url_col)).alias("src"), F.regexp_extract(html, _BASE, 1).alias("base"), F.regexp_extract_all(html, F.lit(_LINK), 1).alias("links"))
    rows = rows.select("src", _target(F.col("base"), F.lit("")).alias("base"), "links")
    pairs = rows.select("src", F.explode(F.transform("links", lambda x: _target(x, F.col("base")))).alias("dst"))
    return pairs.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, split: int = SPLIT) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from trusted seeds along the links and from blocked ones against them.

    seeds: (host, kind 'trust' or 'distrust'), each host once per kind. A walk follows links by their counts and starts
    again at a random seed with probability 1 - damping; its mass at a host without links ends there. Every round is one
    join and one sum over host pairs, written to the shared folder; what the seeds are given anew is added to the sum.
    Links of a host beyond `split` are dealt to parts, each of which meets the host's score.
    """
    spark = links.sparkSession
    forward = links.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n")
    both, both_path = spool(forward.union(backward), "links")
    total = both.groupBy("kind", "from").agg(F.sum("n").alias("all"), F.ceil(F.count("*") / split).cast("int").alias("parts"))
    walks = both.join(total, ["kind", "from"]).select("kind", "from", "to", (damping * F.col("n") / F.col("all")).alias("w"), F.pmod(F.xxhash64("to"), "parts").cast("int").alias("part"))
    walks, walks_path = spool(walks, "walks")
    large, large_path = spool(total.where("parts > 1").select("kind", F.col("from").alias("host"), "parts"), "large")
    number = seeds.groupBy("kind").agg(F.count("*").alias("k"))
    starts, _ = spool(seeds.join(number, "kind").select("kind", "host", ((1 - damping) / F.col("k")).alias("score")), "starts")
    mass, path = starts, None
    for _ in range(0 if walks.isEmpty() else rounds - 1):  # without links nothing moves on from the seeds
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        dealt = mass.join(large, ["kind", "host"], "left").select("kind", F.col("host").alias("from"), "score", parts.alias("part"))
        moved = walks.join(dealt, ["kind", "from", "part"]).select("kind", F.col("to").alias("host"), (F.col("w") * F.col("score")).alias("score"))
        following, next_path = spool(moved.union(starts).groupBy("kind", "host").agg(F.sum("score").alias("score")), "mass")
        if path:
            unspool(spark, path)
        mass, path = following, next_path
    for done in (both_path, walks_path, large_path):
        unspool(spark, done)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return mass.groupBy("host").agg(part("trust"), part("distrust"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 1.0, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    The longest rule that fits decides. The rest follow their host: hosts of which the rules allow (block) more than
    half the pages are trusted (blocked) seeds, and a host is blocked where its distrust exceeds ratio times its trust;
    hosts that neither reaches are allowed. Null urls and urls without :// have an empty host, which has no links and is
    no seed. Repeated rows stay repeated; an empty table gives an empty result.
    """
    judged = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = judged.withColumn("hit", rule_for(rules, F.col("host"), F.col("path")))
    ruled = lambda verdict: F.count(F.when(F.col("hit.verdict") == verdict, 1)) * 2 > F.count("*")
    shares = judged.where("host <> ''").groupBy("host").agg(ruled("allow").alias("trust"), ruled("block").alias("distrust"))
    kinds = [shares.where(k).select("host", F.lit(k).alias("kind")) for k in ("trust", "distrust")]
    seeds, _ = spool(reduce(DataFrame.union, kinds), "seeds")
    scores = spread(host_links(pages, url_col, html_col), seeds, damping, rounds)
    blocked = scores.where(F.col("distrust") > ratio * F.col("trust")).select("host", F.lit("block").alias("by_host"))
    out = judged.join(blocked, "host", "left")
    return out.select("id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "by_host", F.lit("allow")).alias("verdict"))
