"""URL filter: rules first, then trust and distrust spread over the links between hosts.

Trust starts at hosts with pages that a rule allows and follows links; distrust starts at
hosts with blocked pages and follows links backwards, to those who link there. Both are
personalised PageRanks over links summed per pair of hosts, and spread in one join a round
until what is still to move cannot matter to any verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.session import checkpointed

DAMPING = 0.85
LEAST_SHARE = 0.1
# the part of the least distrust that blocks which may be left to move in the end
LEFT = 0.001
# rounds between two tables
STRIDE = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z in lower case) and path of a url; empty if it is null or has no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _rule(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits ``host`` and ``path``, as a struct, or null."""
    known = F.array(
        *(
            F.struct(
                F.lit(len(host + path)).alias("length"),
                F.lit(host + path).alias("rule"),
                F.lit(host).alias("host"),
                F.lit(path).alias("path"),
                F.lit(verdict).alias("verdict"),
            )
            for verdict, host, path in rules
        )
    )
    fits = F.filter(
        known,
        lambda r: ((F.col("host") == r["host"]) | F.endswith("host", F.concat(F.lit("."), r["host"])))
        & F.startswith(F.col("path"), r["path"]),
    )
    return F.array_max(fits)


def host_links(pages: DataFrame) -> DataFrame:
    """``source, target, n``: links between different hosts, counted over all pages."""
    source, _ = host_and_path(F.col("url"))
    targets = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    links = pages.select(source.alias("source"), F.explode(targets).alias("target"))
    return (
        links.withColumn("target", F.translate("target", _UPPER, _LOWER))
        .where("source <> '' AND source <> target")
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def host_ranks(judged: DataFrame, links: DataFrame, left: float, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` of every host with pages, links or seeds.

    ``judged`` has ``host`` and ``verdict`` of the pages that a rule decides. Seeds weigh by
    their number of such pages, and each rank's seeds sum to one. Rounds go on until all that
    can still arrive, at all hosts together, is at most ``left``; then it is added. Rank at a
    host without links ends there.
    """
    both = links.select(F.col("source").alias("a"), F.col("target").alias("b"), "n", F.lit("allow").alias("kind"))
    both = both.unionByName(
        links.select(F.col("target").alias("a"), F.col("source").alias("b"), "n", F.lit("block").alias("kind"))
    )
    out = both.groupBy("kind", "a").agg(F.sum("n").alias("total"))
    steps = checkpointed(
        both.join(out, ["kind", "a"]).select("kind", F.col("a").alias("host"), "b", (F.col("n") / F.col("total")).alias("share"))
    )
    seeds = judged.where("host <> '' AND verdict IS NOT NULL").groupBy(F.col("verdict").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    totals = seeds.groupBy("kind").agg(F.sum("n").alias("total"))
    start = (1 - damping) * F.col("n") / F.col("total")
    seeds = checkpointed(seeds.join(F.broadcast(totals), "kind").select("kind", "host", start.alias("rank")))
    ranks, fade = seeds, damping**STRIDE
    earlier = ranks.limit(0)
    before, now = 0.0, seeds.agg(F.sum("rank")).first()[0] or 0.0
    # ranks only grow, so the growth of their sum is all that has arrived since
    while (now - before) * fade / (1 - fade) > left:
        written = ranks
        for _ in range(STRIDE):
            moved = steps.join(ranks, ["kind", "host"]).select("kind", F.col("b").alias("host"), (damping * F.col("share") * F.col("rank")).alias("rank"))
            ranks = moved.unionByName(seeds).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        earlier, ranks = written, checkpointed(ranks)
        before, now = now, ranks.agg(F.sum("rank")).first()[0]
    # the rest is taken to arrive where the last rounds' did, so that nothing is lost on the way
    rest = fade / (1 - fade)
    late = ranks.withColumn("rank", F.col("rank") * (1 + rest)).unionByName(earlier.withColumn("rank", F.col("rank") * -rest))
    ranks = late.groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
    part = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)) for k in ("allow", "block")}
    return ranks.groupBy("host").agg(part["allow"].alias("trust"), part["block"].alias("distrust"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    damping: float = DAMPING,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """A verdict for every page: its longest fitting rule's, else its host's.

    ``rules`` are (verdict, host, path): a rule fits its host and all subdomains if the path
    starts with the rule's; of equally long ones the last by code point wins. Without a rule,
    a page is blocked if its host's distrust exceeds its trust and is at least
    ``least_share`` of an even share of the hosts of pages; otherwise it is allowed.

    Returns ``page_id, host, path, rule`` (host and path joined, or null), ``verdict``,
    ``trust, distrust``. A null url, or one without ``://``, has an empty host and path: no
    rule fits, no rank reaches it, and it is allowed. Null html has no links; links inside
    one host count for nothing. Rows that repeat an id are judged one by one.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("found", _rule(rules))
    parsed = checkpointed(
        parsed.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
    )
    hosts = parsed.where("host <> ''").select("host").distinct().count()
    left = LEFT * least_share / max(hosts, 1)
    ranks = host_ranks(parsed, host_links(pages), left, damping)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * hosts >= least_share)
    # a host may have a third of all pages: both sides of the join stand in storage
    return parsed.join(checkpointed(ranks), "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(bad, "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
