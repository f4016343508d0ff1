"""URL filters by rules and by trust that spreads over the host graph.

A url with a matching rule gets the rule's verdict; the longest rule wins (longest host, then longest path). Every other
url gets the verdict of its host: trust spreads from hosts with urls that a rule allows along hyperlinks (personalised
PageRank), distrust spreads from hosts that a rule blocks as a whole against the direction of hyperlinks (who links to a
blocked host is suspect). A host is blocked where its distrust reaches ``threshold`` of the two together.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; a null html has
no links; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanscope.session import staged

# host, path, verdict (fixed values)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

LINK_PATTERN = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def fold(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and where there is no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = fold(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return host, path


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, as CASE expressions."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -len(r[1]), r[0], r[1]))
    name = verdict = None
    for rule_host, rule_path, outcome in ordered:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        label = F.lit(rule_host + rule_path)
        name = F.when(fits, label) if name is None else name.when(fits, label)
        verdict = F.when(fits, F.lit(outcome)) if verdict is None else verdict.when(fits, F.lit(outcome))
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct hyperlinks between hosts: src, dst. ``pages`` has host and html."""
    links = pages.filter((F.col("host") != "") & F.col("html").contains("//")).select(
        F.col("host").alias("src"),
        F.explode(F.array_distinct(F.transform(
            F.regexp_extract_all(F.col("html"), F.lit(LINK_PATTERN), F.lit(1)), fold))).alias("dst"),
    )
    return links.filter((F.col("dst") != "") & (F.col("src") != F.col("dst"))).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int, stage_every: int = 4) -> DataFrame:
    """Personalised PageRank of several kinds at once.

    ``edges``: kind, src, dst. ``seeds``: kind, host, mass (sums to 1 in each kind). Returns kind, host, score. Mass that
    reaches a host without outgoing edges goes no further, so scores of a kind sum to 1 at most.
    """
    degree = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = staged(edges.join(degree, ["kind", "src"])
                      .select("kind", "src", "dst", (F.lit(damping) / F.col("degree")).alias("weight")), "host-edges")
    restart = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score"))
    rank = seeds.select("kind", "host", F.col("mass").alias("score"))
    for k in range(rounds):
        passed = (weighted.join(rank.withColumnRenamed("host", "src"), ["kind", "src"])
                  .select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("weight")).alias("score")))
        rank = passed.unionByName(restart).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (k + 1) % stage_every == 0 and k + 1 < rounds:
            rank = staged(rank, "host-rank")
    return rank


def filter_urls(pages: DataFrame, rules=RULES, damping: float = 0.85, rounds: int = 12,
                threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages`` (page_id, url, html)."""
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    name, verdict = rule_column(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", "html", name.alias("rule"), verdict.alias("by_rule"))
    whole = reduce(lambda a, b: a | b, [
        (F.col("host") == h) | F.col("host").endswith("." + h) for h, p, v in rules if v == "block" and p == "/"
    ] or [F.lit(False)])

    counts = judged.filter(F.col("host") != "").groupBy("host").agg(
        F.count_if(F.col("by_rule") == "allow").alias("allowed"),
        F.count_if((F.col("by_rule") == "block") & whole).alias("blocked"))
    masses = counts.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), "host", F.col("allowed").cast("double").alias("mass")),
        F.struct(F.lit("distrust").alias("kind"), "host", F.col("blocked").cast("double").alias("mass")),
    )).alias("s")).select("s.*").filter("mass > 0")
    totals = masses.groupBy("kind").agg(F.sum("mass").alias("total"))
    seeds = staged(masses.join(F.broadcast(totals), "kind")  # two rows
                   .select("kind", "host", (F.col("mass") / F.col("total")).alias("mass")), "host-seeds")

    links = host_edges(judged)
    edges = links.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), "src", "dst"),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")),
    )).alias("e")).select("e.*")
    rank = propagate(edges, seeds, damping, rounds)
    scores = rank.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"))
    scores = staged(scores, "host-scores")

    suspect = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    return (judged.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce(F.col("by_rule"), F.when(suspect, F.lit("block")), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
