"""Mixing sources to target weights: a token budget goes down a tree domain - language - source.

Budget: each node shares its budget among its children by weight. A leaf can give at most ``max_epochs`` times its tokens;
what a child cannot use goes to its siblings (by weight, again and again) before the node reports it to its own parent as
unused, so a shortage is made up by the nearest relatives that can.

Selection: each leaf takes the prefix of its epochs. In epoch e the documents stand in the order of a seeded hash of (seed,
e, doc_id, text-independent); they are taken while the tokens taken before them are below the leaf's budget. Prefix sums use
two levels (hash range, then within the one range where the budget ends), so a leaf with a third of all rows is spread
over many tasks.

Defined results: a null text has no tokens; documents without tokens are never taken (they add nothing); null language or
source is a value of its own; an empty table gives an empty result; copies of a row are rows of their own, ordered by all
their keys; further columns are ignored by the budget.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.session import staged

LEVELS = ("domain", "lang", "source")
MAX_LEAVES = 1_000_000  # leaves are configuration-sized; more of them raise an error
RANGES = 1024


def token_count(text: Column) -> Column:
    """Number of words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " +"), lambda w: w != "")).cast("long")


def default_domain(source: Column, domains: int = 4) -> Column:
    """A domain from the source's name, where the table has none: sources are dealt to ``domains`` by a hash."""
    return F.concat(F.lit("domain"), F.pmod(F.xxhash64(F.coalesce(source, F.lit(""))), F.lit(domains)).cast("string"))


def share(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Split ``budget`` among (weight, capacity); what one cannot take goes to the others by weight."""
    given = [0.0] * len(children)
    open_ = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    rest = min(budget, sum(children[i][1] for i in open_))
    while open_ and rest > 1e-9:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if given[i] + rest * children[i][0] / total >= children[i][1]]
        if not full:
            for i in open_:
                given[i] += rest * children[i][0] / total
            break
        for i in full:
            rest -= children[i][1] - given[i]
            given[i] = children[i][1]
        open_ = [i for i in open_ if i not in set(full)]
    return given


def budgets(leaves: Mapping[tuple, int], total: float, weight: Callable[[tuple], float], max_epochs: int) -> dict[tuple, int]:
    """Token budget of each leaf (path -> tokens there are). ``weight`` gives a node's weight among its siblings."""
    capacity: dict[tuple, float] = {}
    for path, tokens in leaves.items():
        for depth in range(len(path) + 1):
            capacity[path[:depth]] = capacity.get(path[:depth], 0.0) + float(tokens) * max_epochs
    children: dict[tuple, list[tuple]] = {}
    for node in capacity:
        if node:
            children.setdefault(node[:-1], []).append(node)
    given = {(): min(float(total), capacity.get((), 0.0))}
    order = [()]
    for node in order:
        below = sorted(children.get(node, []), key=lambda p: tuple((x is not None, x or "") for x in p))
        for child, amount in zip(below, share(given[node], [(weight(c), capacity[c]) for c in below])):
            given[child] = amount
            order.append(child)
    return {path: int(round(given[path])) for path in leaves}


def mix(docs: DataFrame, budget_fraction: float = 0.5, weights: Mapping[tuple, float] | None = None, max_epochs: int = 2,
        seed: int = 7, domain: Column | None = None) -> DataFrame:
    """One row per document and epoch taken: doc_id, domain, lang, source, n_tokens, epoch, leaf_budget.

    The total budget is ``budget_fraction`` of all tokens. ``weights`` maps node paths ``(domain,)``, ``(domain, lang)``,
    ``(domain, lang, source)`` to weights; nodes that are not listed weigh 1.
    """
    sized = staged(docs.select(
        "doc_id", (default_domain(F.col("source")) if domain is None else domain).alias("domain"), "lang", "source",
        token_count(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("text_key")).filter("n_tokens > 0"), "mix-sizes")
    totals = sized.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).limit(MAX_LEAVES + 1).collect()
    if len(totals) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    leaves = {tuple(r[c] for c in LEVELS): r["tokens"] for r in totals}
    given = weights or {}
    allotted = budgets(leaves, budget_fraction * sum(leaves.values()), lambda p: given.get(p, 1.0), max_epochs)
    spark = docs.sparkSession
    rows = [(*path, leaves[path], allotted[path]) for path in leaves]
    plan = spark.createDataFrame(rows, "domain string, lang string, source string, leaf_tokens long, leaf_budget long")

    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in LEVELS]
    ranked = sized.alias("d").join(plan.alias("p"), same).select("d.*", "p.leaf_tokens", "p.leaf_budget")
    ranked = ranked.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    # tokens still wanted when the epoch begins
    ranked = ranked.withColumn("wanted", F.col("leaf_budget") - F.col("epoch") * F.col("leaf_tokens")).filter("wanted > 0")
    ranked = ranked.withColumn("place", F.xxhash64(F.lit(seed), F.col("epoch"), "doc_id", "text_key"))
    ranked = ranked.withColumn("part", F.shiftrightunsigned("place", 54).cast("int"))
    # an unsigned order of the hash, as its top ten bits count
    ranked = ranked.withColumn("place", F.col("place").bitwiseXOR(F.lit(-9223372036854775808)))

    keys = [*LEVELS, "epoch"]
    parts = ranked.groupBy(*keys, "part").agg(F.sum("n_tokens").alias("part_tokens"))  # at most RANGES rows a leaf and epoch
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.select(*keys, "part", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)).alias("before")), "mix-parts")
    match = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "part"]]
    placed = ranked.alias("r").join(parts.alias("b"), match).select("r.*", "b.before").filter("before < wanted")
    within = (Window.partitionBy(*keys, "part").orderBy("place", "doc_id", "text_key")
              .rowsBetween(Window.unboundedPreceding, -1))
    taken = placed.withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return taken.filter("before < wanted").select("doc_id", *LEVELS, "n_tokens", "epoch", "leaf_budget")
