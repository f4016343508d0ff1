"""Near-duplicate vectors by NN-descent.

Equal vectors become one node with a multiplicity. Every node starts with neighbours from a few random projections: nodes
sorted by a projection are compared with those around them, whatever the density. Then the neighbour graph is refined: the
neighbours (and reverse neighbours) of a node are compared with each other, and each node keeps the best it has met
(neighbours of neighbours), until an audit of a fixed sample against all nodes finds the wanted recall. Links are pairs with a
cosine of ``threshold`` or more, computed in double precision; nothing below it is ever kept as a link.

A node whose list is full of links is saturated: its list is enlarged to all links that it has in its component, counted
block by block against the component's members without forming pairs. Nodes with open and with full lists are audited apart: a uniform sample
of each, grown until ``LINKS_SEEN`` true links are seen, is compared with all nodes, and the lower end of the 95 % interval of the recall
decides. While it is too low, further projections bring other nodes together. Where the rounds end below the wanted recall, all pairs are
compared in blocks, which is exact. Lists, comparisons and blocks are bounded; range partitioning by projection spreads a dense region over tasks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their
own component; so does a vector with a null id, whose component is null; vectors of different length never link; repeated rows (same id, same vector) are one vector; the label and
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanscope.llm import common
from loanscope.llm.components import connected
from loanscope.llm.simhash import forest
from loanscope.session import staged

THRESHOLD = 0.9
NEIGHBOURS = 12
PROJECTIONS = 8
CHUNK = 256
BLOCK = 1024
AUDIT_QUERIES = (256, 2048, 16384)
LINKS_SEEN = 400
WANTED_RECALL = 0.98
MAX_ROUNDS = 5


def unit(vectors: list[bytes]) -> np.ndarray:
    """Unit vectors of one length, in double precision."""
    a = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    a = a / np.abs(a).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All distinct vectors (vec_id, embedding, valid), and the nodes (id, dim, vec, copies): one for each valid vector value."""
    e = F.col("embedding")
    valid = (F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)
             & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists(e, lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    rows = staged(rows.select("vec_id", F.coalesce(valid, F.lit(False)).alias("valid"), "embedding"), "vectors")
    groups = rows.filter("valid").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            offsets = lists.offsets.to_numpy()
            data = lists.values.to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
            yield pa.record_batch({
                "id": batch.column("id"), "dim": pa.array(np.diff(offsets).astype(np.int32)),
                "vec": pa.array([data[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary()),
                "copies": batch.column("copies")})

    nodes = groups.filter("id IS NOT NULL").mapInArrow(pack, "id long, dim int, vec binary, copies long")
    return rows, staged(nodes, "vector-nodes")


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def projected(nodes: DataFrame, projections: int, seed: int = 11) -> DataFrame:
    """id, dim, vec, turn, place: a node's position in the order of each projection (a coarse cell, then a line inside it)."""
    bits = 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                u = unit(part.column("vec").to_pylist())
                p = u @ directions(dim, projections * (bits + 1), seed)
                for t in range(projections):
                    own = p[:, t * (bits + 1) : (t + 1) * (bits + 1)]
                    cell = ((own[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
                    place = cell + 0.5 + np.arctan(own[:, bits]) / np.pi
                    yield pa.record_batch({"dim": part.column("dim"), "turn": pa.array(np.full(len(u), t, np.int32)), "place": pa.array(place),
                                           "id": part.column("id"), "vec": part.column("vec")})

    return staged(nodes.select("id", "dim", "vec").mapInArrow(run, "dim int, turn int, place double, id long, vec binary"), "vector-places")


def first_neighbours(places: DataFrame, chunk: int, take: int) -> DataFrame:
    """u, v, cos: the best ``take`` of each node among those around it in each order."""
    spark = places.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[tuple[tuple, int, bytes]] = []
        for batch in batches:
            groups = list(zip(batch.column("dim").to_pylist(), batch.column("turn").to_pylist()))
            tail += list(zip(groups, batch.column("id").to_pylist(), batch.column("vec").to_pylist()))
            while len(tail) >= chunk:
                yield from compare(tail[:chunk])
                tail = tail[chunk // 2 :]
        if len(tail) > 1:
            yield from compare(tail)

    def compare(rows) -> Iterator[pa.RecordBatch]:
        for key in dict.fromkeys(r[0] for r in rows):
            part = [r for r in rows if r[0] == key]
            if len(part) < 2:
                continue
            ids = np.array([r[1] for r in part])
            u = unit([r[2] for r in part])
            cos = u @ u.T
            np.fill_diagonal(cos, -2)
            k = min(take, len(part) - 1)
            best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            row = np.repeat(np.arange(len(part)), k)
            yield pairs(ids[row], ids[best.ravel()], cos[row, best.ravel()])

    ordered = places.repartitionByRange(common.shuffle_parts(spark), "dim", "turn", "place").sortWithinPartitions("dim", "turn", "place")
    return ordered.mapInArrow(run, "u long, v long, cos double")


def pairs(u, v, cos) -> pa.RecordBatch:
    return pa.record_batch({"u": pa.array(u), "v": pa.array(v), "cos": pa.array(cos)})


def best_of(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each u; ties in the order of a hash, so that no node is everybody's choice."""
    order = Window.partitionBy("u").orderBy(F.col("cos").desc(), F.xxhash64("u", "v"), "v")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def refine(graph: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """u, v, cos of pairs of neighbours of a node that improve on the list of either one, or are links."""
    spark = graph.sparkSession
    both = graph.select("u", "v", "cos").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos"))
    around = best_of(both.groupBy("u", "v").agg(F.max("cos").alias("cos")), 2 * k).select("u", "v")
    worst = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("least"))
    worst = worst.select(F.col("u").alias("v"), F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("least"))
    members = (around.join(nodes.select(F.col("id").alias("v"), "vec"), "v").join(worst, "v", "left")
               .select("u", "v", "vec", F.coalesce("least", F.lit(-2.0)).alias("least")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in common.whole_groups(batches, ["u"], 1 << 14):
            ids, least = rows.column("v").to_numpy(), rows.column("least").to_numpy()
            vecs = rows.column("vec").to_pylist()
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b - a < 2:
                    continue
                x = unit(vecs[a:b])
                cos = x @ x.T
                i, j = np.triu_indices(b - a, 1)
                c = cos[i, j]
                low = least[a:b]
                good = np.flatnonzero((c >= threshold) | (c > low[i]) | (c > low[j]))
                if len(good):
                    out.append((ids[a:b][i[good]], ids[a:b][j[good]], c[good]))
            if out:
                u, v, c = (np.concatenate([o[n] for o in out]) for n in range(3))
                yield pairs(np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([c, c]))

    grouped = members.repartition(common.shuffle_parts(spark), "u").sortWithinPartitions("u")
    found = grouped.mapInArrow(run, "u long, v long, cos double")
    return found.groupBy("u", "v").agg(F.max("cos").alias("cos"))


def audit(nodes: DataFrame, links: DataFrame, threshold: float, queries: int = AUDIT_QUERIES[0]) -> float:
    """Share of the true links of a sample that ``links`` (u, v, both ways) has; the sample is compared with all nodes."""
    return recall_of(nodes, nodes.select("id"), lambda true: linked(true, links), threshold, (queries,))


def recall_of(nodes: DataFrame, asked: DataFrame, hits, threshold: float, sizes: tuple[int, ...] = AUDIT_QUERIES) -> float:
    """Share of true links of a uniform sample of ``asked`` (id) that ``hits`` marks; the sample is compared with all nodes.

    Every node is as likely to be asked as any other, whatever the search has found for it. The sample grows until LINKS_SEEN true links are
    seen. The answer is the lower end of the interval that holds the recall with 95 % confidence, where a link was missed; where
    none was, and few were seen by the largest sample, fewer than 3 in ``sizes[-1]`` nodes miss one, with the same confidence.
    """
    seen = found = 0
    for queries in sizes:
        sample = nodes.join(asked.select("id"), "id").orderBy(F.xxhash64("id", F.lit(17)), "id").limit(queries).select("id", "dim", "vec").toArrow().to_pylist()
        if not sample:
            return 1.0
        seen, found = hits(true_links(nodes, sample, threshold)).agg(F.count(F.lit(1)), F.count("hit")).first()
        if len(sample) < queries:  # all of them
            return found / seen if seen else 1.0
        if seen >= LINKS_SEEN:
            break
    return 1.0 if seen == found else lower_bound(found, seen)


def lower_bound(found: int, seen: int, z: float = 1.645) -> float:
    """Wilson's lower bound of a share."""
    p, c = found / seen, z * z / seen
    return (p + c / 2 - z * math.sqrt(p * (1 - p) / seen + c / (4 * seen))) / (1 + c) if found else 0.0


def linked(true: DataFrame, links: DataFrame) -> DataFrame:
    return true.join(links.select("u", "v", F.lit(1).alias("hit")), ["u", "v"], "left")


def together(true: DataFrame, groups: DataFrame) -> DataFrame:
    own, other = (groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("u", "v"))
    return true.join(own, "u", "left").join(other, "v", "left").select(F.when(F.col("of_u") == F.col("of_v"), 1).alias("hit"))


def true_links(nodes: DataFrame, sample: list[dict], threshold: float) -> DataFrame:
    by_dim = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r)
    asked = {d: (np.array([r["id"] for r in rs]), unit([r["vec"] for r in rs])) for d, rs in by_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids = batch.column("dim").to_numpy(), batch.column("id").to_numpy()
            for dim, (own, u) in asked.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    vecs = batch.column("vec").take(pa.array(at)).to_pylist()
                    q, n = np.nonzero(u @ unit(vecs).T >= threshold)
                    other = own[q] != ids[at[n]]
                    yield pa.record_batch({"u": pa.array(own[q[other]]), "v": pa.array(ids[at[n[other]]])})

    return nodes.select("id", "dim", "vec").mapInArrow(run, "u long, v long")


def all_pairs(nodes: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) that connect all linked nodes, and (id, n) of every node with links: each block of nodes against each other."""
    blocks = -(-nodes.count() // block) or 1
    placed = nodes.withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int"))
    visits = placed.select("dim", "id", "vec", "copies", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select(
        "dim", F.least("own", "other").alias("host"), F.greatest("own", "other").alias("guest"), (F.col("own") <= F.col("other")).alias("hosted"),
        "id", "vec", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in common.whole_groups(batches, ["dim", "host", "guest"], 1 << 13):
            host, guest, hosted, ids, copies = (rows.column(c).to_numpy() for c in ("host", "guest", "hosted", "id", "copies"))
            vecs = rows.column("vec")
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                alone = host[lo] == guest[lo]
                q, m = lo + np.flatnonzero(hosted[lo:hi]), lo + np.flatnonzero(hosted[lo:hi] if alone else ~hosted[lo:hi])
                if not len(q) or not len(m):
                    continue
                near = unit(vecs.take(pa.array(q)).to_pylist()) @ unit(vecs.take(pa.array(m)).to_pylist()).T >= threshold
                near &= ids[q][:, None] != ids[m][None, :]
                i, j = np.nonzero(near)
                a, b = forest(ids[q][i], ids[m][j])
                yield pa.record_batch({"a": pa.array(a), "b": pa.array(b), "n": pa.nulls(len(a), pa.int64())})
                for x, n in ((q, near @ copies[m]), *(() if alone else ((m, near.T @ copies[q]),))):
                    some = np.flatnonzero(n)
                    yield pa.record_batch({"a": pa.array(ids[x][some]), "b": pa.nulls(len(some), pa.int64()), "n": pa.array(n[some].astype(np.int64))})

    cells = visits.repartition(common.shuffle_parts(nodes.sparkSession), "dim", "host", "guest").sortWithinPartitions("dim", "host", "guest")
    found = staged(cells.mapInArrow(run, "a long, b long, n long"), "vector-pairs")
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    return found.filter("n IS NULL").select("a", "b"), counts


def enlarge(saturated: DataFrame, groups: DataFrame, nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """id, n: number of vectors that each saturated node links in its component, itself left out.

    Members and askers of a component are dealt to blocks; a cell compares one block of each and returns sums.
    """
    spark = nodes.sparkSession
    placed = nodes.join(groups.select(F.col("node").alias("id"), "component"), "id")
    wanted = saturated.join(placed.select("id", "component"), "id").groupBy("component").agg(F.count(F.lit(1)).alias("askers"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("members")).join(wanted, "component")
    sizes = sizes.select("component", F.ceil(F.col("members") / block).cast("int").alias("mb"), F.ceil(F.col("askers") / block).cast("int").alias("ab"))
    own = placed.join(sizes, "component").withColumn("h", F.xxhash64("id", F.lit(3)))
    members = own.select("component", F.pmod("h", "mb").cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("ab") - 1)).alias("a"),
                         F.lit(False).alias("asks"), "id", "vec", "copies")
    askers = own.join(saturated, "id", "left_semi").select(
        "component", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod("h", "ab").cast("int").alias("a"),
        F.lit(True).alias("asks"), "id", "vec", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in common.whole_groups(batches, ["component", "m", "a"], 1 << 13):
            asks, ids, copies = (rows.column(c).to_numpy() for c in ("asks", "id", "copies"))
            vecs = rows.column("vec")
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                q, m = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(~asks[lo:hi])
                if len(q) and len(m):
                    near = unit(vecs.take(pa.array(q)).to_pylist()) @ unit(vecs.take(pa.array(m)).to_pylist()).T >= threshold
                    near &= ids[q][:, None] != ids[m][None, :]
                    yield pa.record_batch({"id": pa.array(ids[q]), "n": pa.array(near @ copies[m])})

    cells = askers.unionByName(members).repartition(common.shuffle_parts(spark), "component", "m", "a").sortWithinPartitions("component", "m", "a")
    return cells.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, projections: int = PROJECTIONS,
                    wanted_recall: float = WANTED_RECALL, max_rounds: int = MAX_ROUNDS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector of ``vectors`` (vec_id, embedding)."""
    rows, nodes = nodes_of(vectors)
    start = first_neighbours(projected(nodes, projections), CHUNK, max(4, k // 2)).groupBy("u", "v").agg(F.max("cos").alias("cos"))
    found = staged(start, "neighbours-met")
    graph = staged(best_of(found, k), "neighbours")
    links = staged(found.filter(F.col("cos") >= threshold).select("u", "v").unionByName(
        found.filter(F.col("cos") >= threshold).select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "vector-links")
    recall = 0.0
    for turn in range(max_rounds):
        if turn > 1:  # the audit has found links whose ends never met: other orders bring others together
            met = staged(first_neighbours(projected(nodes, 2 * projections, 11 + turn), CHUNK, max(4, k // 2)).groupBy("u", "v").agg(
                F.max("cos").alias("cos")), "neighbours-met")
            near = met.filter(F.col("cos") >= threshold)
            graph = staged(best_of(graph.select("u", "v", "cos").unionByName(met).groupBy("u", "v").agg(F.max("cos").alias("cos")), k), "neighbours")
            links = staged(links.unionByName(near.select("u", "v")).unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "vector-links")
        better = staged(refine(graph, nodes, k, threshold), "neighbours-met")
        graph = staged(best_of(graph.select("u", "v", "cos").unionByName(better).groupBy("u", "v").agg(F.max("cos").alias("cos")), k), "neighbours")
        links = staged(links.unionByName(better.filter(F.col("cos") >= threshold).select("u", "v")).distinct(), "vector-links")
        degree = links.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        # lists that are full are completed below; the others have to be complete by now
        open_links = links.join(degree.filter(F.col("n") >= k).select("u"), "u", "left_anti")
        closed = degree.filter(F.col("n") >= k).select(F.col("u").alias("id"))
        recall = recall_of(nodes, nodes.select("id").join(closed, "id", "left_anti"), lambda true: linked(true, open_links), threshold)
        if recall >= wanted_recall and turn:
            break
    groups = staged(connected(links.filter("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"))), "vector-groups")
    saturated = staged(closed, "vectors-saturated")
    weighted = open_links.join(nodes.select(F.col("id").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("n"))
    # what a full list lacks is counted inside its component: all that it links has to be there
    if min(recall, recall_of(nodes, saturated, lambda true: together(true, groups), threshold)) >= wanted_recall:
        counts = weighted.select(F.col("u").alias("id"), "n").unionByName(enlarge(saturated, groups, nodes, threshold, block))
    else:
        edges, counts = all_pairs(nodes, threshold, block)
        groups = staged(connected(edges), "vector-groups")
    node = staged(nodes.select("id", "copies").join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "vector-nodes")
    # the smallest id of a node is its own, and so the smallest of a component is a node's
    of_value = rows.filter("valid").groupBy("embedding").agg(F.min("vec_id").alias("id")).join(node, "id")
    valid = rows.filter("valid").join(of_value.select("embedding", "n_links", "component"), "embedding", "left")
    alone = rows.filter("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (valid.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
            .unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
