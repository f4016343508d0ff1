"""SimHash near-duplicates with BK-trees.

A fingerprint bit is set where more than half of the hashes of a document's word shingles have it set. Documents with the same
fingerprint are one node. To find nodes within ``radius`` bits, the 64 bits are cut into ``radius + 2`` blocks; two fingerprints
that close agree in two blocks at least, so they meet in the shard of some pair of blocks and its value. A shard's fingerprints
are dealt to trees of bounded size; a tree is a BK-tree whose children hang by their Hamming distance to the parent, and a
query follows only edges within ``radius`` of its own distance. Queries of a shard visit every tree of the shard, so a large
shard is a grid of bounded tasks (tree x block of queries), not one task.

Each task returns a spanning forest of the links it found (at most one edge per fingerprint), which is what components need;
links themselves are never expanded for groups of equal texts.

Defined results: null and empty texts have fingerprint zero and are linked like any other; copies of a row share a
fingerprint; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm import common
from loanscope.llm.components import connected
from loanscope.session import staged

SEED = 42
RADIUS = 4
TREE_NODES = 2048


def doc_fingerprints(data: np.ndarray, offsets: np.ndarray, width: int, seed: int = SEED) -> np.ndarray:
    """Unsigned fingerprint of each text in the buffer."""
    starts, ends, first = common.word_bounds(data, offsets)
    low = common.LOWER[data]
    # words of each text with single spaces between: drop white space but the byte after a word
    keep = ~common.IS_SPACE[low]
    after = ends[ends < len(low)]
    follows = np.zeros(len(low) + 1, bool)
    follows[after] = common.IS_SPACE[low[after]]
    keep |= follows[:-1]
    low = np.where(common.IS_SPACE[low], np.uint8(32), low)
    at = np.cumsum(np.concatenate([[0], keep]))
    text = low[keep].tobytes()
    starts, ends = at[starts], at[ends]
    counts = np.diff(first)
    shingled = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = common.ranges(first[:-1], shingled)
    last = begin + np.minimum(np.repeat(counts, shingled), width) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[s:e], seed) for s, e in zip(starts[begin].tolist(), ends[last].tolist())),
                    np.uint64, len(begin))
    result = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(shingled)
    if len(some):
        edges = np.concatenate([[0], np.cumsum(shingled[some])])
        for lo, hi in blocks(edges, 1 << 16):
            bits = np.unpackbits(h[edges[lo] : edges[hi]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, edges[lo:hi] - edges[lo], axis=0, dtype=np.int64)
            set_ = (2 * ones > shingled[some[lo:hi], None]).astype(np.uint8)
            result[some[lo:hi]] = np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)
    return result


def blocks(edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of groups with about ``most`` members together."""
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def fingerprints(docs: DataFrame, width: int = 4, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            fp = doc_fingerprints(*common.raw_text(part.column("text")), width, seed)
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "fp": pa.array(fp.view(np.int64))})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Nodes in insertion order; the children of a node are keyed by their distance to it."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        at = np.zeros(len(values), np.int64)  # node that each value has come to
        waiting = np.arange(1, len(values))
        while len(waiting):
            d = np.bitwise_count(self.values[waiting] ^ self.values[at[waiting]]).astype(np.int64)
            still = []
            for i, parent, k in zip(waiting.tolist(), at[waiting].tolist(), d.tolist()):
                child = self.children[parent].setdefault(k, i)
                if child != i:
                    at[i] = child
                    still.append(i)
            waiting = np.array(still, np.int64)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, node) of all pairs with at most ``radius`` differing bits."""
        found_q, found_n = [], []
        stack = [(0, np.arange(len(queries)))] if len(self.values) else []
        while stack:
            node, asking = stack.pop()
            d = np.bitwise_count(queries[asking] ^ self.values[node])
            near = asking[d <= radius]
            if len(near):
                found_q.append(near)
                found_n.append(np.full(len(near), node))
            for k, child in self.children[node].items():
                go = asking[(d >= k - radius) & (d <= k + radius)]
                if len(go):
                    stack.append((child, go))
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_n)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same values as the given ones, one for each value but the smallest of its group."""
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    root = np.arange(len(values))
    while len(i):
        x, y = root[i], root[j]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    other = np.flatnonzero(root != np.arange(len(values)))
    return values[other], values[root[other]]


def small_links(values: np.ndarray, shard: np.ndarray, most: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside shards of few members, by shifting the sorted rows against each other."""
    a, b = [], []
    for shift in range(1, most):
        same = np.flatnonzero(shard[shift:] == shard[:-shift])
        if not len(same):
            break
        near = same[np.bitwise_count(values[same] ^ values[same + shift]) <= radius]
        a.append(values[near])
        b.append(values[near + shift])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def shard_keys(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """One key per value and pair of blocks: shape (pairs, values)."""
    cuts = np.linspace(0, 64, radius + 3).astype(int)
    parts = [(values >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1) for lo, hi in zip(cuts[:-1], cuts[1:])]
    keys = []
    for n, (i, j) in enumerate(combinations(range(len(parts)), 2)):
        keys.append((np.uint64(n) << np.uint64(32)) | (parts[i] << np.uint64(16)) | parts[j])
    return np.array(keys, np.uint64)


def links(distinct: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """a, b: edges that connect all fingerprints (column fp) within ``radius`` bits of each other."""
    spark = distinct.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            keys = shard_keys(fp.view(np.uint64), radius)
            for row in keys:
                yield pa.record_batch({"shard": pa.array(row.view(np.int64)), "fp": pa.array(fp)})

    members = staged(distinct.select("fp").mapInArrow(keyed, "shard long, fp long"), "simhash-shards")
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # members of a shard are dealt to trees; each tree is asked by the members of its own and of later trees
    placed = members.join(sizes, "shard").withColumn("trees", F.ceil(F.col("n") / F.lit(tree_nodes)).cast("int"))
    placed = placed.withColumn("tree", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("trees")).cast("int"))
    visits = placed.select(
        "shard", "fp", "tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other")).select(
        "shard", "fp",
        F.least("tree", "other").alias("host"), F.greatest("tree", "other").alias("guest"),
        (F.col("tree") <= F.col("other")).alias("in_tree"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in common.whole_groups(batches, ["shard", "host", "guest"], 1 << 17):
            yield found(rows, edges)

    def found(rows: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        fp = rows.column("fp").to_numpy().view(np.uint64)
        host, guest, in_tree = (rows.column(c).to_numpy() for c in ("host", "guest", "in_tree"))
        size = np.diff(edges)
        group = np.repeat(np.arange(len(size)), size)
        few = (size <= 16)[group]
        a, b = small_links(fp[few], group[few], 16, radius)
        all_a, all_b = [a], [b]
        for g in np.flatnonzero(size > 16):
            lo, hi = edges[g], edges[g + 1]
            alone = host[lo] == guest[lo]
            tree = BKTree(fp[lo:hi] if alone else fp[lo:hi][in_tree[lo:hi]])
            asking = tree.values if alone else fp[lo:hi][~in_tree[lo:hi]]
            for k in range(0, len(asking), 1024):
                q, n = tree.within(asking[k : k + 1024], radius)
                x, y = forest(asking[k : k + 1024][q], tree.values[n])
                all_a.append(x)
                all_b.append(y)
        a, b = forest(np.concatenate(all_a), np.concatenate(all_b))
        return pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    cells = visits.repartition(common.shuffle_parts(spark), "shard", "host", "guest").sortWithinPartitions(
        "shard", "host", "guest")
    return cells.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = RADIUS, seed: int = SEED,
                    tree_nodes: int = TREE_NODES) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    prints = staged(fingerprints(docs, width, seed), "simhash-fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    edges = staged(links(distinct, radius, tree_nodes), "simhash-edges")
    groups = connected(edges)
    # fingerprints of a component share the smallest document id of any of them
    of_fp = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component"))
    smallest = of_fp.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = staged(of_fp.join(smallest, "component").select("fp", "component_id"), "simhash-components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id; all its columns.

    Rows with the same id are one document and stay together; rows with a null id belong to no group and stay.
    """
    gone = near_duplicates(docs, **options).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
