"""Fingerprints, BK-trees, components and embeddings against brute force."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from loanscope.llm import components, embedding_dedup, simhash


def fingerprint(text, width=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("tree_nodes, radius", [(2048, 4), (4, 4), (2048, 6)])
def test_near_duplicates_match_brute_force(docs, corpus, tree_nodes, radius):
    fp = [fingerprint(t) for _, t in corpus]
    root = groups_of(len(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= radius)
    least = {}
    for (d, _), r in zip(corpus, root):
        least[r] = min(d, least.get(r, d))
    want = {(d, f"{f:016x}", least[r]) for (d, _), f, r in zip(corpus, fp, root)}
    got = [tuple(r) for r in simhash.near_duplicates(docs, tree_nodes=tree_nodes, radius=radius).collect()]
    assert set(got) == want and len(got) == len(corpus) + 1


def test_one_of_each_group_stays(docs, corpus, no_docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert simhash.keep_first(no_docs).count() == 0


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = rng.integers(0, 64, (30, 20, 5), dtype=np.uint64)
    values = np.unique((centre[:, None] ^ np.bitwise_or.reduce(np.uint64(1) << flips, axis=2)).ravel())
    q, n = simhash.BKTree(values).within(values, 4)
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 4}
    assert set(zip(q.tolist(), n.tolist())) == want


def test_a_forest_connects_the_same_values():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 300, 250).astype(np.uint64), rng.integers(0, 300, 250).astype(np.uint64)
    x, y = simhash.forest(a, b)

    def groups(p, q):
        edges = set(zip(p.tolist(), q.tolist())) | set(zip(q.tolist(), p.tolist()))
        return groups_of(300, lambda i, j: (i, j) in edges)

    first, second = groups(a, b), groups(x, y)
    assert len(set(zip(first, second))) == len(set(first)) == len(set(second))
    assert len(x) == 300 - len(set(first))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 180), rng.randrange(100, 180)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    pairs = {tuple(sorted((at[a], at[b]))) for a, b in edges if a is not None and a != b}
    root = groups_of(len(nodes), lambda i, j: (j, i) in pairs)
    least = {}
    for x, r in zip(nodes, root):
        least[r] = min(x, least.get(r, x))
    assert got == {x: least[r] for x, r in zip(nodes, root)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows):
    ids = [i for i, _ in rows]
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for (_, v), k in zip(rows, ok)]

    def linked(i, j):
        return ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.9

    root = groups_of(len(rows), linked)
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(i, least.get(r, i))
    return {(i, sum(linked(a, b) for b in range(len(rows)) if a != b), least[r], i == least[r]) for a, (i, r) in enumerate(zip(ids, root))}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[0] + 0.12 * rng.standard_normal(16)).tolist()) for i in range(40)]  # saturates the lists
    rows += [(200 + i, base[5].tolist()) for i in range(9)] + [(300, (base[6] * 1e100).tolist())]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] + [1.0] * 15), (404, [None] + [1.0] * 15),
             (405, [1.0, 2.0]), (406, [2.0, 4.0])]
    table = spark.createDataFrame(rows + [rows[0], (None, base[5].tolist())], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in embedding_dedup.near_duplicates(table, k=6, block=16).collect()]
    assert got.count((None, 0, None, True)) == 1
    got.remove((None, 0, None, True))
    assert len(got) == len(rows) and set(got) == brute_vectors(rows)


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_audit_sees_missing_links(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(10)]
    _, nodes = embedding_dedup.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert embedding_dedup.audit(nodes, spark.createDataFrame([], "u long, v long"), 0.9) == 0.0


@pytest.mark.parametrize("max_rounds", [2, 5])
def test_pairs_that_never_met_are_not_taken_for_complete(spark, max_rounds):
    """Isolated pairs, one order: half of the ends are not compared at first, and no neighbour leads to them."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((2500, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.91 * a + math.sqrt(1 - 0.91 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(2 * i, x.tolist()) for i, x in enumerate(a)] + [(2 * i + 1, x.tolist()) for i, x in enumerate(b)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    got = embedding_dedup.near_duplicates(table, projections=1, max_rounds=max_rounds).collect()
    assert len(got) == len(rows)
    share = sum(r.n_links == 1 and r.component_id == r.vec_id - r.vec_id % 2 for r in got) / len(got)
    assert share >= embedding_dedup.WANTED_RECALL


def test_the_bound_of_a_recall():
    assert embedding_dedup.lower_bound(0, 9) == 0.0
    assert 0.93 < embedding_dedup.lower_bound(390, 400) < 0.975 and embedding_dedup.lower_bound(400, 400) > 0.99


def test_links_that_the_rounds_miss_are_found_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 4)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((110, 24))
    rows = [(i + 1000 * k, (v + 0.08 * k * rng.standard_normal(24)).tolist()) for i, v in enumerate(base) for k in range(3)]
    rows += [(5000 + i, (base[0] + 0.1 * rng.standard_normal(24)).tolist()) for i in range(20)] + [(6000, base[1].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in embedding_dedup.near_duplicates(table, k=4, projections=1, max_rounds=1, block=64).collect()]
    assert len(got) == len(rows) and set(got) == brute_vectors(rows)
