"""Votes of a fitted forest, tree by tree over blocks of rows.

A row that runs through all trees at once meets some thousand nodes that no cache holds. Here the nodes of the trees are arrays, and a
block of rows goes through one tree before the next, so that a tree and the block stay in cache. Votes are added in the order
of the trees, as Spark's model does: probabilities and classes are the same to the last bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.session import shared_root

BLOCK_ROWS = 8192


class Tree(NamedTuple):
    """Nodes from the root down; the right child of a node stands behind its left one, and a leaf is its own child."""

    levels: int  # steps from the root to the deepest leaf
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    votes: tuple[np.ndarray, np.ndarray]  # of each class, at the leaves


def flat_tree(left: np.ndarray, right: np.ndarray, feature: np.ndarray, threshold: np.ndarray, counts: np.ndarray) -> Tree:
    """One tree from its node table: children by row number (below 0 at leaves), and the weight of both classes."""
    inner = left >= 0
    levels, front = [], np.zeros(1, np.int64)
    while front.size:
        levels.append(front)
        split = front[inner[front]]
        front = np.stack([left[split], right[split]], axis=1).ravel()
    order = np.concatenate(levels)
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    goes_on = inner[order]
    total = counts[:, 0] + counts[:, 1]
    share = np.divide(counts, total[:, None], out=np.zeros_like(counts), where=total[:, None] != 0)[order]
    return Tree(
        len(levels) - 1, np.where(goes_on, feature[order], 0), np.where(goes_on, threshold[order], np.inf),
        np.where(goes_on, place[np.where(goes_on, left[order], 0)], np.arange(order.size)), (share[:, 0].copy(), share[:, 1].copy()))


def flat_forest(spark: SparkSession, model: RandomForestClassificationModel) -> list[Tree] | None:
    """The trees of a model of two classes as arrays; None for models whose classes are not decided by votes and numbers alone.

    Nodes come from the table that a saved model consists of: at most 2^(depth + 1) rows a tree.
    """
    if model.numClasses != 2 or model.isDefined(model.thresholds):
        return None
    path = f"{shared_root(spark)}/forest-{uuid.uuid4().hex[:12]}"
    model.write().save(path)
    node = F.col("nodeData")
    table = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"), F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["split"]["numCategories"].alias("categories"),
        node["impurityStats"][0].alias("n0"), node["impurityStats"][1].alias("n1")).toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    c = {name: table[name].to_numpy() for name in table.column_names}
    if ((c["left"] >= 0) & (c["categories"] >= 0)).any():
        return None
    counts = np.stack([c["n0"], c["n1"]], axis=1)
    ends = np.flatnonzero(np.diff(c["treeID"])) + 1
    trees = []
    for a, b in zip([0, *ends], [*ends, len(table)]):
        if not np.array_equal(c["id"][a:b], np.arange(b - a)):
            return None
        trees.append(flat_tree(*(c[k][a:b].astype(np.int64) for k in ("left", "right", "feature")), c["threshold"][a:b], counts[a:b]))
    return trees


def votes(trees: list[Tree], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the votes for both classes; ``rows`` has a row per loan and a column per feature."""
    n = len(rows)
    # a missing number is not at most the threshold, so it goes right, as an infinite one does
    values = np.where(np.isnan(rows), np.inf, rows).T.ravel()
    at, sums = np.arange(n), (np.zeros(n), np.zeros(n))
    node, cell = np.empty(n, np.int64), np.empty(n, np.int64)
    value, bound, right = np.empty(n), np.empty(n), np.empty(n, bool)
    for tree in trees:
        column = tree.feature * n
        node.fill(0)
        for _ in range(tree.levels):
            column.take(node, out=cell, mode="clip")
            cell += at
            values.take(cell, out=value, mode="clip")
            tree.threshold.take(node, out=bound, mode="clip")
            np.greater(value, bound, out=right)
            tree.left.take(node, out=cell, mode="clip")
            np.add(cell, right, out=node)
        for total, of_leaf in zip(sums, tree.votes):
            of_leaf.take(node, out=value, mode="clip")
            total += value
    return sums


def decided(trees: list[Tree], features: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Probability of default and class of a block of rows."""
    n = len(features)
    rows = features.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    none, default = votes(trees, rows)
    total = none + default
    proba = np.divide(default, total, out=default.copy(), where=total != 0)
    return pa.array(proba), pa.array((default > none).astype(np.int32))


def with_votes(rows: DataFrame, model: RandomForestClassificationModel) -> DataFrame | None:
    """``rows`` with ``proba`` and ``prediction`` in place of their last column, an array of features; None where the model's own stage has
    to be asked.

    The trees are sent to every executor once per model. Filters stay above, so every row is asked once.
    """
    spark = rows.sparkSession
    if not hasattr(model, "_flat"):
        trees = flat_forest(spark, model)
        model._flat = trees and spark.sparkContext.broadcast(trees)
    shared = model._flat
    if shared is None:
        return None
    schema = T.StructType(rows.schema.fields[:-1]).add("proba", T.DoubleType()).add("prediction", T.IntegerType())
    names = schema.names

    def answered(trees: list[Tree], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proba, prediction = decided(trees, pa.concat_arrays([b.columns[-1] for b in held]))
        start = 0
        for b in held:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], proba.slice(start, len(b)), prediction.slice(start, len(b))], names)
            start += len(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, held, size = shared.value, [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= BLOCK_ROWS:
                yield from answered(trees, held)
                held, size = [], 0
        if held:
            yield from answered(trees, held)

    return rows.mapInArrow(run, schema)
