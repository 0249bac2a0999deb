"""Connected components of an edge table, on executors only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm import common


def forest(pairs) -> list[tuple]:
    """Edges to the smallest node of each component among some pairs: no more than nodes, however many pairs."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in list(up) if top(x) != x]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of some pairs to its component's smallest node, as arrays: no more than nodes."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[other], names[label[other]]


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for each node of edges (a, b), both long.

    Labels start at each node's smallest neighbour. Each round moves all nodes of a label together, to the smallest label that
    is next to any of them or to the label's own node. So sorted chains double their steps, and zigzag ones merge whole
    stretches; rounds end when no label changes. Every round is a written table: nothing is recomputed if an executor is lost.
    Minima are summed up before the shuffle, and joins on a node or label with very many rows are plain equi-joins between
    written tables, which adaptive execution splits. Repeated edges (which count once) and loops are allowed, rows with a null
    end are left out, no edges give no rows.
    """
    spark = edges.sparkSession
    edges = edges.filter("a is not null and b is not null")
    sides = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, kept = common.materialise(sides, "edges")
    labels, at = common.materialise(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low, low_at = common.materialise(labels.join(near, "node").select("node", "root", F.least("root", "near").alias("near")), "labels")
        moves = low.select("root", "near").unionByName(low.select(F.col("node").alias("root"), "near")).groupBy("root").agg(F.min("near").alias("next"))
        new, new_at = common.materialise(low.join(moves, "root").select("node", F.col("root").alias("old"), F.col("next").alias("root")), "labels")
        common.discard(spark, at, low_at)
        labels, at = new.select("node", "root"), new_at
        if new.filter("old <> root").isEmpty():
            common.discard(spark, kept)
            return labels
