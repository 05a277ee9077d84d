"""Connected components of a distributed edge list, and union-find inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.storage import Staged, stage

# Edges that a task holds while it cuts them to a forest.
EDGES = 200_000


def hook(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union of pairs of places; ``parent`` holds roots before and after.

    The smaller root wins, so a root is the smallest place of its set.
    """
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def forest(ends: np.ndarray) -> np.ndarray:
    """Edges from nodes to the least of their component, of edges (2, n)."""
    nodes, place = np.unique(ends, return_inverse=True)
    left, right = place.reshape(ends.shape)
    root = hook(np.arange(len(nodes)), left, right)
    kept = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[kept], nodes[root[kept]]])


def _thinned(edges: DataFrame) -> DataFrame:
    """``(u, v)``, v below u, with the same components: forests of what a task reads."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, [column.to_numpy() for column in batch.columns]], axis=1)
            if held.shape[1] >= EDGES:
                held = forest(held)
                # What stays small after all is joined with what comes.
                if held.shape[1] >= EDGES // 2:
                    yield pa.RecordBatch.from_pydict({"u": held[0], "v": held[1]})
                    held = held[:, :0]
        held = forest(held)
        yield pa.RecordBatch.from_pydict({"u": held[0], "v": held[1]})

    some = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    return some.mapInArrow(thin, "u long, v long").distinct()


def _star(edges: DataFrame, both_ways: bool) -> Staged:
    """One star step, written: neighbours of each node are linked to the least of them.

    The minima are staged so that the join's two inputs are plain exchanges,
    whose skewed partitions adaptive execution can split: the centre of a large
    star holds a large share of all edges.
    """
    around = edges.unionByName(edges.selectExpr("v AS u", "u AS v")) if both_ways else edges
    low = around.groupBy("u").agg(F.min("v").alias("m"))
    written = stage(low.selectExpr("u", "least(u, m) AS m"), "low")
    low = written.rows
    met = around.join(low, "u")
    if both_ways:
        moved = met.filter("v > u").selectExpr("v AS u", "m AS v")
    else:
        moved = met.filter("v > m").selectExpr("v AS u", "m AS v").unionByName(
            low.selectExpr("u", "m AS v")
        )
    made = stage(moved.filter("u <> v").distinct(), "edges")
    written.release()
    return made


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node in edges ``(a, b)``; a long each.

    ``component`` is the smallest node reachable. Each task first cuts its edges
    to forests, so that a group in which all are linked does not come with all
    its pairs. Then large-star and small-star steps alternate until nothing
    changes; every step is a written table, so a lost executor costs one step at
    most, and the one before it is deleted. Self-loops and nulls have no effect.
    """
    now = stage(_thinned(edges), "edges")
    seen = None
    while True:
        mark = tuple(now.rows.agg(F.count("*"), F.expr("sum(xxhash64(u, v) % 1000000007)")).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        large = _star(now.rows, True)
        now.release()
        now = _star(large.rows, False)
        large.release()
    ends = now.rows.selectExpr("u AS node", "v AS component")
    return ends.unionByName(ends.selectExpr("component AS node", "component").distinct())
