"""Connected components as alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import write_state
from wordloom.session import drop_state


def least_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 .. n-1 with edges (i, j), the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, label[i], low)
        np.minimum.at(after, label[j], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars of the same components: no more rows, and fewer steps to come."""
    for batch in batches:
        a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = least_labels(place[:len(a)], place[len(a):], len(nodes))
        at = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[label[at]])], ["a", "b"])


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one centre, and no centre on another."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("leaf")).union(edges.select("b", F.lit(0)))
    return ends.groupBy("n").agg(F.sum("leaf").alias("s"), F.min("leaf").alias("m")).where(
        "s > 1 or (s = 1 and m = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b), longs -> (node, component): the smallest node reachable.

    Nodes without an edge to another node do not appear; edges with a null end
    and loops are ignored. Every step is a grouped minimum and an equi-join on
    the node, so a hub's edges are combined before the shuffle and the join
    may split them; the edge table is written to the shared folder after each
    pair of steps. An empty table gives an empty result.
    """
    now = write_state(edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long").distinct(),
                      "wordloom-edges", None)
    while not _settled(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least).mapInArrow(_forest, "a long, b long").distinct())
        before, now = now, write_state(small, "wordloom-edges", None)
        drop_state(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
