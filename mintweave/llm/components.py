"""Connected components of an undirected link table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave.session import cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every end of ``links`` (columns ``a``, ``b``).

    Alternating large-star and small-star steps (Kiveris et al. 2014): grouped minima and equi-joins only,
    no neighbourhood is gathered.  Each round is written to the shared folder, which cuts the lineage.
    The loop ends when all links point to roots; rounds grow with the logarithm of the longest path.
    Links of a node to itself, repeated links and nulls are ignored; an empty table gives an empty result.
    """
    state = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _settled(state):
        state = cut(_small(_large(state)), "links")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(state: DataFrame) -> bool:
    """Whether every node has one link to a node that has none itself."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(state.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("child").alias("c"), F.max("root").alias("r")).filter("c > 1 or (c > 0 and r > 0)").agg(F.count(F.lit(1))).first()[0] == 0


def _large(state: DataFrame) -> DataFrame:
    ends = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return ends.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(state: DataFrame) -> DataFrame:
    low = state.groupBy("u").agg(F.min("v").alias("m"))
    moved = state.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, lowest node of its component) with the same components as the links given."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = back[: len(a)], back[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v, label[u], label[v]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
