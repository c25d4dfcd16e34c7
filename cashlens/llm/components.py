"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.shelf import Shelf


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """(id, component): every id in links (a, b; longs, not null) with the smallest id reachable from it.

    Contraction with random priorities: in each round every node moves onto the neighbour of least priority (a hash of
    the id), if that is below its own, and links are renamed to where their ends went. A star is gone in two rounds and
    a chain shrinks by a constant share in each, so rounds grow with the logarithm of the size. Nodes with many links
    are reduced by map-side combining, and the joins have written tables on both sides, so a hub's rows can be split.
    An empty table gives no rows; loops and repeated links do no harm.
    """
    edges = shelf.put(links.select("a", "b").filter("a <> b").distinct())
    moved = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("node"))
        parents = both.groupBy(F.col("a").alias("id")).agg(F.min(rank("b")).alias("best"), F.min(rank("a")).alias("own"))
        parents = shelf.put(parents.select("id", F.least("best", "own")["node"].alias("parent")))
        if moved is None:
            moved = parents.select("id", F.col("parent").alias("root"))
        else:
            step = parents.select(F.col("id").alias("at"), "parent")
            old = moved
            moved = shelf.put(
                old.join(step, F.col("root") == F.col("at"), "left").select("id", F.coalesce("parent", "root").alias("root"))
            )
        of_a = parents.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        of_b = parents.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        renamed = edges.join(of_a, "a").select("b", "pa").join(of_b, "b").filter("pa <> pb")
        edges = shelf.put(renamed.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if moved is None:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    smallest = shelf.put(moved.groupBy("root").agg(F.min(F.least("id", "root")).alias("component")))
    return shelf.put(moved.join(smallest, "root").select("id", "component"))


def first_linked(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(firsts, others) from a matrix of links: each linked index that isn't the first of its component, with that first.

    As many links as indexes keep the components that all pairs have.
    """
    found = np.flatnonzero(hits.any(axis=1))
    near = hits[np.ix_(found, found)] | np.eye(len(found), dtype=bool)
    label, before = np.arange(len(found)), None
    while before is None or (label != before).any():
        before = label
        label = np.where(near, label[None, :], len(found)).min(axis=1, initial=len(found))
        label = label[label]
    moved = label != np.arange(len(found))
    return found[label[moved]], found[moved]
