"""Connected components of a table of links, by contraction in DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cytoloom.scratch import materialise

#: So many links (16 bytes each) that are left after at least one round are finished by one task.
REMNANT = 5_000


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of every node of a remnant of links; the root is the smallest node it can reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for x, y in zip(b["a"], b["b"]):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    yield pd.DataFrame({"node": list(root), "root": [find(x) for x in root]}, dtype="int64")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Each round every node joins the neighbour that comes first in a random order, if that comes before itself, and the
    links are redrawn between the nodes that remain; a link with both ends in one goes.  A chain and a star both
    shrink by a constant factor a round, so rounds grow with the logarithm of the largest component.  What is left of
    the links between contracted nodes is finished at once when it is no more than REMNANT.
    """
    edges = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = None
    round_ = 0
    left = edges.count()
    while left:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(round_), F.col(c)), F.col(c).alias("node"))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min(rank("b")).alias("first"))
        if round_ and left <= REMNANT:
            hook, left = materialise(edges.coalesce(1).mapInPandas(_finish, "node long, root long"), "hooks"), 0
        else:
            hook = materialise(near.select(F.col("a").alias("node"), F.least(F.col("first"), rank("a"))["node"].alias("root")), "hooks")
            first, second = hook.toDF("a", "root_a"), hook.toDF("b", "root_b")
            drawn = edges.join(first, "a").join(second, "b").where("root_a <> root_b")
            edges = materialise(drawn.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
            left = edges.count()
        if nodes is None:
            nodes = hook
        else:
            step = hook.toDF("root", "next")
            nodes = materialise(nodes.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        round_ += 1
    if nodes is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    least = nodes.groupBy("root").agg(F.min(F.least("node", "root")).alias("component"))
    return nodes.join(least, "root").select("node", "component")


def joined_components(groups: DataFrame, fresh: DataFrame) -> DataFrame:
    """The groups (node, component) after more links (a, b); only links between different groups are contracted."""
    of = lambda c: groups.toDF(c, f"component_{c}")
    drawn = fresh.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    step = materialise(connected_components(drawn), "steps")
    moved = groups.join(step.toDF("component", "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return materialise(moved.unionByName(step.join(groups, "node", "left_anti")), "groups")
