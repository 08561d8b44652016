"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Tasks over which the links of one node are spread where they meet its least neighbour.
SALTS = 8
#: Nodes that a task joins in memory before it sends their stars, and links that it is given.
NODES = 100_000


def union(pairs: Iterator[tuple], parent: dict) -> None:
    """Adds the pairs to a forest whose roots are the least members."""
    for a, b in pairs:
        a, b = root(a, parent), root(b, parent)
        if a != b:
            parent[max(a, b)] = min(a, b)


def root(x, parent: dict):
    top = x
    while (up := parent.get(top, top)) != top:
        top = up
    while (up := parent.get(x, x)) != top:
        parent[x] = top
        x = up
    return top


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each task's links as stars, so that of many links among few nodes one per node remains."""
    parent: dict = {}
    for frame in frames:
        union(zip(frame["a"].tolist(), frame["b"].tolist(), strict=True), parent)
        if len(parent) > NODES:
            yield _stars(parent)
            parent = {}
    if parent:
        yield _stars(parent)


def _stars(parent: dict) -> pd.DataFrame:
    return pd.DataFrame({"a": list(parent), "b": [root(x, parent) for x in parent]})


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link, to a root: a node that has no link up itself."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("top")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up > 1 or up = 1 and top = 1").isEmpty()


def _salted(links: DataFrame) -> DataFrame:
    return links.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("s"))


def components(links: DataFrame) -> DataFrame:
    """node and root for every node of `links` (a, b) that has a smaller one in its component; root is the least.

    Any number of links may share a node: they are pre-aggregated, and joined to one row per node under salts. Nodes without a
    link, and each root, are left out. Links always lead to a smaller node, so once each node has one link, to a node without
    any, that node is the least. Rounds go on until then; each is checkpointed, and then contracted in
    tasks of about NODES links, so that few links need few rounds.
    """
    kind = links.schema["a"].dataType.simpleString()
    contracted = lambda e: e.mapInPandas(_contracted, f"a {kind}, b {kind}")
    gathered = lambda e: cut(contracted(e.coalesce(max(1, e.count() // NODES))))
    edges = gathered(cut(contracted(links.select("a", "b").where("a <> b")).distinct()))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")
    while not _settled(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _salted(both.where("b > a")).join(least.select("a", "m", every_salt), ["a", "s"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _salted(large).join(down.select("a", "m", every_salt), ["a", "s"]).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = gathered(cut(small.union(down.select("a", F.col("m").alias("b"))).distinct()))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
