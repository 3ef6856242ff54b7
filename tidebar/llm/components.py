"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import staged

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is its smallest node, by any order that ids have.

    Each round every node takes the smallest label of itself, its neighbours, and the node its label names, so distances
    halve. Rounds are written to the shared folder. A hub's edges meet its one label in a join that Spark can
    split; minima are combined before the shuffle. Self-loops and repeated edges are fine."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        # a node hears from its neighbours, from the node that its label names, and from itself
        ask = both.union(label.select("node", "component")).union(label.select("node", F.col("node").alias("b")))
        heard = ask.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node"))
        own = F.min(F.when(F.col("a") == F.col("b"), F.col("component")))
        fell = staged(heard.agg(F.min("component").alias("component"), own.alias("before")), "labels")
        label = fell.select("node", "component")
        if fell.filter("component < before").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """label (node, component) after further links (a, b): only the components that they join are worked on."""
    if label is None:
        return components(links)
    name = lambda side: label.select(F.col("node").alias(f"n{side}"), F.col("component").alias(f"c{side}"))
    ends = links.join(name("a"), F.col("a") == F.col("na"), "left").join(name("b"), F.col("b") == F.col("nb"), "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    new = joined.select(F.col("node").alias("of"), F.col("component").alias("to"))
    old = label.join(new, F.col("component") == F.col("of"), "left").select("node", F.coalesce("to", "component").alias("component"))
    return staged(old.union(joined.join(label.select("node"), "node", "left_anti").select("node", "component")), "merged")
