"""Connected components of a table of links, by rounds of contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.tables import discard, settled


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long).  Returns node, component for every linked node; component is the smallest node that can be reached.

    Each round, a node joins the smallest of its neighbours (followed one step further), and the links are drawn anew between what remains.
    Nodes only ever join smaller ones, so the smallest of a component is what is left of it.  Minima are taken before the shuffle, so a node
    with very many links costs no more than its links.
    """
    edges = settled(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.selectExpr("a AS node", "a AS component").limit(0)
    while not edges.isEmpty():
        ends = edges.selectExpr("b AS node", "a AS to").unionAll(edges.selectExpr("a AS node", "a AS to"))
        parent = settled(ends.groupBy("node").agg(F.min("to").alias("to")))
        up = parent.select(F.col("node").alias("to"), F.col("to").alias("further"))
        joined = settled(parent.join(up, "to").select("node", F.col("further").alias("to")))
        moved = edges.join(joined.selectExpr("node AS a", "to AS x"), "a").join(joined.selectExpr("node AS b", "to AS y"), "b").filter("x <> y")
        rest = settled(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        followed = labels.join(joined.selectExpr("node AS component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        new = joined.join(labels.select("node"), "node", "left_anti").selectExpr("node", "to AS component")
        old, labels = labels, settled(followed.unionAll(new))
        discard(edges, parent, joined, old)
        edges = rest
    return labels
