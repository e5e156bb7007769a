"""Connected components of an edge table, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, tag: str = "labels") -> DataFrame:
    """Rows (node, label) for each node of ``edges`` (a, b): the least node that a path joins it to.

    Each round takes the least label among neighbours and then the label of that label, so rounds grow with the logarithm of the
    longest path. Groups only take minima, which combine before the shuffle; labels are a written table after each round. Null ends
    are left out, loops and repeated edges change nothing, no edges give no rows."""
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), tag)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(new.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), tag)
        if new.filter("old <> label").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")


def contracted_components(edges: DataFrame, tag: str = "labels") -> DataFrame:
    """As connected_components(), for tables with many more edges than nodes: first over each node's edge to its least neighbour alone, then over
    the edges between what these join, which are few where groups are dense. So rounds don't read all edges."""
    ends = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    ends = materialize(ends.distinct(), f"{tag}-all")
    first = connected_components(ends.groupBy("a").agg(F.min("b").alias("b")), tag)
    nodes = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().join(first, "node", "left")
    nodes = materialize(nodes.select("node", F.coalesce("label", "node").alias("label")), tag)
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    between = ends.join(of("a"), "a").join(of("b"), "b").filter("a_label <> b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    between = connected_components(between.distinct(), f"{tag}-between").select(F.col("node").alias("label"), F.col("label").alias("least"))
    return nodes.join(between, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
