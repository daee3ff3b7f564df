"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node that can be reached.

    Labels spread to neighbours and then jump to the label of their label, so that the rounds needed grow
    with the logarithm of the longest path.  Each round is a grouped minimum (combined before the shuffle,
    so a node with very many links does not gather in one task) and is written to the shared folder; the
    labels of the round before are deleted then.

    Defined results: a link with a null end counts for nothing, one of a node with itself makes no node; repeated
    links count once; an empty table gives no rows; columns of other names are ignored."""
    linked = edges.select("a", "b").where("a <> b")
    both = stored(linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    before = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        spread = near.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = stored(spread.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        now = after.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        discard(labels)
        labels = after
        if before == now:  # labels only fall, so an equal sum means that none did
            discard(both)
            return labels
        before = now
