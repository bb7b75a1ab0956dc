"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, label)``: every node with the smallest label it can reach.

    ``nodes`` is ``(node, label)`` with unique nodes (a null label: none), ``edges`` is
    ``(a, b)``. Nodes without a link keep their label and take no part in the rounds. In a
    round a node takes the smallest label of its neighbours and then, once, the label of the
    node that its label came from, so long chains shrink quickly. Rounds write small tables to
    the shared folder; nothing is gathered on the driver but whether anything changed.
    """
    both = cut(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "neighbours",
    )
    linked = both.select(F.col("a").alias("node")).distinct()
    own = cut(nodes.join(linked, "node"), "linked-nodes")
    labels = own
    while True:
        offers = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("offer"))
            .withColumnRenamed("a", "node")
        )
        lowered = labels.join(offers, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "offer").alias("label")
        )
        lowered = cut(lowered, "labels")
        owners = (
            own.select("node", F.col("label").alias("name"))
            .join(lowered.select("node", F.col("label").alias("further")), "node")
            .groupBy("name")
            .agg(F.min("further").alias("further"))
        )
        jumped = lowered.join(
            owners.select(F.col("name").alias("label"), "further"), "label", "left"
        ).select("node", "old", F.least("label", "further").alias("label"))
        jumped = cut(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where(~F.col("old").eqNullSafe(F.col("label"))).isEmpty():
            break
    alone = nodes.join(linked, "node", "left_anti")
    return alone.select("node", "label").unionByName(labels)
