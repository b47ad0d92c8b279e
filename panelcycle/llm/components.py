"""Connected components of a link table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.session import materialize


def connected(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links`` (a, b) the smallest node it is connected with.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    paths halve; every round is written as a table, and the driver sees one count a round.
    """
    both = materialize(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(),
        "component-links",
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "component-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        closer = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("mid")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        jumped = closer.join(jump, F.col("mid") == F.col("via"), "left").select(
            "node", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")
        )
        step = materialize(jumped, "component-labels")
        labels = step.select("node", "root")
        if step.where("old != root").limit(1).count() == 0:
            return labels
