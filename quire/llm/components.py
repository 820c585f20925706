"""Connected components of a table of edges, by label propagation and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame, tag: str = "labels") -> DataFrame:
    """edges: a, b (long). id, label: label is the smallest id of id's component.

    Every round a node takes the smallest label among its neighbours', then the label of
    its label, so a round at least doubles the distance a label has come. Rounds end when
    none changes. All tables stay distributed; each round's is written to the shared folder.
    Hubs and labels that many nodes share are joined by broadcast, a bounded number of them.

    Defined results: an edge with a null end is left out, so is one from a node to itself;
    edges may repeat and point either way; no edges give no rows. Other columns of edges
    are not looked at.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = common.written(both, f"{tag}-edges")
    labels = common.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), tag)
    while True:
        near = common.join_unique(both, labels.select(F.col("id").alias("b"), F.col("label")), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        taken = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        taken = common.written(taken, tag)
        jump = taken.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = common.written(common.join_unique(taken, jump, "label").select("id", F.least("label", "next").alias("label"), "was"), tag)
        changed = moved.where("label <> was").limit(1).count()
        labels = moved.select("id", "label")
        if not changed:
            return labels
