"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.plans.shared import materialize, new_folder, remove


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node of each component, for every node that has an edge.

    Least labels travel along the edges, and each round also jumps to the label of the label, so the rounds grow with
    the logarithm of the longest chain. A round's labels are written to the shared folder, which cuts the lineage; only
    the number of changed labels comes to the driver. Loops and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    folder = new_folder(spark, "links")
    links = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links", folder)
    labels = materialize(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    while True:
        seen = links.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        lower = labels.join(seen, labels["node"] == seen["u"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = materialize(lower.join(of_label, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "labels")
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            remove(spark, folder)
            return labels.select("node", F.col("label").alias("component"))
