"""Connected components of an edge list, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payflow.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component = its smallest node.

    Each round takes the least label of a node's neighbours (a partial aggregate, so a hub
    costs one row per map task) and then jumps to the label of that label, which halves
    long chains. Labels are written to the shared folder after every round.
    """
    both = stored(edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
                  .where(F.col("node") != F.col("other"))
                  .select(F.explode(F.array(F.struct("node", "other"),
                                            F.struct(F.col("other").alias("node"), F.col("node").alias("other")))).alias("e"))
                  .select("e.node", "e.other").distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        heard = (both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("l")), "other")
                 .groupBy("node").agg(F.min("l").alias("l")))
        step = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(step.join(jump, "label")
                     .select("node", "old", F.least("label", "next").alias("label")), "labels")
        if not new.where("label < old").limit(1).count():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
