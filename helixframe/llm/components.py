"""Connected components of a graph given as edges, by rounds of least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import discard, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that edges reach, for every node that has an edge. Edges of nulls are left out.

    A round takes the least label among a node and its neighbours (an aggregate with map-side combination, so hubs cost
    no more than their edges), then the label of that label. Each round is written to the shared folder, and the one
    before it is deleted.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    e = stored(spark, e.select(both).select("e.a", "e.b").distinct(), "edges")
    labels = stored(spark, e.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = e.join(labels, e["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "least").alias("least"))
        far = step.select(F.col("node").alias("least"), F.col("least").alias("jump"))
        new = stored(spark, step.join(far, "least", "left").select("node", F.coalesce("jump", "least").alias("component"), (F.col("component") != F.coalesce("jump", "least")).alias("moved")), "labels")
        changed = not new.filter("moved").isEmpty()
        discard(labels)
        labels = new.drop("moved")
        labels._stored_at = new._stored_at
        if not changed:
            discard(e)
            return labels
