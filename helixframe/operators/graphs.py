"""Graphs over units: overlap nodes and edges, tips, k-mers of units, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical_kmers(units: DataFrame, k: int = 3) -> DataFrame:
    """Counts of k units in a row of a read, the lesser of both directions by its outer units."""
    w = Window.partitionBy("read_id").orderBy("pos")
    key = F.col("contig") * 1000 + F.col("unit")
    rows = units.select("read_id", "pos", key.alias("v0"), *(F.lead(key, i).over(w).alias(f"v{i}") for i in range(1, k))).filter(F.col(f"v{k - 1}").isNotNull())
    turn = F.col("v0") > F.col(f"v{k - 1}")
    out = [F.when(turn, F.col(f"v{k - 1 - i}")).otherwise(F.col(f"v{i}")).alias(f"k{i}") for i in range(k)]
    return rows.select(*out).groupBy(*(f"k{i}" for i in range(k))).agg(F.count(F.lit(1)).alias("occ"))


def overlap_edges(nodes: DataFrame) -> DataFrame:
    """(a, a_tail, b, b_tail, occ): bidirected edges between neighbours in a read, counted in both directions.

    nodes: (read_id, pos, node, fwd). A forward node is left by its tail and entered by its head.
    """
    w = Window.partitionBy("read_id").orderBy("pos")
    e = nodes.select("read_id", F.col("node").alias("a"), F.col("fwd").alias("a_tail"), F.lead("node").over(w).alias("b"), (~F.lead("fwd").over(w)).alias("b_tail")).filter("b is not null")
    both = e.select("a", "a_tail", "b", "b_tail").unionAll(e.select("b", "b_tail", "a", "a_tail"))
    return both.groupBy("a", "a_tail", "b", "b_tail").agg(F.count(F.lit(1)).alias("occ"))


def without_tips(nodes: DataFrame, share: int = 8) -> DataFrame:
    """(node, occ) of nodes that are met at least mean / ``share`` times, by whole numbers."""
    occ = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("occ"))
    thr = occ.agg(F.expr(f"sum(occ) div count(*) div {share}").alias("thr"))
    return occ.join(F.broadcast(thr)).filter("occ >= thr").select("node", "occ")  # one row


def degrees(edges: DataFrame) -> DataFrame:
    """How many nodes have each number of edges."""
    return edges.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, component): the least node reached over (a, b), by rounds of least labels with pointer jumping."""
    _set_folder(edges)
    e = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = e.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    for _ in range(most):
        near = e.join(labels, e["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        step = labels.join(near, "node").select("node", F.least("component", "least").alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        new = step.join(jump, "component", "left").select("node", F.coalesce("jump", "component").alias("component"), "old").checkpoint()
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _set_folder(df: DataFrame) -> None:
    """Sets the session's checkpoint folder from its setting; a local session that has none, as in tests, gets one of its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="helixframe-")
    spark.sparkContext.setCheckpointDir(found)

