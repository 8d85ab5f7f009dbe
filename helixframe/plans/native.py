"""Queries that SQL cannot express; the tests hold the operators against planted truth or other forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import assembly, graphs, tiling
from helixframe.plans.adapters import alns, reads, units, votes


def _tiles(s, d):
    """Every read aligned whole to a contig of its own bases; strands alternate."""
    r = reads(s, d).select(F.col("read_id").cast("string").alias("id"), "seq", F.length("seq").cast("long").alias("n"))
    op = lambda k: F.struct(F.lit("M").alias("op"), k.cast("int").alias("len"))
    alns = r.filter("n > 0").select(
        F.lit("c").alias("s1_name"), F.lit(1000).cast("long").alias("score"), F.array(op(F.col("n"))).alias("ops"), F.expr("n div 7").alias("s1_start"), F.col("n").alias("s1_matchlen"),
        F.col("id").alias("s2_name"), F.lit(0).cast("long").alias("s2_fwd_start"), F.col("n").alias("s2_fwd_end"), (F.col("n") % 2 == 0).alias("s2_fwd"))
    return tiling.tile(r, alns, s.createDataFrame([(0, "c")], "contig int, name string")).select("read_id", "pos", "is_gap", "contig", "unit", "is_forward", F.length("bases").cast("long").alias("n_bases"))


def _edges(s, d):
    u = units(s, d)
    nodes = u.select(F.col("read_id"), "pos", (F.col("contig") * 1000 + F.expr("unit div 10")).alias("node"), (F.col("unit") % 2 == 0).alias("fwd"))
    return graphs.overlap_edges(nodes).filter("occ > 8").withColumn("cluster", F.expr("a div 1000"))


def _gibbs(s, d):
    rows = units(s, d).select((F.col("contig") * 10 + F.expr("unit div 20")).alias("win"), "read_id", F.col("unit").alias("pos"), F.substring(F.lit("ACGT"), ((F.col("pos") + F.col("read_id") % 2) % 4 + 1).cast("int"), F.lit(1)).alias("base"))
    return assembly.gibbs_by_window(rows.groupBy("win", "read_id", "pos").agg(F.min("base").alias("base")), 2)


def _turned(s, d):
    """Every tenth read, whole; every second of them goes on with its own reverse complement."""
    r = reads(s, d).filter("length(seq) between 150 and 900").select("read_id", "seq")
    back = F.reverse(F.translate("seq", "ACGT", "TGCA"))
    return r.withColumn("seq", F.when(F.col("read_id") % 2 == 0, F.concat("seq", back)).otherwise(F.col("seq")))


def _labels(s, d):
    """Reads of three windows' labels, one in eleven of which is another."""
    u = units(s, d).filter("pos <= 12")
    cluster = F.when((F.col("unit") % 11) == 0, F.lit(1)).otherwise(F.lit(0)) + F.col("read_id") % 2 * 2
    return u.select("read_id", (F.col("pos") - 1).alias("pos"), (F.col("pos") - 1).alias("win"), cluster.cast("long").alias("cluster"))


def _graphs(s, d):
    v = votes(s, d).select("win", (F.col("read_id") % 20).alias("read_id"), (F.col("cluster") % 5).alias("cluster"))
    a, b = v.withColumnRenamed("cluster", "a"), v.select((F.col("win") - 1).alias("win"), "read_id", F.col("cluster").alias("b"))
    return a.join(b, ["win", "read_id"]).groupBy("win", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))


QUERIES = {
    "chimera_clip": lambda s, d: assembly.clipped(_turned(s, d)).select("read_id", "start", "end", F.length("seq").cast("long").alias("n")),
    "read_qc": lambda s, d: assembly.quality_reads(_turned(s, d), alns(s, d).select((F.col("read_id") % 2000).alias("read_id")), 5.0, 150).select("read_id", "start", "end"),
    "read_correction": lambda s, d: assembly.corrected_units(assembly.corrected_units(_labels(s, d))),
    "matching": lambda s, d: assembly.matched_clusters(_graphs(s, d)),
    "tiling": _tiles,
    "unitigs": lambda s, d: assembly.unitigs_by_cluster(_edges(s, d)),
    "simple_path": lambda s, d: assembly.simple_paths(_edges(s, d)),
    "gibbs_cluster": _gibbs,
}
ORACLES: dict[str, str] = {}
