"""Reads as runs of units and gaps: filling, clipping, selection, strands, edges and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNIT, MARGIN, CLIP, LEAST_BASES = 100, 20, 2000, 6000


def gaps_filled(chunks: DataFrame) -> DataFrame:
    """(read_id, pos, contig, unit, filled) of chunks (read_id, pos, is_gap, contig, unit, fwd, n_bases).

    A gap of about a unit's length between two units of one strand that miss just one unit becomes that unit.
    """
    w = Window.partitionBy("read_id").orderBy("pos")
    side = lambda f: f(F.struct("is_gap", "contig", "unit", "fwd")).over(w)
    rows = chunks.withColumns({"a": side(F.lag), "z": side(F.lead)})
    step = F.when(F.col("a.fwd"), 1).otherwise(-1)
    fits = F.col("is_gap") & ~F.col("a.is_gap") & ~F.col("z.is_gap") & (F.col("a.fwd") == F.col("z.fwd")) & (F.col("a.contig") == F.col("z.contig")) & (F.col("z.unit") == F.col("a.unit") + 2 * step) & F.col("n_bases").between(UNIT - MARGIN, UNIT + MARGIN)
    rows = rows.withColumn("filled", F.coalesce(fits, F.lit(False)))
    pick = lambda c, other: F.when(F.col("filled"), other).otherwise(F.col(c)).alias(c)
    return rows.filter("filled or not is_gap").select("read_id", "pos", pick("contig", F.col("a.contig")), pick("unit", F.col("a.unit") + step), "filled")


def clip_flags(chunks: DataFrame) -> DataFrame:
    """(read_id, head_clip, tail_clip): does the read begin or end with a gap of more than CLIP bases."""
    edge = lambda f: f(F.struct("is_gap", "n_bases"), "pos")
    long = lambda c: F.col(f"{c}.is_gap") & (F.col(f"{c}.n_bases") > CLIP)
    return chunks.groupBy("read_id").agg(edge(F.min_by).alias("h"), edge(F.max_by).alias("t")).select("read_id", long("h").alias("head_clip"), long("t").alias("tail_clip"))


def gap_ends(chunks: DataFrame) -> DataFrame:
    """(n_reads, n_gap_only, mean_end_gap): twice the mean over reads of the bases in gaps at either end; and reads without units."""
    edge = lambda f: f(F.struct("is_gap", "n_bases"), "pos")
    of = lambda c: F.when(F.col(f"{c}.is_gap"), F.col(f"{c}.n_bases")).otherwise(0)
    reads = chunks.groupBy("read_id").agg(edge(F.min_by).alias("h"), edge(F.max_by).alias("t"), F.bool_and("is_gap").alias("only"))
    return reads.agg(F.count(F.lit(1)).alias("n_reads"), F.count_if("only").alias("n_gap_only"), (F.sum(of("h") + of("t")) / F.count(F.lit(1)) * 2).alias("mean_end_gap"))


def within(units: DataFrame, contig: int, start: int, end: int) -> DataFrame:
    """The units of reads inside [start, end) of a contig."""
    return units.filter((F.col("contig") == contig) & (F.col("unit") >= start) & (F.col("unit") < end))


def touching(units: DataFrame, contig: int, start: int, end: int) -> DataFrame:
    """(read_id, touches, n_inside, has_contig) of each read."""
    inside = (F.col("contig") == contig) & (F.col("unit") >= start) & (F.col("unit") < end)
    return units.groupBy("read_id").agg(F.bool_or(inside).alias("touches"), F.count_if(inside).alias("n_inside"), F.bool_or(F.col("contig") == contig).alias("has_contig"))


def selected_within(units: DataFrame, contig: int, start: int, end: int) -> DataFrame:
    """(read_id, n_inside) of reads with more units inside than the lesser of 60 and half of theirs."""
    inside = (F.col("contig") == contig) & (F.col("unit") >= start) & (F.col("unit") < end)
    n = units.groupBy("read_id").agg(F.count_if(inside).alias("n_inside"), F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n_inside") > F.least(F.lit(LEAST_BASES // UNIT), F.expr("n div 2"))).select("read_id", "n_inside")


def majority_strand(chunks: DataFrame, contigs: list[int]) -> DataFrame:
    """(read_id, contig, forward): is the read's larger part on the forward strand; null where it has no unit there."""
    reads = chunks.select("read_id").distinct().withColumn("contig", F.explode(F.array(*(F.lit(c).cast("long") for c in contigs))))
    n = chunks.filter(~F.col("is_gap")).groupBy("read_id", "contig").agg(F.count(F.lit(1)).alias("n"), F.count_if("fwd").alias("f"))
    return reads.join(n, ["read_id", "contig"], "left").select("read_id", "contig", (2 * F.col("f") > F.col("n")).alias("forward"))


def node_edges(nodes: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, pos, offset, label) between consecutive nodes (read_id, pos, start, end): the bases between, if they don't overlap."""
    follow = F.lead("start").over(Window.partitionBy("read_id").orderBy("pos"))
    e = nodes.withColumn("next", follow).filter("next is not null").withColumn("offset", F.col("next") - F.col("end"))
    label = F.when(F.col("offset") > 0, F.substring("seq", (F.col("end") + 1).cast("int"), F.col("offset").cast("int"))).otherwise("")
    return e.join(reads.select("read_id", "seq"), "read_id").select("read_id", "pos", "offset", label.alias("label"))


def encoded_metrics(nodes: DataFrame, edges: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, encoded_length, encoded_rate, gappy) of every read: nodes' lengths less their overlaps, 0 at least."""
    length = nodes.groupBy("read_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    over = edges.filter("offset < 0").groupBy("read_id").agg(F.sum("offset").alias("o"))
    rows = reads.select("read_id", F.length("seq").alias("len")).join(length, "read_id", "left").join(over, "read_id", "left")
    enc = F.greatest(F.coalesce("n", F.lit(0)) + F.coalesce("o", F.lit(0)), F.lit(0)).cast("long")
    return rows.select("read_id", enc.alias("encoded_length"), F.try_divide(enc, F.col("len")).alias("encoded_rate"), F.col("n").isNull().alias("gappy"))


def labels_first(reads: DataFrame, clusters: DataFrame, label: str = "label") -> DataFrame:
    """``reads`` with the least cluster (read_id, cluster) that holds each, and their place: labelled ones first, else by read_id."""
    least = clusters.groupBy("read_id").agg(F.min("cluster").alias(label))
    return reads.join(least, "read_id", "left").withColumn("place", placed_after(F.col(label).isNull(), F.col("read_id")))


def placed_after(last: Column, order: Column) -> Column:
    """A sort key, not a number of rows: no window over the whole table is needed to sort by it."""
    return F.struct(last.alias("unlabelled"), order.alias("by"))


def spanning(units: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, read_id, overlaps, contains, spans): how reads lie to regions (region, contig, start, end), ends excluded.

    A read overlaps with any unit inside, contains the region with its first and last unit, and spans it with a unit on
    both sides. Regions are a bounded list.
    """
    r = units.join(F.broadcast(regions), "contig").groupBy("region", "read_id", "start", "end").agg(F.bool_or((F.col("unit") >= F.col("start")) & (F.col("unit") < F.col("end"))).alias("overlaps"), F.bool_or(F.col("unit") == F.col("start")).alias("a"), F.bool_or(F.col("unit") == F.col("end") - 1).alias("z"), F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    return r.select("region", "read_id", "overlaps", (F.col("a") & F.col("z")).alias("contains"), ((F.col("lo") < F.col("start")) & (F.col("hi") >= F.col("end"))).alias("spans")).filter("overlaps or spans")
