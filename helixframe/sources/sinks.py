"""Writers, as payload columns for Spark's own file writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fasta_by_cluster(reads: DataFrame, path: str) -> None:
    """One folder for each cluster; reads without one go to the number after the greatest."""
    top = reads.agg(F.coalesce(F.max("cluster") + 1, F.lit(0)).alias("rest"))
    rows = reads.join(F.broadcast(top)).select(F.coalesce("cluster", "rest").alias("cluster"), F.concat(F.lit(">"), "id", F.when(F.col("desc").isNotNull(), F.concat(F.lit(" "), "desc")).otherwise(""), F.lit("\n"), "seq").alias("value"))
    rows.repartition("cluster").write.partitionBy("cluster").text(path)


def read_list(reads: DataFrame) -> DataFrame:
    """(cluster, id, desc), with NoDesc for none."""
    return reads.select("cluster", "id", F.coalesce("desc", F.lit("NoDesc")).alias("desc"))


def tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.option("sep", "\t").option("header", header).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def viewer_contigs(coverage: DataFrame, start_stop: DataFrame) -> DataFrame:
    """(id, coverages, start_stop): arrays along each contig, zero where nothing is. A contig's units are one array."""
    both = coverage.join(start_stop.select("contig", "unit", "n"), ["contig", "unit"], "left").fillna(0, ["n"])
    at = F.sort_array(F.collect_list(F.struct("unit", "cov", "n")))
    return both.groupBy(F.col("contig").alias("id")).agg(at.alias("x")).select("id", F.transform("x", lambda v: v["cov"]).alias("coverages"), F.transform("x", lambda v: v["n"]).alias("start_stop"))


def gfa(nodes: DataFrame, edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(value): S and E lines of GFA 2 for nodes (node, occ, seq) and edges (a, a_tail, b, b_tail, occ), U lines for groups (name, node)."""
    s = nodes.select(F.concat_ws("\t", F.lit("S"), F.col("node").cast("string"), F.length("seq").cast("string"), "seq").alias("value"))
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    e = edges.filter("a <= b").select(F.concat_ws("\t", F.lit("E"), F.lit("*"), F.concat(F.col("a").cast("string"), sign("a_tail")), F.concat(F.col("b").cast("string"), F.when(F.col("b_tail"), "-").otherwise("+")), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("*")).alias("value"))
    if groups is None:
        return s.unionAll(e)
    names = F.array_join(F.transform(F.sort_array(F.collect_set("node")), lambda x: x.cast("string")), " ")
    return s.unionAll(e).unionAll(groups.groupBy("name").agg(names.alias("n")).select(F.concat_ws("\t", F.lit("U"), F.col("name").cast("string"), "n").alias("value")))


def error_profile_text(profile: DataFrame) -> DataFrame:
    """Shares of a one-row profile with two decimals, in percent."""
    return profile.select(*(F.format_string("%.2f", F.col(c) * 100).alias(c) for c in profile.columns))


def renamed_contigs(contigs: DataFrame) -> DataFrame:
    """(index, id, seq): the contigs (index, seq, ord) of all clusters, named ``index_n`` by their order within the cluster, from 0."""
    n = F.row_number().over(Window.partitionBy("index").orderBy("ord")) - 1
    return contigs.select("index", F.concat_ws("_", F.col("index").cast("string"), n.cast("string")).alias("id"), "seq")


def fasta(contigs: DataFrame) -> DataFrame:
    """(value): records of (id, seq)."""
    return contigs.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value"))


def repeats_json(repeats: DataFrame) -> DataFrame:
    """(value): one array of all repeats (contig, rs, re) for each pair ``ord``, a line for each contig of the first."""
    each = repeats.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("contig", F.col("rs").alias("start"), F.col("re").alias("end")))).alias("reps"))  # two sides
    return each.select(F.to_json(F.struct("reps")).alias("value"))


def encoded_reads(chunks: DataFrame) -> DataFrame:
    """(id, seq): a read's chunks in order, as ``{"G": bases}`` or ``{"E": [contig, unit]}``."""
    both = F.when(F.col("is_gap"), F.struct(F.col("n_bases").alias("G"), F.lit(None).cast("array<bigint>").alias("E"))).otherwise(F.struct(F.lit(None).cast("bigint").alias("G"), F.array("contig", "unit").alias("E")))
    rows = chunks.groupBy(F.col("read_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", both.alias("x")))).alias("s"))  # one read
    return rows.select("id", F.transform("s", lambda v: v["x"]).alias("seq"))


def metrics(rows: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """(kind, name, value): numbers that a run reports, a row for each, instead of lines in a log."""
    return rows.select([F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "name", "value").select(F.lit(kind).alias("kind"), "name", "value")


def save(df: DataFrame, path: str) -> DataFrame:
    """Writes a stage's result and reads it again, so that a later run can go on from it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def resumed(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result that an earlier run has saved whole at ``path``, or else what ``make`` gives, saved."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(path)
    return save(make(), path)
