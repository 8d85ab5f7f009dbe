"""Views that give the driver's star-schema tables the shape of long-read data.

Each view exists twice: as a DataFrame (Spark) and as the SQL text of a CTE (DuckDB), with one meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNITS_SQL = """units AS (
  SELECT user_id AS read_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos,
         CAST(CAST(floor(value) AS INT) % 3 AS BIGINT) AS contig,
         CAST(CAST(floor(value * 7) AS INT) % 100 AS BIGINT) AS unit
  FROM events)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (read_id, pos, contig, unit): one row per reference unit met along a read."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("read_id"),
        F.row_number().over(w).cast("long").alias("pos"),
        (F.floor("value").cast("int") % 3).cast("long").alias("contig"),
        (F.floor(F.col("value") * 7).cast("int") % 100).cast("long").alias("unit"),
    )

ALNS_SQL = """alns AS (
  SELECT l_orderkey AS read_id, l_suppkey % 4 AS contig, l_partkey AS st, l_partkey + CAST(l_quantity AS BIGINT) * 10 AS en,
         l_returnflag <> 'R' AS fwd, CAST(floor(l_extendedprice) AS BIGINT) AS score, CAST(l_linenumber AS BIGINT) AS ln
  FROM lineitem)"""


def alns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> (read_id, contig, st, en, fwd, score, ln): alignments of reads to contigs, half open."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("read_id"),
        (F.col("l_suppkey") % 4).alias("contig"),
        F.col("l_partkey").alias("st"),
        (F.col("l_partkey") + F.col("l_quantity").cast("long") * 10).alias("en"),
        (F.col("l_returnflag") != "R").alias("fwd"),
        F.floor("l_extendedprice").cast("long").alias("score"),
        F.col("l_linenumber").cast("long").alias("ln"),
    )


#: Letters that are no base, and the bases that stand for them.
OTHER_LETTERS, THEIR_BASES = "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC"
READS_SQL = f"""reads AS (
  SELECT doc_id AS read_id, source AS "desc", translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{OTHER_LETTERS}', '{THEIR_BASES}') AS seq
  FROM documents)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (read_id, desc, seq): every letter of a text as a base."""
    seq = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), OTHER_LETTERS, THEIR_BASES)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("read_id"), F.col("source").alias("desc"), seq.alias("seq"))


VOTES_SQL = """votes AS (
  SELECT d.doc_id AS read_id, CAST(substr(source, 4) AS BIGINT) AS cluster, quality * 2 + toxic AS truth, d.doc_id % 23 AS win
  FROM documents d LEFT JOIN labels USING (doc_id))"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels -> (read_id, cluster, truth or null, win): reads with a predicted and a true cluster."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("read_id"), F.substring("source", 4, 9).cast("long").alias("cluster"), (F.col("quality") * 2 + F.col("toxic")).alias("truth"), (F.col("doc_id") % 23).alias("win"))
