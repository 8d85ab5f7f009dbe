"""Readers of the text formats of long-read work, as DataFrames.

All are splittable line readers with explicit schemas and no inference, except FASTA, FASTQ and MAF, whose records span
lines: those are split by a record separator, so a file is still read in parallel by files and records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequences import forward_start, parse_cigar


def _field(parts: Column, i: int, kind: str = "string") -> Column:
    value = F.get(parts, F.lit(i))
    return value if kind == "string" else value.try_cast(kind)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, desc, seq): ``>id desc`` and lines of bases; records without an id are dropped."""
    rec = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head, body = F.split_part("value", F.lit("\n"), F.lit(1)), F.regexp_replace("value", r"^[^\n]*\n?", "")
    out = rec.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.nullif(F.trim(F.regexp_replace(head, r"^\S*", "")), F.lit("")).alias("desc"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return out.filter("id <> ''")


def fastq_as_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, desc, seq) of FASTQ records of four lines; records begin after a line break and ``@``, checked by the ``+`` line."""
    rec = spark.read.option("lineSep", "\n@").text(path)
    p = F.split(F.regexp_replace("value", "^@", ""), "\n")
    out = rec.select(F.regexp_extract(p[0], r"^(\S*)", 1).alias("id"), F.nullif(F.trim(F.regexp_replace(p[0], r"^\S*", "")), F.lit("")).alias("desc"), F.get(p, F.lit(1)).alias("seq"), F.get(p, F.lit(2)).alias("plus"))
    return out.filter("id <> '' and plus like '+%'").drop("plus")


def last_tab(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments in TAB form; ``#`` lines and lines that do not parse are left out.

    EG2 and E come in either order from column 13 on; without them they are 2.0 and 3.0.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    return parse_last_tab(lines)


def parse_last_tab(lines: DataFrame, column: str = "value") -> DataFrame:
    p = F.split(column, "\t")
    tail = F.slice(p, 13, 2)

    def stat(name: str, default: float) -> Column:
        hit = F.filter(tail, lambda x: x.startswith(f"{name}="))
        return F.when(F.size(p) < 14, F.lit(default)).otherwise(F.regexp_replace(F.get(hit, F.lit(0)), f"^{name}=", "").try_cast("double"))

    side = lambda k, at: [_field(p, at).alias(f"s{k}_name"), _field(p, at + 1, "bigint").alias(f"s{k}_start"), _field(p, at + 2, "bigint").alias(f"s{k}_matchlen"), (_field(p, at + 3) == "+").alias(f"s{k}_fwd"), _field(p, at + 4, "bigint").alias(f"s{k}_len")]
    out = lines.select(_field(p, 0, "bigint").alias("score"), *side(1, 1), *side(2, 6), F.rtrim(_field(p, 11)).alias("ops_text"), stat("EG2", 2.0).alias("eg2"), stat("E", 3.0).alias("e"))
    need = ["score", "s1_start", "s1_matchlen", "s1_len", "s2_start", "s2_matchlen", "s2_len", "ops_text", "eg2", "e"]
    out = out.filter(" and ".join(f"{c} is not null" for c in need))
    out = out.withColumn("ops", parse_cigar(F.col("ops_text")))
    for k in (1, 2):
        start = forward_start(F.col(f"s{k}_start"), F.col(f"s{k}_matchlen"), F.col(f"s{k}_len"), F.col(f"s{k}_fwd"))
        out = out.withColumn(f"s{k}_fwd_start", start).withColumn(f"s{k}_fwd_end", start + F.col(f"s{k}_matchlen"))
    return out


def maf(spark: SparkSession, path: str) -> DataFrame:
    """(score, r_name, r_start, r_text, q_name, q_text): the first two ``s`` lines of each paragraph."""
    para = spark.read.option("lineSep", "\n\n").text(path)
    s = F.filter(F.split("value", "\n"), lambda x: x.startswith("s "))
    f = lambda k: F.split(F.get(s, F.lit(k)), r"\s+")
    score = F.regexp_extract("value", r"(?m)^a .*?score=([0-9.eE+-]+)", 1).try_cast("double")
    out = para.select(score.alias("score"), f(0)[1].alias("r_name"), F.get(f(0), F.lit(2)).try_cast("bigint").alias("r_start"), F.get(f(0), F.lit(6)).alias("r_text"), F.get(f(1), F.lit(1)).alias("q_name"), F.get(f(1), F.lit(6)).alias("q_text"))
    return out.filter("r_text is not null and q_text is not null")


def paf(spark: SparkSession, path: str) -> DataFrame:
    """(q_name, q_len, q_start, q_end)."""
    p = F.split("value", "\t")
    return spark.read.text(path).select(_field(p, 0).alias("q_name"), _field(p, 1, "bigint").alias("q_len"), _field(p, 2, "bigint").alias("q_start"), _field(p, 3, "bigint").alias("q_end")).dropna()


def sam(spark: SparkSession, path: str, least_mapq: int = 20) -> DataFrame:
    """(qname, ref, pos, mapq, is_reverse, cigar, seq) of primary records over ``least_mapq``; positions from 0."""
    p = F.split("value", "\t")
    flag = _field(p, 1, "int")
    rows = spark.read.text(path).filter(~F.col("value").startswith("@"))
    return rows.select(_field(p, 0).alias("qname"), _field(p, 2).alias("ref"), (_field(p, 3, "bigint") - 1).alias("pos"), _field(p, 4, "int").alias("mapq"), flag.bitwiseAND(16).cast("boolean").alias("is_reverse"), flag.bitwiseAND(256).cast("boolean").alias("is_secondary"), _field(p, 5).alias("cigar"), _field(p, 9).alias("seq")).filter(~F.col("is_secondary") & (F.col("mapq") > least_mapq)).drop("is_secondary")


def gff(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, desc): at least five columns, the last is the description."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).filter(F.size(p) >= 5)
    return rows.select(_field(p, 0).alias("chr"), _field(p, 3, "bigint").alias("start"), _field(p, 4, "bigint").alias("end"), F.element_at(p, -1).alias("desc")).filter("start is not null and `end` is not null")


def name_map(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "\t")
    return spark.read.text(path).select(_field(p, 0).alias("fasta_id"), _field(p, 1).alias("gff_id")).filter("gff_id is not null")


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, read_id); lines whose cluster is no number are left out."""
    p = F.split("value", "\t")
    return spark.read.text(path).select(_field(p, 0, "int").alias("cluster"), _field(p, 1).alias("read_id")).dropna()


def haplotags(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, cluster) of a haplotag table with a header; a tag that is no number is cluster 0."""
    return spark.read.option("sep", "\t").option("header", True).schema("read string, haplotype string, phase_set string").csv(path).select(F.col("read").alias("read_id"), F.coalesce(F.regexp_extract("haplotype", r"([0-9]+)$", 1).try_cast("int"), F.lit(0)).alias("cluster"))


def peak_table(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start) of a peak table with a header."""
    p = F.split("value", "\t")
    return spark.read.text(path).select(_field(p, 0).alias("contig"), _field(p, 1, "bigint").alias("start")).filter("start is not null")


def cluster_list(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, read_ordinal): line n lists the reads of cluster n. One file, read whole: lines are numbered."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("cluster", "line"))
    return lines.select("cluster", F.explode(F.filter(F.transform(F.split("line", r"\s+"), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())).alias("read_ordinal"))


def assemblies(spark: SparkSession, pattern: str) -> DataFrame:
    """(index, id, desc, seq) of ``<index>/assembly.fasta`` files under a glob pattern."""
    rec = spark.read.option("lineSep", ">").text(pattern).select("value", F.regexp_extract("_metadata.file_path", r"/([0-9]+)/[^/]*$", 1).try_cast("int").alias("index")).filter(F.trim("value") != "")
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    return rec.filter("index is not null").select("index", F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def json_records(spark: SparkSession, path: str, schema: str, whole: bool = True) -> DataFrame:
    """Records of JSON files of a given schema: a document (an object or array) for each file, or with ``whole`` off one for each line."""
    return spark.read.schema(schema).option("multiLine", whole).option("mode", "FAILFAST").json(path)


def table(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = "\t") -> DataFrame:
    """A table of separated values with a schema; ``NA`` and empty fields are null."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("nullValue", "NA").csv(path)
