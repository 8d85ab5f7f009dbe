"""The corpus pipeline: documents through five stages, each of which works on all that the one before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontam, ngramjoin, packing, pii, toxicity
from helixframe.llm.common import id_remainder, read, shared_folder, stored, without_keys
from helixframe.llm.registry import PII_KEY, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject.

    Null and empty texts have no terms and stay; rows that repeat an id or a text are judged alike; an empty table stays
    empty; other columns pass, whatever their names.
    """
    names = docs.columns
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"), id_remainder("doc_id", 5) != 0)
    return toxicity.score(docs, machine, score_col="__score", predicted_col="__toxic").filter("__toxic = 0").select(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (five words, similarity 0.8) one row: of least id, null ids last.

    Rows are numbered for this, so rows that repeat an id, or have none, are members like others. Null and empty texts
    are near nothing and stay; an empty table stays empty; other columns pass.
    """
    names, numbered = docs.columns, docs.withColumn("__row", F.monotonically_increasing_id())
    found = ngramjoin.groups(numbered.select("__row", "text"), num=8, den=10, n=5, id_col="__row")
    found = stored(spark, found.select(F.col("doc_id").alias("__row"), "component_id"), "groups")
    several = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    members = found.join(several, "component_id").join(numbered.select("__row", "doc_id"), "__row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("__row"))
    best = members.groupBy("component_id").agg(F.min(order).alias("best")).select(F.col("best.__row").alias("__row"))
    gone = stored(spark, members.select("__row").join(best, "__row", "left_anti"), "copies")
    return without_keys(numbered, gone, ["__row"], gone.count()).select(*names)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null texts, and texts or items of fewer than five words, hold and are held by nothing; rows that repeat a text go or
    stay together; an empty table of either kind changes nothing; other columns pass.
    """
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; n_chars follows the text.

    A null text stays null, with a null n_chars; equal values get equal pseudonyms in all rows; an empty table stays empty.
    """
    return pii.pseudonymise(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as ``op8_packing`` gives them; a null text is packed as an empty one."""
    return packing.pack(docs, vocabulary(), special=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: A factorization machine, set joins by hashing, keyed networks and BPE have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
