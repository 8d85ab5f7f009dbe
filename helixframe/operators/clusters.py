"""Votes, fractions and labels of clusters of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def vote(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n): the most frequent label; of equal counts the smallest."""
    n = rows.filter(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.max(F.struct(F.col("n"), (-F.col(label)).alias("neg"))).alias("b")).select(key, (-F.col("b.neg")).alias(label), F.col("b.n").alias("n"))


def with_default(rows: DataFrame, label: str, default: int = -1) -> DataFrame:
    return rows.withColumn(label, F.coalesce(F.col(label), F.lit(default).cast(rows.schema[label].dataType)))


def dense_rename(rows: DataFrame, label: str) -> DataFrame:
    """Labels renumbered from 0 in their order; the map has one row for each label."""
    names = rows.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("new", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("long"))
    return rows.join(names, label, "left")


def frequent_labels(rows: DataFrame, key: str, label: str, over: int) -> DataFrame:
    return rows.filter(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > over)


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(c00, c01, c10, c11, accuracy) of two 0/1 columns; accuracy under the better naming of the two clusters."""
    n = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y))
    t = rows.agg(n(0, 0).alias("c00"), n(0, 1).alias("c01"), n(1, 0).alias("c10"), n(1, 1).alias("c11"))
    return t.withColumn("accuracy", F.try_divide(F.greatest(F.col("c00") + F.col("c11"), F.col("c01") + F.col("c10")), F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")))


def fractions(rows: DataFrame, keys: list[str], label: str, floor: float = 1e-9) -> DataFrame:
    """(keys, label, fraction), not less than ``floor``."""
    n = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("k"))
    total = n.groupBy(*keys).agg(F.sum("k").alias("all")) if keys else n.agg(F.sum("k").alias("all"))
    both = n.join(total, keys) if keys else n.join(F.broadcast(total))
    return both.select(*keys, label, (F.greatest(F.col("k").cast("double"), F.lit(floor)) / F.col("all")).alias("fraction"))


def longest_of_session(rows: DataFrame, key: str, order: str, part: str, length: str) -> DataFrame:
    """The longest row of each run of equal ``part`` along ``order``; of equals the last."""
    w = Window.partitionBy(key).orderBy(order)
    run = rows.withColumn("new", F.when(F.lag(part).over(w) == F.col(part), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return run.groupBy(key, "run", part).agg(F.max(F.struct(F.col(length), F.col(order))).alias("b")).select(key, "run", part, F.col(f"b.{length}").alias(length), F.col(f"b.{order}").alias(order))


def quantile_cut(rows: DataFrame, key: str, value: str, tie: str, percent: int, at_least: int) -> DataFrame:
    """(key, thr): the value at place min(n * percent div 100, n - at_least) of each key's ascending values."""
    w = Window.partitionBy(key)
    ranked = rows.withColumns({"k": F.row_number().over(w.orderBy(value, tie)) - 1, "n": F.count(F.lit(1)).over(w)})
    return ranked.filter(F.col("k") == F.greatest(F.least(F.expr(f"n * {percent} div 100"), F.col("n") - at_least), F.lit(0))).select(key, F.col(value).alias("thr"))
