"""Interval algebra without pairs of rows: unions, containment, depth, and range joins over bins of an axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_length(rows: DataFrame, keys: list[str], start: str = "st", end: str = "en") -> DataFrame:
    """(keys, covered, span): length of the union of the intervals, and from the first start to the last end."""
    before = F.max(end).over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))), F.lit(0))
    return rows.withColumn("new", new).groupBy(*keys).agg(F.sum("new").alias("covered"), (F.max(end) - F.min(start)).alias("span"))


def mostly_covered(rows: DataFrame, keys: list[str], num: int = 8, den: int = 10) -> DataFrame:
    """Keys of which more than num / den of the span is covered."""
    return union_length(rows, keys).filter(F.col("covered") * den > F.col("span") * num).select(*keys)


def keep_outer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's intervals by start, then longest, then best score: those that end after the last kept end and one.

    The bound is the end of the last *kept* row, which a running maximum does not give, so the rows of one key (one read)
    are folded in order.
    """
    rec = F.struct(F.col("st"), (-F.col("en")).alias("ne"), (-F.col("score")).alias("ns"))
    kept = F.aggregate(
        F.array_sort(F.collect_list(rec)),
        F.array().cast("array<struct<st:bigint,ne:bigint,ns:bigint>>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (-x["ne"] > -F.element_at(acc, -1)["ne"] + 1), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return rows.groupBy(*keys).agg(kept.alias("k")).select(*keys, F.explode("k").alias("x")).select(*keys, F.col("x.st").alias("st"), (-F.col("x.ne")).alias("en"), (-F.col("x.ns")).alias("score"))


def not_contained(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no other row of their key strictly contains: a running maximum of ends over smaller starts."""
    w = Window.partitionBy(*keys).orderBy("st").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reach", F.max("en").over(w)).filter(F.col("reach").isNull() | (F.col("reach") <= F.col("en"))).drop("reach")


def depth(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, depth): depth from each place where it may change, by a sweep over summed +1 and -1."""
    delta = rows.select(*keys, F.explode(F.array(F.struct(F.col("st").alias("at"), F.lit(1).alias("d")), F.struct(F.col("en").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    by_place = delta.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    return by_place.select(*keys, "at", F.sum("d").over(Window.partitionBy(*keys).orderBy("at")).alias("depth"))


def pair_dedup(rows: DataFrame, a: list[str], b: list[str], score: str) -> DataFrame:
    """One row for each unordered pair of sides: the sides in order, the least score, and how many rows there were."""
    x, y = F.struct(*(F.col(c).alias(f"f{i}") for i, c in enumerate(a))), F.struct(*(F.col(c).alias(f"f{i}") for i, c in enumerate(b)))
    return rows.groupBy(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).agg(F.min(score).alias("score"), F.count(F.lit(1)).alias("n"))


def in_first_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, name: str, order: str, bin_size: int = 1000, compat: bool = False) -> DataFrame:
    """``points`` with the name of the first interval (by ``order``) that has them, ends included; null if none.

    Both sides meet on bins of the axis. compat: an interval that lies wholly at or before the point counts instead.
    """
    if compat:
        first = points.withColumn("__p", F.monotonically_increasing_id())
        hit = first.join(intervals, keys).filter((F.col("start") <= F.col(at)) & (F.col("end") <= F.col(at)))
        return first.join(hit.groupBy("__p").agg(F.min_by(name, order).alias("found")), "__p", "left").drop("__p")
    spread = intervals.withColumn("bin", F.explode(F.sequence(F.expr(f"start div {bin_size}"), F.expr(f"end div {bin_size}"))))
    where = points.select(*keys, at).distinct().withColumn("bin", F.expr(f"{at} div {bin_size}"))
    hit = where.join(spread, [*keys, "bin"]).filter(F.col(at).between(F.col("start"), F.col("end"))).groupBy(*keys, at).agg(F.min_by(name, order).alias("found"))
    return points.join(hit, [*keys, at], "left")


def repeats(rows: DataFrame, contigs: DataFrame, least: int, one_way: bool = False) -> DataFrame:
    """Alignments between known contigs whose sides are both partial and longer than ``least``."""
    out = rows.join(F.broadcast(contigs.select(F.col("contig").alias("c1"), F.col("length").alias("len1"))), "c1").join(F.broadcast(contigs.select(F.col("contig").alias("c2"), F.col("length").alias("len2"))), "c2")
    out = out.filter((F.col("m1") > least) & (F.col("m2") > least) & (F.col("m1") < F.col("len1")) & (F.col("m2") < F.col("len2")))
    return out.filter("s1 < s2") if one_way else out


def long_alignments(rows: DataFrame, thr: int) -> DataFrame:
    """Alignments whose mean length, truncated, is over ``thr``; the query's ends change places if strands differ."""
    far = rows.filter(F.expr("(m1 + m2) div 2") > thr)
    same = F.col("fwd")
    return far.select("read_id", "c1", "s1", (F.col("s1") + F.col("m1")).alias("e1"), F.when(same, F.col("s2")).otherwise(F.col("s2") + F.col("m2")).alias("q_start"), F.when(same, F.col("s2") + F.col("m2")).otherwise(F.col("s2")).alias("q_end"))


def trim_ends(cov: DataFrame, key: str, at: str, n: str, thr: Column) -> DataFrame:
    """(key, start, stop): where sums of +1 below ``thr`` and -1 otherwise, from either end, are greatest (last of equals)."""
    s = cov.withColumn("s", F.when(F.col(n) < thr, 1).otherwise(-1))
    head = F.sum("s").over(Window.partitionBy(key).orderBy(at))
    tail = F.sum("s").over(Window.partitionBy(key).orderBy(F.desc(at)))
    both = s.withColumns({"head": head, "tail": tail})
    start = both.groupBy(key).agg(F.max(F.struct("head", at)).alias("h"), F.max(at).alias("last")).select(key, "last", F.when(F.col("h.head") < 0, 0).otherwise(F.col(f"h.{at}")).cast("long").alias("start"))
    stop = both.join(start, key).filter(F.col(at) >= F.col("start")).groupBy(key, "start", "last").agg(F.max(F.struct("tail", at)).alias("t"))
    return stop.select(key, "start", F.when(F.col("t.tail") < 0, F.col("last") + 1).otherwise(F.col(f"t.{at}")).cast("long").alias("stop"))
