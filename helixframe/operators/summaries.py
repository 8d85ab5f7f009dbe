"""Votes, coverage tests and the summaries that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def position_votes(nodes: DataFrame, more_than: int = 70) -> DataFrame:
    """(position, label, n, total): the commonest label of (position, label or null) with over three fifths of more than 70 nodes."""
    n = nodes.groupBy("position", "label").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("position").agg(F.sum("n").alias("total"), F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label"))).alias("t"))
    return top.filter((F.expr("total * 3 div 5") < F.col("t.n")) & (F.col("total") > more_than)).select("position", F.col("t.label").alias("label"), F.col("t.n").alias("n"), "total")


def occupied(units: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, occupied): has some well-covered unit more than eight tenths of its reads from the cluster.

    Well covered: over mean - 3 sd of the units' counts, all in whole numbers, 0 at least.
    """
    of = units.join(clusters, "read_id", "left").groupBy("contig", "unit", "cluster").agg(F.count(F.lit(1)).alias("n"))
    total = of.groupBy("contig", "unit").agg(F.sum("n").alias("total"))
    thr = total.agg(F.expr("greatest(sum(total) div count(*) - 3 * (sum(total * total) div count(*)), 0)").alias("thr"))
    tests = of.filter("cluster is not null").join(total, ["contig", "unit"]).crossJoin(F.broadcast(thr)).filter("total > thr")  # a single row
    return clusters.select("cluster").distinct().join(tests.groupBy("cluster").agg(F.bool_or(F.col("n") > F.expr("8 * total div 10")).alias("o")), "cluster", "left").select("cluster", F.coalesce("o", F.lit(False)).alias("occupied"))


def low_coverage(cov: DataFrame, sigmas: int = 2) -> DataFrame:
    """(contig, n, mean, sd, kept) of coverages (contig, at, cov): mean and sd truncated to whole numbers; kept: mean >= overall mean - sigmas sd."""
    per = cov.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(cov) div count(*)").alias("mean"), F.floor(F.sqrt(F.expr("sum(cov * cov) div count(*)") - F.pow(F.expr("sum(cov) div count(*)"), F.lit(2)))).alias("sd"))
    every = cov.agg(F.expr("sum(cov) div count(*)").alias("m"), F.floor(F.sqrt(F.expr("sum(cov * cov) div count(*)") - F.pow(F.expr("sum(cov) div count(*)"), F.lit(2)))).alias("s"))
    return per.crossJoin(F.broadcast(every)).select("contig", "n", "mean", "sd", (F.col("mean") >= F.col("m") - sigmas * F.col("s")).alias("kept"))  # a single row


def window_fractions(rows: DataFrame, floor: float = 1e-9) -> DataFrame:
    """(win, cluster, fraction) for all clusters in all windows: share of the window's rows, plus ``floor``."""
    n = rows.groupBy("win", "cluster").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("win").agg(F.sum("n").alias("total"))
    names = n.select("cluster").distinct()  # as many as there are clusters, each beside each window once
    grid = total.join(names.groupBy().agg(F.collect_set("cluster").alias("all")), how="cross").select("win", "total", F.explode("all").alias("cluster"))
    return grid.join(n, ["win", "cluster"], "left").select("win", "cluster", (F.coalesce("n", F.lit(0)) / F.col("total") + floor).alias("fraction"))


def cluster_peaks(units: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, contig, peak_unit, peak, share): where a cluster's reads cover a contig most (first of equals), and the contig's share of them."""
    n = units.join(clusters, "read_id").groupBy("cluster", "contig", "unit").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("cluster", "contig").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("unit")).alias("u"))).alias("p"))
    every = per.groupBy("cluster").agg(F.sum("total").alias("every"))
    return per.join(every, "cluster").select("cluster", "contig", (-F.col("p.u")).alias("peak_unit"), F.col("p.n").alias("peak"), (F.col("total") / F.col("every")).alias("share"))


def share_over(rows: DataFrame, value: str, sigmas: float = 2.0) -> DataFrame:
    """(threshold, n_over, n, percent): rows above mean + ``sigmas`` sample standard deviations."""
    thr = rows.agg((F.avg(value) + sigmas * F.stddev_samp(value)).alias("threshold"))
    n = rows.crossJoin(F.broadcast(thr)).groupBy("threshold").agg(F.count_if(F.col(value) > F.col("threshold")).alias("n_over"), F.count(value).alias("n"))  # a single row
    return n.withColumn("percent", F.col("n_over") / F.col("n") * 100)


def five_numbers(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, least, q1, median, q3, greatest)."""
    return rows.groupBy(by).agg(F.percentile(value, F.array(*(F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q")).select(by, *(F.col("q")[i].alias(n) for i, n in enumerate(("least", "q1", "median", "q3", "greatest"))))


def f_score(a: Column, b: Column) -> Column:
    """Harmonic mean; null where both are 0."""
    return F.try_divide(2 * a * b, a + b)


def score_gain(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f_gain): mean gain in F score of (tp_new, tn_new) over (tp_old, tn_old), nulls left out."""
    gain = f_score(F.col("tp_new"), F.col("tn_new")) - f_score(F.col("tp_old"), F.col("tn_old"))
    return rows.groupBy(*keys).agg(F.avg(gain).alias("f_gain"))


def spread_means(rows: DataFrame, by: str, name: str, names: list[str], value: str) -> DataFrame:
    """A row for each ``by``, a column for each of ``names`` with the mean of ``value``."""
    return rows.groupBy(by).pivot(name, names).agg(F.avg(value))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "replicate") -> DataFrame:
    """``rows`` with their number within the keys, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def drawn(seed: int, *columns: str) -> Column:
    """A reproducible random text of 32 hexadecimal digits for each row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def sample_rows(rows: DataFrame, share: float, seed: int, *columns: str) -> DataFrame:
    """Each row with chance ``share``, by its columns: any run draws the same rows."""
    return rows.filter(F.substring(drawn(seed, *columns), 1, 8) < f"{int(share * 2**32):08x}")


def sample_groups(rows: DataFrame, keys: list[str], most: int, seed: int, *columns: str) -> DataFrame:
    """At most ``most`` rows of each group, drawn by their columns."""
    w = Window.partitionBy(*keys).orderBy(drawn(seed, *columns), *columns)
    return rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")


def sets_of(rows: DataFrame) -> DataFrame:
    """(a, b, n_both, n_either) of pairs of sets (name, member) that share a member."""
    m = rows.select("name", "member").distinct()
    size = m.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    both = m.select(F.col("name").alias("a"), "member").join(m.select(F.col("name").alias("b"), "member"), "member").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    return both.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "b", "n_both", (F.col("na") + F.col("nb") - F.col("n_both")).alias("n_either"))


def overlap_graph(before: DataFrame, after: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, weight) between clusters (cluster, read_id) of neighbouring windows: shared reads over the geometric mean of either's reads that are in both windows."""
    p, q = before.select(F.col("cluster").alias("a"), "read_id").distinct(), after.select(F.col("cluster").alias("b"), "read_id").distinct()
    rim_a = p.join(q.select("read_id").distinct(), "read_id", "left_semi").groupBy("a").agg(F.count(F.lit(1)).alias("na"))
    rim_b = q.join(p.select("read_id").distinct(), "read_id", "left_semi").groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    both = p.join(q, "read_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(rim_a, "a").join(rim_b, "b")
    return both.select("a", "b", (F.col("n") / F.sqrt(F.col("na") * F.col("nb"))).alias("weight")).filter(F.col("weight") > least)
