"""Coverage of reference units and what is read from it: boundaries, islands, windows, peaks, genome size.

A units table has (read_id, pos, contig, unit): the units met along each read, in the order of pos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unit_spine(units: DataFrame) -> DataFrame:
    """(contig, unit) for every unit from 0 to the last one seen on the contig."""
    last = units.groupBy("contig").agg(F.max("unit").alias("last_unit"))
    return last.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_unit"))).alias("unit"))


def unit_coverage(units: DataFrame) -> DataFrame:
    """Count of encoded units per (contig, unit), zero where no read has the unit."""
    count = units.groupBy("contig", "unit").agg(F.count(F.lit(1)).alias("cov"))
    return unit_spine(units).join(count, ["contig", "unit"], "left").select("contig", "unit", F.coalesce("cov", F.lit(0).cast("long")).alias("cov"))


def read_ends(units: DataFrame) -> DataFrame:
    """(read_id, first, last): structs (pos, contig, unit) of each read's outer units, in one aggregate."""
    at = F.struct("pos", "contig", "unit")
    return units.groupBy("read_id").agg(F.min(at).alias("first"), F.max(at).alias("last"))


def start_stop(units: DataFrame) -> DataFrame:
    """How many reads begin or end in each unit; a read of one unit counts twice there."""
    both = read_ends(units).select(F.explode(F.array("first", "last")).alias("e"))
    return both.groupBy(F.col("e.contig").alias("contig"), F.col("e.unit").alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def end_directions(units: DataFrame, margin: int = 5) -> DataFrame:
    """(contig, unit, down, up): read ends by the direction in which most of the ``margin`` outermost steps lead away.

    Reads of up to 2 * margin units are left out; steps between contigs have no direction.
    """
    w = Window.partitionBy("read_id").orderBy("pos")
    whole = Window.partitionBy("read_id")
    steps = units.withColumns({"c2": F.lead("contig").over(w), "u2": F.lead("unit").over(w), "n": F.count(F.lit(1)).over(whole), "k": F.row_number().over(w)})
    steps = steps.filter(F.col("n") > 2 * margin)
    same = F.col("c2") == F.col("contig")
    head, tail = F.col("k") <= margin, (F.col("k") >= F.col("n") - margin) & (F.col("k") < F.col("n"))
    more = lambda where, up: F.count_if(where & same & up) > F.call_function("div", F.count_if(where & same), F.lit(2))
    at = F.struct("pos", "contig", "unit")
    ends = steps.groupBy("read_id").agg(F.min(at).alias("f"), F.max(at).alias("l"), more(head, F.col("unit") < F.col("u2")).alias("fd"), more(tail, F.col("unit") > F.col("u2")).alias("ld"))
    flat = ends.select(F.explode(F.array(F.struct("f.contig", "f.unit", F.col("fd").alias("down")), F.struct("l.contig", "l.unit", F.col("ld").alias("down")))).alias("e"))
    return flat.groupBy("e.contig", "e.unit").agg(F.count_if("e.down").alias("down"), F.count_if(~F.col("e.down")).alias("up"))


def islands(rows: DataFrame, keep: Column, keys: list[str], at: str, gap: int = 1) -> DataFrame:
    """(keys, start, end): maximal stretches of kept positions less than ``gap`` + 1 apart; end is exclusive."""
    w = Window.partitionBy(*keys).orderBy(at)
    kept = rows.filter(keep).withColumn("new", F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1))
    return kept.withColumn("island", F.sum("new").over(w)).groupBy(*keys, "island").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end")).drop("island")


def mean_coverage(cov: DataFrame) -> DataFrame:
    """(contig, mean), the mean truncated."""
    return cov.groupBy("contig").agg(F.expr("sum(cov) div count(*)").alias("mean"))


def covered_islands(cov: DataFrame, least_width: int = 7) -> DataFrame:
    """Stretches with more than a quarter of the contig's mean coverage, at least ``least_width`` units wide."""
    thr = cov.join(F.broadcast(mean_coverage(cov)), "contig")  # a row for each contig
    return islands(thr, F.col("cov") > F.expr("mean div 4"), ["contig"], "unit").filter(F.col("end") - F.col("start") >= least_width)


def windows(cov: DataFrame, size: int = 20, overlap: int = 0, compat: bool = False) -> DataFrame:
    """Islands cut into windows: one if narrower than ``size``, else n + 1 of them (the last may be empty), from unit 1 on.

    All but the last two are ``size`` wide; these two end with the island. compat: a window is that wide while its number
    is less than the place (not the number) of the last one but one.
    """
    step = size - overlap
    n = F.when(F.col("end") - F.col("start") < size, F.lit(0)).otherwise(F.call_function("div", F.col("end") - F.col("start"), F.lit(step)))
    i = covered_islands(cov).select("contig", "start", "end", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("i"))
    last = F.call_function("div", F.col("end") - F.col("start"), F.lit(step)) - 1
    s = F.col("start") + F.col("i") * step
    narrow = F.col("end") - F.col("start") < size
    full = ~narrow & (F.col("i") < (F.col("start") + last * step if compat else last))
    return i.select("contig", F.greatest(s, F.lit(1)).alias("start"), F.when(full, s + size).otherwise(F.col("end")).alias("end"))


def window_members(units: DataFrame, size: int = 20) -> DataFrame:
    """(contig, win, read_id, n_units, first_unit, last_unit): units of each read in each window, by an equi key."""
    return units.withColumn("win", F.expr(f"unit div {size}")).groupBy("contig", "win", "read_id").agg(F.count(F.lit(1)).alias("n_units"), F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"))


def peaks(counts: DataFrame, n: str = "n", least: int = 15, sigmas: float = 4.0, gap: int = 5) -> DataFrame:
    """(contig, start, end, total): merged positions at or over max(floor(mean + sigmas * sd), least), means over positions that are not 0.

    A peak is kept if its total over its width and one exceeds the threshold, by whole numbers.
    """
    stat = counts.filter(F.col(n) > 0).groupBy("contig").agg(F.avg(n).alias("m"), F.avg(F.col(n) * F.col(n)).alias("q"))
    thr = stat.select("contig", F.greatest(F.floor(F.col("m") + sigmas * F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))).cast("long"), F.lit(least).cast("long")).alias("thr"))
    at = counts.join(F.broadcast(thr), "contig")
    found = islands(at, F.col(n) >= F.col("thr"), ["contig"], "unit", gap - 1)
    c = counts.select("contig", "unit", n)
    inside = found.join(c, "contig").filter((F.col("unit") >= F.col("start")) & (F.col("unit") < F.col("end"))).groupBy("contig", "start", "end").agg(F.sum(n).alias("total"))
    return inside.join(F.broadcast(thr), "contig").filter(F.expr("total div (end - start + 1)") > F.col("thr")).select("contig", "start", "end", "total")


def genome_size(cov: DataFrame, least: int = 10, unit_bases: int = 100) -> DataFrame:
    """Units met more than ``least`` times, and the size in thousands of bases that they stand for, truncated."""
    return cov.filter(F.col("cov") > least).agg(F.count(F.lit(1)).alias("n_units")).select("n_units", F.expr(f"n_units * {unit_bases} div 1000").alias("kb"))


def without_rare_units(units: DataFrame, most: int = 2) -> DataFrame:
    """Ids of reads that have no unit met ``most`` times or less."""
    rare = units.groupBy("contig", "unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    return units.select("read_id").distinct().join(units.join(rare, ["contig", "unit"], "left_semi").select("read_id").distinct(), "read_id", "left_anti")


def run_lengths(units: DataFrame) -> DataFrame:
    """(read_id, run, contig, first_unit, last_unit, n): stretches of one contig whose neighbours differ by less than 2."""
    w = Window.partitionBy("read_id").orderBy("pos")
    new = F.when((F.lag("contig").over(w) == F.col("contig")) & (F.abs(F.lag("unit").over(w) - F.col("unit")) < 2), 0).otherwise(1)
    runs = units.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("read_id", "run", "contig").agg(F.min(F.struct("pos", "unit")).alias("a"), F.max(F.struct("pos", "unit")).alias("b"), F.count(F.lit(1)).alias("n")).select("read_id", "run", "contig", F.col("a.unit").alias("first_unit"), F.col("b.unit").alias("last_unit"), "n")


def jumps(units: DataFrame, near: int = 10, edge: int = 5) -> DataFrame:
    """Counts of jumps by (contig, unit, to_contig, to_unit, from_up, to_up).

    A jump is four units in a row where the two inner ones are on other contigs or more than ``near`` apart and each outer
    one is within ``near`` of its inner one. Jumps over a contig's origin are left out. The smaller inner unit comes first.
    """
    w = Window.partitionBy("read_id").orderBy("pos")
    q = units.select("read_id", "pos", F.col("contig").alias("c0"), F.col("unit").alias("u0"), *(F.lead("contig", k).over(w).alias(f"c{k}") for k in (1, 2, 3)), *(F.lead("unit", k).over(w).alias(f"u{k}") for k in (1, 2, 3))).filter("c3 is not null")
    d = lambda a, b: F.abs(F.col(f"u{a}") - F.col(f"u{b}"))
    q = q.filter((F.col("c0") == F.col("c1")) & (F.col("c2") == F.col("c3")) & (d(0, 1) <= near) & (d(2, 3) <= near) & ((F.col("c1") != F.col("c2")) | (d(1, 2) > near)))
    last = units.groupBy(F.col("contig").alias("c1")).agg(F.max("unit").alias("last_unit"))
    q = q.join(F.broadcast(last), "c1").filter(~((F.col("c1") == F.col("c2")) & (F.least("u1", "u2") < edge) & (F.greatest("u1", "u2") > F.col("last_unit") - edge)))
    first = F.col("u1") < F.col("u2")
    return q.select(
        F.when(first, F.col("c1")).otherwise(F.col("c2")).alias("contig"), F.least("u1", "u2").alias("unit"),
        F.when(first, F.col("c2")).otherwise(F.col("c1")).alias("to_contig"), F.greatest("u1", "u2").alias("to_unit"),
        F.when(first, F.col("u0") < F.col("u1")).otherwise(F.col("u2") > F.col("u3")).alias("from_up"), F.when(first, F.col("u2") > F.col("u3")).otherwise(F.col("u0") < F.col("u1")).alias("to_up"),
    ).groupBy("contig", "unit", "to_contig", "to_unit", "from_up", "to_up").agg(F.count(F.lit(1)).alias("n"))


def linear_positions(units: DataFrame) -> DataFrame:
    """(contig, unit, place): units laid end to end, contigs in order, each from its first to its last unit."""
    span = units.groupBy("contig").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    before = F.sum(F.col("hi") - F.col("lo") + 1).over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1))  # a row for each contig
    return units.select("contig", "unit").distinct().join(F.broadcast(span.withColumn("before", F.coalesce(before, F.lit(0)))), "contig").select("contig", "unit", (F.col("before") + F.col("unit") - F.col("lo")).alias("place"))


def peak_ranges(starts: DataFrame, lengths: DataFrame) -> DataFrame:
    """(contig, start, end): each start reaches to the next one, the last to the contig's length."""
    nxt = F.lead("start").over(Window.partitionBy("contig").orderBy("start"))
    return starts.withColumn("next", nxt).join(F.broadcast(lengths), "contig").select("contig", "start", F.coalesce("next", "length").alias("end"))


def as_of(points: DataFrame, starts: DataFrame, keys: list[str], at: str, start: str, bin_size: int = 1024) -> DataFrame:
    """``points`` with ``found``: the greatest start at or before ``at``.

    Points look among the starts of their own bin of the axis; a bin without one gets the last start of the bins before,
    which is found over a row for each bin. So the points of a key meet in as many groups as it has bins.
    """
    at_bin = lambda c: F.floor(F.col(c) / bin_size)
    there = starts.select(*keys, F.col(start).alias("__s"), at_bin(start).alias("__b")).distinct()
    asked = points.select(*keys, F.col(at).alias("__at"), at_bin(at).alias("__b")).distinct()
    near = asked.join(there, [*keys, "__b"], "left").filter("__s is null or __s <= __at").groupBy(*keys, "__at", "__b").agg(F.max("__s").alias("near"))
    lost = asked.join(near, [*keys, "__at", "__b"], "left")
    bins = there.groupBy(*keys, "__b").agg(F.max("__s").alias("top")).unionByName(asked.select(*keys, "__b").distinct().withColumn("top", F.lit(None).cast("long"))).groupBy(*keys, "__b").agg(F.max("top").alias("top"))
    before = bins.withColumn("far", F.max("top").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    found = lost.join(before, [*keys, "__b"], "left").select(*keys, F.col("__at").alias(at), F.coalesce("near", "far").alias("found"))
    return points.join(found, [*keys, at], "left")
