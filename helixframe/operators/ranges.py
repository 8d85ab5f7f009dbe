"""Range joins between alignments, repeats and reads. Both sides meet on bins of the axis, never on a contig alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 1000
#: Repeats are looked for this far around an alignment's place; support is asked for at one and two steps before a repeat.
MARGIN, STEP = 200, 550


def _bins(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / BIN), F.floor(last / BIN)))


def containing(rows: DataFrame, ranges: DataFrame, inside: Column, low: Column, high: Column) -> DataFrame:
    """``rows`` (contig, st, en, ...) beside each of ``ranges`` (contig, rs, re, ...) for which ``inside`` holds.

    low, high: the least and greatest ``st`` that a range can contain.
    """
    spread = ranges.filter(low <= high).withColumn("__bin", _bins(low, high))
    return rows.withColumn("__bin", F.floor(F.col("st") / BIN)).join(spread, ["contig", "__bin"]).filter(inside).drop("__bin")


def in_repeats(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """``rows`` with each repeat that strictly contains them."""
    return containing(rows, repeats, (F.col("rs") < F.col("st")) & (F.col("en") < F.col("re")), F.col("rs"), F.col("re"))


def not_in_repeats(rows: DataFrame, repeats: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that no repeat strictly contains; ``keys`` tell rows apart."""
    return rows.join(in_repeats(rows, repeats).select(*keys).distinct(), keys, "left_anti")


def trimmed(alns: DataFrame, repeats: DataFrame, keys: list[str], read: str = "read_id") -> DataFrame:
    """Alignments (read, contig, st, en) outside repeats (contig, rs, re, ord), or whose read has support before the repeat.

    Only the first repeat (by ``ord``) that has the alignment within MARGIN counts; support is an alignment of the same
    read that goes over the place STEP or two STEPs before the repeat.
    """
    low = F.greatest(F.col("rs"), F.lit(MARGIN)) - MARGIN
    hit = containing(alns, repeats, (low <= F.col("st")) & (F.col("en") <= F.col("re") + MARGIN), low, F.col("re") + MARGIN)
    first = hit.groupBy(read, *[k for k in keys if k != read]).agg(F.min_by("rs", "ord").alias("rs"))
    one = F.greatest(F.col("rs"), F.lit(STEP)) - STEP
    two = F.greatest(one, F.lit(STEP)) - STEP
    over = lambda at: (F.col("st") < at) & (at < F.col("en"))
    asked = first.select(read, "rs").distinct()
    backed = alns.select(read, "st", "en").join(asked, read).filter(over(one) | over(two)).select(read, "rs").distinct()
    lost = first.join(backed, [read, "rs"], "left_anti").select(*keys)
    return alns.join(lost, keys, "left_anti")


def not_in_other_pairs(pairs: DataFrame, key: str = "key") -> DataFrame:
    """Pairs of ranges (key, c1, s1, e1, c2, s2, e2) none of whose ranges lies in a range of another pair, ends included."""
    side = lambda k: F.struct(F.col(f"c{k}").alias("contig"), F.col(f"s{k}").alias("st"), F.col(f"e{k}").alias("en"))
    sides = pairs.select(key, F.explode(F.array(side(1), side(2))).alias("x")).select(key, "x.*")
    others = sides.select("contig", F.col("st").alias("rs"), F.col("en").alias("re"), F.col(key).alias("other"))
    inside = (F.col("rs") <= F.col("st")) & (F.col("en") <= F.col("re")) & (F.col("other") != F.col(key))
    lost = containing(sides, others, inside, F.col("rs"), F.col("re")).select(key).distinct()
    return pairs.join(lost, key, "left_anti")


def region_pair_counts(regions: DataFrame, units: DataFrame) -> DataFrame:
    """(contig, a_start, a_end, b_start, b_end, n): reads that have units in both of two regions of a contig.

    regions: (region, contig, start, end), a bounded list.
    """
    hit = units.join(F.broadcast(regions), "contig").filter("unit >= start and unit < end").select("read_id", "contig", "region", "start", "end").distinct()
    a = hit.select("read_id", "contig", F.col("region").alias("ra"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = hit.select("read_id", "contig", F.col("region").alias("rb"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return a.join(b, ["read_id", "contig"]).filter("ra < rb").groupBy("contig", "a_start", "a_end", "b_start", "b_end").agg(F.count(F.lit(1)).alias("n"))


def far_from_pairs(regions: DataFrame, pairs: DataFrame, near: int = 4) -> DataFrame:
    """Regions (contig, start, end) that no side of ``pairs`` (contig, start, end) comes within ``near`` units of."""
    touch = (F.col("r.contig") == F.col("p.contig")) & (F.col("r.start") - near < F.col("p.end")) & (F.col("p.start") < F.col("r.end") + near)
    return regions.alias("r").join(F.broadcast(pairs.select("contig", "start", "end")).alias("p"), touch, "left_anti")  # pairs: a bounded list


def boundary_reads(units: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, read_id) of reads that have a region's first or last unit. regions: (region, contig, start, end)."""
    at = regions.select("region", "contig", F.explode(F.array("start", F.col("end") - 1)).alias("unit")).distinct()
    return units.join(F.broadcast(at), ["contig", "unit"]).select("region", "read_id").distinct()


def sequences_of(alns: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Alignments (read_id, contig, st, en) whose read and contig are known, with the read's bases there."""
    known = alns.join(F.broadcast(contigs.select("contig").distinct()), "contig", "left_semi")  # a row for each contig
    return known.join(reads.select("read_id", "seq"), "read_id").withColumn("bases", F.expr("substring(seq, cast(st + 1 as int), cast(en - st as int))")).drop("seq")
