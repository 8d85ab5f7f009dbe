"""Structural clusters of reads from critical regions.

The regions of one genome are few (a table of at most thousands of rows), so they are merged on the driver; which reads
belong to a region, or span it, is worked out by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import coverage

#: Units on either side of a region that a spanning read must touch: from twice the offset to once the offset away.
OFFSET = 4
#: Two clusters join if they share more reads than MIN_SHARED and fewer reads than MAX_FORBIDS forbid it.
MIN_SHARED, MAX_FORBIDS = 15, 10
MOST_REGIONS = 10_000


def confluent_regions(units: DataFrame, least: int = 15, sigmas: float = 4.0, edge: int = 5) -> DataFrame:
    """(contig, start, end, down, total): peaks of read ends by the direction that leads away from them.

    Peaks of downstream ends at a contig's first units and of upstream ends at its last units are left out: reads end there anyway.
    """
    ends = coverage.end_directions(units)
    grid = coverage.unit_spine(units).join(ends, ["contig", "unit"], "left").fillna(0, ["down", "up"])
    last = units.groupBy("contig").agg(F.max("unit").alias("last_unit"))
    both = coverage.peaks(grid, "down", least, sigmas).withColumn("down", F.lit(True)).unionByName(coverage.peaks(grid, "up", least, sigmas).withColumn("down", F.lit(False)))
    found = both.join(F.broadcast(last), "contig")
    artefact = (F.col("down") & (F.col("end") < edge)) | (~F.col("down") & (F.col("start") + edge > F.col("last_unit")))
    return found.filter(~artefact).select("contig", "start", "end", "down", "total")


def region_reads(units: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, read_id): reads with a unit inside a region (region, contig, start, end), end exclusive."""
    inside = units.join(regions, "contig").filter((F.col("unit") >= F.col("start")) & (F.col("unit") < F.col("end")))
    return inside.select("region", "read_id").distinct()


def spanning_reads(units: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, read_id): reads that touch both flanks of a region; past the contig's end the right flank starts again at 0."""
    left = (F.col("unit") >= F.greatest(F.col("start") - 2 * OFFSET, F.lit(0))) & (F.col("unit") < F.greatest(F.col("start") - OFFSET, F.lit(0)))
    wraps = F.col("end") + 2 * OFFSET >= F.col("longest")
    right = F.when(wraps, F.col("unit") < OFFSET).otherwise((F.col("unit") >= F.col("end") + OFFSET) & (F.col("unit") < F.col("end") + 2 * OFFSET))
    last = units.groupBy("contig").agg(F.max("unit").alias("longest"))
    both = units.join(regions.join(last, "contig"), "contig")
    return both.groupBy("region", "read_id").agg(F.bool_or(left).alias("l"), F.bool_or(right).alias("r")).filter("l and r").select("region", "read_id")


def merge_clusters(reads: dict[int, set], spans: dict[int, set], confluent: set[int], least: int = MIN_SHARED, most: int = MAX_FORBIDS) -> list[dict]:
    """Clusters {regions, reads}, merged to a fixed point: the first pair in order joins, then the search starts again.

    A pair joins if it shares more than ``least`` reads, and if fewer than ``most`` reads of one span a region of the other
    or all its regions are confluent ones. Reads that the other side forbids leave the merged cluster.
    """
    clusters = [{"regions": {r}, "reads": set(reads[r])} for r in sorted(reads)]
    barred = lambda c: set().union(*(spans.get(r, set()) for r in c["regions"]))

    def step() -> bool:
        for i, a in enumerate(clusters):
            for j in range(i + 1, len(clusters)):
                b = clusters[j]
                forbids = len((a["reads"] & barred(b)) | (b["reads"] & barred(a)))
                if len(a["reads"] & b["reads"]) > least and (forbids < most or a["regions"] | b["regions"] <= confluent):
                    merged = (a["reads"] - barred(b)) | (b["reads"] - barred(a))
                    clusters[i] = {"regions": a["regions"] | b["regions"], "reads": merged}
                    del clusters[j]
                    return True
        return False

    while step():
        pass
    return clusters


def initial_clusters(units: DataFrame, regions: DataFrame) -> DataFrame:
    """(cluster, read_id). regions: (region, contig, start, end, confluent)."""
    spark = units.sparkSession
    known = regions.limit(MOST_REGIONS + 1).collect()
    if len(known) > MOST_REGIONS:
        raise ValueError("too many critical regions for one genome")
    reads: dict[int, set] = {r["region"]: set() for r in known}
    spans: dict[int, set] = {}
    at = regions.select("region", "contig", "start", "end")
    for r in region_reads(units, at).toLocalIterator():
        reads[r["region"]].add(r["read_id"])
    for r in spanning_reads(units, at).toLocalIterator():
        spans.setdefault(r["region"], set()).add(r["read_id"])
    found = merge_clusters(reads, spans, {r["region"] for r in known if r["confluent"]})
    rows = [(i, x) for i, c in enumerate(found) for x in sorted(c["reads"])]
    return spark.createDataFrame(rows, f"cluster int, read_id {units.schema['read_id'].dataType.simpleString()}")
