"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns virtual nodes on a ring of hash positions. A key belongs to the next node clockwise; when that node's
shard is full it continues clockwise to the first node whose shard has room. With capacities that add up to the number
of keys the counts differ by at most one; with spare capacity fewer keys move when a shard is added.

The ring is cut into cells (the sectors between nodes, split finer). Only the count of each cell reaches the driver; the
walk is done there once over cells, of which there are some for each node. It says how many keys of each cell, in the order of
their positions, each shard takes, so a row's shard and slot follow from its rank within its cell.

Defined results: null ids and repeated ids are keys like others (rows of one id differ by text, then size); a null text
has size 1; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of the ring: 2**14, or 32 for each virtual node if that is more. They are the most rows that the driver and each
#: broadcast hold, at any input size.
LEAST_CELLS, CELLS_A_NODE = 1 << 14, 32
NODES = 64


def cell_bits(shards: int, nodes: int) -> int:
    return max(LEAST_CELLS, CELLS_A_NODE * shards * nodes - 1).bit_length() if CELLS_A_NODE * shards * nodes > LEAST_CELLS else LEAST_CELLS.bit_length() - 1


def _positions(shards: int, nodes: int, seed: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node. A node's place depends on its own shard alone, so others stay when one comes.

    Nodes of one cell follow each other in the order of their places.
    """
    out = []
    for s in range(shards):
        rng = np.random.default_rng([seed, s])
        out += [(int(p), s) for p in rng.integers(0, 1 << 62, nodes)]
    return [(p >> (62 - cell_bits(shards, nodes)), s) for p, s in sorted(out)]


def capacities(total: int, shards: int, spare: float = 0.0) -> list[int]:
    """Keys that each shard takes at most; without spare they add up to the total."""
    if spare:
        return [int(np.ceil(total / shards * (1 + spare)))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: dict[int, int], ring: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first, last, shard, slot): keys ``first`` to ``last`` (exclusive) of a cell, by rank, go to a shard from ``slot`` on.

    First every key that its own node's shard has room for is seated, cells in ring order; then the rest continue
    clockwise, again in ring order.
    """
    cells = [c for c, _ in ring]
    seat, room, over, plan = [0] * len(room), list(room), [], []

    def put(cell: int, first: int, n: int, shard: int) -> int:
        taken = min(n, room[shard])
        if taken:
            plan.append((cell, first, first + taken, shard, seat[shard]))
            room[shard] -= taken
            seat[shard] += taken
        return taken

    for cell in sorted(counts):
        at = bisect.bisect_left(cells, cell) % len(ring)
        taken = put(cell, 0, counts[cell], ring[at][1])
        if taken < counts[cell]:
            over.append((cell, taken, at))
    for cell, first, at in over:
        left = counts[cell] - first
        for step in range(1, len(ring) + 1):
            if not left:
                break
            taken = put(cell, first, left, ring[(at + step) % len(ring)][1])
            first, left = first + taken, left - taken
        if left:
            raise ValueError("capacities do not hold all keys")
    return plan


def shard(df: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, spare: float = 0.0, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, home_shard (the one that the ring alone would name) for each row."""
    facts = df.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text_col, F.lit(""))).alias("text_crc32"))
    # rows of one id are keys of their own, if their texts differ
    facts = facts.withColumn("at", F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed)))
    facts = facts.withColumn("cell", F.shiftrightunsigned("at", 64 - cell_bits(shards, nodes)).cast("int"))
    counts = {r[0]: r[1] for r in facts.groupBy("cell").count().collect()}  # a row for each cell
    ring = _positions(shards, nodes, seed)
    rows = walk(counts, ring, capacities(sum(counts.values()), shards, spare))
    by_cell: dict[int, list] = {}
    for c, first, last, s, slot in rows:
        by_cell.setdefault(c, []).append((first, last, s, slot))
    cells = [c for c, _ in ring]
    spark = df.sparkSession
    plan = spark.createDataFrame([(c, ring[bisect.bisect_left(cells, c) % len(ring)][1], p) for c, p in by_cell.items()], "cell int, home_shard int, parts array<struct<first:long,last:long,shard:int,slot:long>>")
    order = Window.partitionBy("cell").orderBy("at", "doc_id", "text_crc32", "size")
    placed = facts.withColumn("r", (F.row_number().over(order) - 1).cast("long")).join(F.broadcast(plan), "cell")
    mine = F.filter("parts", lambda p: (F.col("r") >= p["first"]) & (F.col("r") < p["last"]))[0]
    return placed.withColumn("p", mine).select("doc_id", "size", "text_crc32", F.col("p.shard").alias("shard"), (F.col("p.slot") + F.col("r") - F.col("p.first")).alias("slot"), "home_shard")
