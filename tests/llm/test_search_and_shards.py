import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import sharding, topk


def brute(rows, k, every, scale=256):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            y = [math.floor(scale * float(np.float32(c))) for c in x]
            v[i] = max(v.get(i, y), y)
    out = []
    for q in v:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[d])), d) for d in v if d != q)
            out += [(q, r + 1, d, -x) for r, (x, d) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(512, 4096), (3, 16)])
def test_topk_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "QUERY_BLOCK", sizes[0])
    monkeypatch.setattr(topk, "ROW_BLOCK", sizes[1])
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, -0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[10][1]) for i in range(9)] + [(300, None), (305, [None] * 8), (310, [float("nan")] * 8), (315, [float("inf")] + [0.0] * 7), (320, [0.0] * 8), (325, []), (330, [1.0] * 3), (None, [1.0] * 8), (10, [0.1] * 8)]
    df = spark.createDataFrame([(*r, 1, [2.0]) for r in rows], "vec_id long, embedding array<float>, label int, v array<double>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("id") % 5 == 0, 5).collect())
    assert got == brute(rows, 5, 5)


def test_topk_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.exact_topk(df, F.col("id") == 0, 5).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.exact_topk(df.filter("false"), F.col("id") == 0, 5).collect() == []


def test_vectors_reach_no_driver(spark, monkeypatch):
    """Copies of the queries, one for each group of rows, were a broadcast: the driver held them all."""
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(600)]
    found = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0, 5)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 5, 50)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_groups_of_queries(spark, monkeypatch):
    """More queries than a task holds, components of every width, zeros, copies and vectors of several lengths."""
    for name, value in (("QUERY_NUMBERS", 40), ("ROW_BLOCK", 7), ("QUERY_BLOCK", 2), ("TILE", 1)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(12)
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, rng.uniform(-1, 1), 300.0 * (i == 40), 2.0**20 * (i == 41)]) for _ in range(8 - i % 3)]) for i in range(90)]
    rows += [(100 + i, rows[i % 2][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.exact_topk(df, F.col("id") % 5 == 0, 4).collect()) == brute(rows, 4, 5)


def test_large_weights_do_not_overflow():
    a = np.array([[2**20, -(2**20)]])
    assert topk.accumulate(a, a).tolist() == [[2**41]]


def place(spark, rows, shards, **options):
    df = spark.createDataFrame([(*r, 3, "b") for r in rows], "doc_id long, text string, r int, cell string")
    return sharding.shard(df, shards, **options).collect()


def test_shards_are_even_and_slots_have_no_gaps(spark):
    rng = random.Random(6)
    rows = [(i, "é" * rng.randrange(30)) for i in range(1003)] + [(None, None), (None, "x"), (5, "y"), (5, "y")]
    out = place(spark, rows, 8)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 1) for i, t in rows)
    by = [[r["slot"] for r in out if r["shard"] == s] for s in range(8)]
    assert all(sorted(x) == list(range(len(x))) for x in by) and max(map(len, by)) - min(map(len, by)) <= 1
    assert place(spark, [], 8) == []
    assert len({r["shard"] for r in place(spark, rows[:3], 8)}) == 3


def test_limited_movement_and_bounds(spark):
    rows = [(i, "t") for i in range(4000)]
    a, b = ({r["doc_id"]: r["shard"] for r in place(spark, rows, n, spare=0.1)} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) / len(a) < 0.35
    for shards, placed in ((8, a), (9, b)):
        assert max(np.bincount(list(placed.values()), minlength=shards)) <= math.ceil(4000 / shards * 1.1)


def test_walk_goes_on_clockwise():
    ring = [(10, 0), (20, 1), (30, 2)]
    assert sharding.walk({5: 5, 15: 1, 25: 1}, ring, [2, 3, 4]) == [(5, 0, 2, 0, 0), (15, 0, 1, 1, 0), (25, 0, 1, 2, 0), (5, 2, 4, 1, 1), (5, 4, 5, 2, 1)]


def test_placement_equals_a_walk_key_by_key(spark):
    """Keys in the order of their places: each to its own node's shard while that has room, then the rest clockwise."""
    rows = [(i, "x" * (i % 17)) for i in range(700)] + [(3, "other"), (3, "third")]
    for shards, nodes in ((5, 8), (40, 64)):
        out = place(spark, rows, shards, nodes=nodes)
        at = spark.createDataFrame([(r["doc_id"], r["size"], r["text_crc32"]) for r in out], "doc_id long, size long, text_crc32 long")
        keyed = [tuple(r) for r in at.select(F.xxhash64("doc_id", "text_crc32", "size", F.lit(17)).alias("at"), "doc_id", "text_crc32").collect()]
        bits = sharding.cell_bits(shards, nodes)
        assert (1 << bits) >= 32 * shards * nodes
        ring = sharding._positions(shards, nodes, 17)
        room, over, want = sharding.capacities(len(rows), shards), [], {}
        order = sorted(((a % 2**64) >> (64 - bits), a, d, c) for a, d, c in keyed)
        for cell, _, d, c in order:
            node = next((k for k, (x, _) in enumerate(ring) if x >= cell), 0)
            if room[ring[node][1]]:
                room[ring[node][1]] -= 1
                want[d, c] = ring[node][1]
            else:
                over.append((cell, node, d, c))
        for _, node, d, c in over:
            s = next(ring[(node + k) % len(ring)][1] for k in range(1, len(ring) + 1) if room[ring[(node + k) % len(ring)][1]])
            room[s] -= 1
            want[d, c] = s
        assert {(r["doc_id"], r["text_crc32"]): r["shard"] for r in out} == want
