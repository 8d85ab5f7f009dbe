"""The joins that large tables take (sides over the broadcast bound, hot groups, runs cut by batches) give the same rows."""

import random

import pytest
import test_decontam
import test_ngramjoin
import test_repeats

from helixframe.llm import common, decontam, ngramjoin, repeats


@pytest.fixture
def large(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(ngramjoin, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 3)
    monkeypatch.setattr(ngramjoin, "_ROWS", 5)
    monkeypatch.setattr(ngramjoin, "GIANT", 4)
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(repeats, "_ROWS", 5)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def texts(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(90)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([12, 25, 40]))] for _ in range(4)]
    out = []
    for i in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randrange(1, 60))]
        for p in passages:
            if rng.random() < 0.3:
                t[rng.randrange(len(t)) :][:0] = p
                t += p
        out.append((i * 7 % 61, " ".join(t)))
    near = list(out[5])
    out += [(100 + k, f"{near[1]} end{k}") for k in range(9)] + [(200, out[3][1]), (201, out[3][1]), (out[4][0], out[4][1]), (300, None), (301, ""), (None, out[9][1])]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages(spark, large, seed):
    rows = texts(seed)
    assert test_repeats.got(spark, rows, 4) == test_repeats.brute(rows, 4)


@pytest.mark.parametrize(("num", "den", "n"), [(90, 100, 3), (8, 10, 5)])
def test_similar_texts(spark, large, num, den, n):
    rows = texts(3)
    assert test_ngramjoin.got(spark, rows, num, den, n) == test_ngramjoin.brute(rows, num, den, n)


def test_bitmap_keeps_what_it_must(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = spark.range(3000).selectExpr("if(id % 50 = 0, null, id) as k", "id")
    keys = spark.range(0, 3000, 7).selectExpr("id as k")
    with_ = {r["id"] for r in common.with_keys(rows, keys, ["k"], 429).collect()}
    without = {r["id"] for r in common.without_keys(rows, keys, ["k"], 429).collect()}
    assert with_ == {i for i in range(3000) if i % 7 == 0 and i % 50} and without == set(range(3000)) - with_


def test_contained_items(spark, large):
    test_decontam.test_against_brute_force(spark)
