import hashlib
import random
import re

import pytest

from helixframe.llm import repeats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """rows: (doc_id, text). The rule taken literally."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda d: (d[0], d[1]))
    seen, result = set(), {}
    for null, i, t in docs:
        w = WORDS.findall(t)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            if key in seen:
                gone[p : p + width] = [True] * width
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        result[(None if null else i, t)] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted(((i, *result[(i, t or "")]) for i, t in rows), key=str)


def got(spark, rows, width, schema="doc_id long, text string, t1 string, n_words int"):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], schema)
    return sorted((tuple(r) for r in repeats.remove_repeats(df, width=width).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["a", "the", "of", *("w%d" % i for i in range(40)), "é", "naïve"]
    passage = [rng.choice(vocab) for _ in range(35)]
    rows = []
    for i in range(120):
        t = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            at = rng.randrange(len(t) + 1)
            t[at:at] = passage[rng.randrange(5) :]
        if i % 7 == 0:
            t += ["the"] * rng.randrange(60) + ["a", "b"] * rng.randrange(30)
        rows.append((i * 3 % 121, " ".join(t).replace(" of ", "\n of\t\t")))
    rows += [(500 + i, rows[i][1]) for i in range(10)]
    assert got(spark, rows, 20) == brute(rows, 20)
    assert got(spark, rows, 4) == brute(rows, 4)


def test_nulls_ties_and_lengths(spark):
    a = " ".join(f"x{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, a), (4, a), (5, a), (None, a), (6, "short text"), (7, a + " tail"), (8, "u v " * 3000)]
    assert got(spark, rows, 20) == brute(rows, 20)


def test_empty_table(spark):
    assert got(spark, [], 20) == []


@pytest.mark.parametrize("rounds", [1, 3])
def test_equal_windows_have_equal_anchors(rounds):
    import numpy as np

    from helixframe.llm.recompress import window_anchors
    from helixframe.llm.textblocks import grams, random_table

    rng = np.random.default_rng(rounds)
    table = random_table(3, 6)
    words = table[rng.integers(0, 6, 4000)]
    words[1000:1100], words[2000:2080] = words[0:100], table[1]
    doc = np.repeat(np.arange(8), 500)
    at, key, place = window_anchors(words, doc, 20, rounds)
    g, _, where = grams(words, doc, 20)
    assert (where == at).all()
    found = {}
    for w, k, off in zip(g.tolist(), key.tolist(), (place - at).tolist()):
        assert 0 <= off < 20
        assert found.setdefault(w, (k, off)) == (k, off)
