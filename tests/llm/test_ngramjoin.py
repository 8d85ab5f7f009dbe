import random
import re

import numpy as np
import pytest

from helixframe.llm import ngramjoin
from helixframe.llm.textblocks import random_table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORDS.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, num, den, n):
    sets = [shingles(t, n) for _, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    changed = True
    pairs = [(a[0], b[0]) for (a, x) in zip(rows, sets) for (b, y) in zip(rows, sets) if a[0] is not None and b[0] is not None and x and y and den * len(x & y) >= num * len(x | y)]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return sorted([(i, len(s), label.get(i)) for (i, _), s in zip(rows, sets)], key=str)


def got(spark, rows, num, den, n):
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, node int, family string")
    return sorted([tuple(r) for r in ngramjoin.groups(df, num=num, den=den, n=n).collect()], key=str)


@pytest.mark.parametrize(("num", "den", "n"), [(90, 100, 3), (8, 10, 5)])
def test_against_brute_force(spark, num, den, n):
    rng = random.Random(num)
    vocab = [f"w{i}" for i in range(500)] + ["The", "ÉA", "of"]
    line = [rng.choice(vocab) for _ in range(12)]
    rows = []
    for f in range(14):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 9, 20, 60, 150, 400]))]
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, len(t) // 30))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.2:
                t += line
            rows.append((len(rows) * 7 % 101, " ".join(t).upper() if rng.random() < 0.1 else "\n ".join(t)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, "one two"), (None, rows[0][1]), (205, "a b c " * 500), (206, "a b c " * 400)]
    rows.append(rows[3])
    assert got(spark, rows, num, den, n) == brute(rows, num, den, n)


def test_empty_table(spark):
    assert got(spark, [], 9, 10, 3) == []


@pytest.mark.parametrize(("num", "den"), [(90, 100), (8, 10)])
def test_similar_sets_share_a_signature(num, den):
    s, rng = ngramjoin.scheme(num, den), np.random.default_rng(num)
    table = random_table(9, 40_000)
    for trial in range(250):
        b = int(rng.choice([5, 11, 19, 30, 77, 150, 401, 900]))
        kept = -(-num * b // den) if trial % 2 else int(rng.integers(-(-num * b // den), b + 1))
        base = rng.choice(table, b, replace=False)
        x, y = base, base[:kept]  # the least similar that link, or closer
        if trial % 3 == 0:
            d = int(s.tolerance(b, b)) // 2
            y = np.concatenate((base[d:], rng.choice(table, d)))
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if den * both < num * (len(x) + len(y) - both) or len(x) == len(y) == both:
            continue
        row = np.repeat([0, 1], [len(x), len(y)])
        at, sig = ngramjoin.signatures(row, np.concatenate((x, y)), 2, s)
        assert np.intersect1d(sig[at == 0], sig[at == 1]).size, (b, kept, trial)
