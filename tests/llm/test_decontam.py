import random
import re

from helixframe.llm import decontam

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORDS.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, n=5, num=8, den=10):
    out = []
    asked = [(i, shingles(b, n)) for i, b in set(items)]
    for d, t in docs:
        own = shingles(t, n)
        out += [(d, i, len(x & own), len(x)) for i, x in asked if x and den * len(x & own) >= num * len(x)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, n_item int"), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)] + ["The", "é", "of"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 9, 15, 30, 55])))) for i in range(25)] + [(3, "another text of the same id"), (90, None), (91, "")]
    docs = []
    for d in range(150):
        t = [rng.choice(vocab) for _ in range(rng.choice([0, 4, 30, 200, 3000]))]
        for _ in range(rng.randrange(3)):
            b = (items[rng.randrange(25)][1] or "").split()
            if rng.random() < 0.5 and len(b) > 6:
                b[rng.randrange(len(b))] = "changed"
            at = rng.randrange(len(t) + 1)
            t[at:at] = b if rng.random() < 0.8 else b[: len(b) // 2]
        docs.append((d, "\t".join(t).upper() if d % 9 == 0 else " \n".join(t)))
    docs += [(None, docs[4][1]), (7, docs[7][1]), (200, None)]
    a, b = frames(spark, docs, items)
    got = sorted([(r["doc_id"], r["item_id"], r["n_hits"], r["n_item"]) for r in decontam.leaks(a, b).collect()], key=str)
    want = brute(docs, items)
    assert got == want and len(want) > 40
    bad = {d for d, *_ in want}
    assert sorted([r["doc_id"] for r in decontam.without_leaks(a, b).collect()], key=str) == sorted([d for d, _ in docs if d not in bad], key=str)


def test_empty_tables(spark):
    a, b = frames(spark, [], [(1, "a b c d e f")])
    assert decontam.leaks(a, b).collect() == []
    a, b = frames(spark, [(1, "a b c d e f")], [])
    assert decontam.leaks(a, b).collect() == [] and decontam.without_leaks(a, b).count() == 1


def test_search_length():
    assert decontam.extra_bits(40) == 0 and decontam.extra_bits(9) == 1 and decontam.extra_bits(1) is None
