import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import langid, toxicity
from helixframe.llm.common import id_remainder


def corpus(spark, n=500, seed=1):
    """Toxic iff an insult meets a mention of a group; both are common alone."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 40))] + ["Insult!"] * insult + ["group,"] * group
        rng.shuffle(words)
        docs.append((i, " ".join(words), -1.0))
        labels.append((i, 1, int(insult and group), "x"))
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_pairs_of_terms_are_learned(spark):
    docs, labels = corpus(spark)
    m = toxicity.fit(docs, labels, id_remainder("doc_id", 5) != 0)
    got = toxicity.score(docs, m).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


def test_scores_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    terms = np.sort(rng.integers(1, 2**62, 9).astype(np.uint64))
    m = toxicity.Machine(terms, 0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    row, at = np.array([0, 0, 0, 2]), np.array([1, 4, 8, 5])
    z, _ = toxicity._logit(m, row, at, 3)
    pairs = sum(m.factor[a] @ m.factor[b] for a, b in ((1, 4), (1, 8), (4, 8)))
    assert np.allclose(z, [0.3 + m.weight[[1, 4, 8]].sum() + pairs, 0.3, 0.3 + m.weight[5]])


def test_toxicity_edges(spark):
    docs, labels = corpus(spark, 60)
    odd = spark.createDataFrame([(None, None, 0.0), (1, "", 0.0), (1, "x " * 100_000, 0.0), (1, "x " * 100_000, 0.0)], "doc_id long, text string, score double")
    m = toxicity.fit(docs.union(odd), labels.union(labels), id_remainder("doc_id", 5) != 0)
    assert toxicity.score(odd, m).count() == 4
    none = toxicity.fit(docs, labels.filter("false"), F.lit(True))
    assert all(r["score"] < 1e-9 and r["predicted"] == 0 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.filter("false"), none).collect() == []


def test_grams_and_distances():
    letters = langid.letter_table()
    code, n = langid.text_grams("ab, ab", letters)
    name = {("a",): 2, ("b",): 2, ("_", "a"): 2, ("a", "b"): 2, ("b", "_"): 2, ("_", "a", "b"): 2, ("a", "b", "_"): 2}
    want = {}
    for g, k in name.items():
        c = 0
        for x in g:
            c = (c << 21) | ord(x)
        want[c] = k
    assert dict(zip(code.tolist(), n.tolist())) == want
    profiles = {"x": [ord("a"), ord("b")], "y": [ord("b"), ord("c")]}
    r = langid.Ranker(profiles)
    lang, score = r.guess("aab")
    own = langid.ranked(*langid.text_grams("aab", letters), langid.DOC_GRAMS).tolist()
    far = {k: sum(abs(p.index(g) - i) if g in p else 2 for i, g in enumerate(own)) for k, p in profiles.items()}
    assert lang == min(sorted(far), key=far.get) and np.isclose(score, 1 - far[lang] / (max(2, len(own)) * len(own)))


def test_languages(spark):
    rng = random.Random(3)
    words = {"en": ["the", "and", "with", "thing", "house", "was"], "fr": ["le", "été", "avec", "chose", "maison", "une"], "de": ["der", "und", "mit", "straße", "häuser", "war"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(4, 60))), lang, 1.0) for i, lang in enumerate(rng.choice(list(words)) for _ in range(300))]
    rows += [(900, None, "en", 1.0), (901, "123 !!", "fr", 1.0), (902, "", None, 1.0), (None, "une maison avec une chose", None, 1.0), (903, "the house " * 40_000, "en", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.identify(df, langid.learn_profiles(df, id_remainder("doc_id", 4) != 2)).collect()}
    held = [r for i, r in got.items() if i is not None and i < 300 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[None]["lang_pred"] == "fr" and got[903]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.identify(df, langid.learn_profiles(df, F.lit(False))).collect()} == {"und"}
    assert langid.identify(df.filter("false"), {"x": [97]}).collect() == []


def test_pairs_that_no_linear_model_can_tell(spark):
    """Neither term of a pair says anything alone: one toxic pair (either, not both), and a pair toxic only together."""
    rng = np.random.default_rng(4)
    for rule in ("xor", "same"):
        rows, labels = [], []
        for i in range(3000):
            a, b = rng.random(2) < 0.5
            words = [f"w{k}" for k in rng.integers(0, 300, 25)] + ["red"] * bool(a) + ["blue"] * bool(b)
            rows.append((i, " ".join(rng.permutation(words))))
            labels.append((i, int((a != b) if rule == "xor" else (a == b))))
        docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
        machine = toxicity.fit(docs, marks, F.col("doc_id") % 5 != 0)
        found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, machine).collect()}
        held = [(found[i], y) for i, y in labels if i % 5 == 0]
        assert np.mean([p == y for p, y in held]) >= 0.95


def test_profiles_equal_counting_by_hand(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(langid, "PARTS", 3)
    rng, letters = random.Random(8), langid.letter_table()
    rows = [(i, " ".join("".join(rng.choice(abc) for _ in range(rng.randrange(1, 6))) for _ in range(9)), lang) for lang, abc in (("aa", "abcd"), ("bb", "bcxé")) for i in range(0 if lang == "aa" else 100, 60 if lang == "aa" else 160)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    got = langid.learn_profiles(df, F.col("doc_id") % 7 != 0, train_docs=11, profile=25)
    hashes = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(3))).collect()}
    for lang in ("aa", "bb"):
        use = sorted((hashes[i], i, t) for i, t, x in rows if x == lang and i % 7)[:11]
        n = Counter()
        for _, _, t in use:
            n.update(dict(zip(*(x.tolist() for x in langid.text_grams(t, letters)))))
        assert got[lang] == [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:25]]
