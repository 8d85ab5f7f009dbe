import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from helixframe.llm import packing
from helixframe.llm.registry import op8_packing, vocabulary


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [[*x.ids, 0] for x in t.encode_batch([t or "" for t in texts], add_special_tokens=False)]


TEXTS = [None, "", "a", "don't stop  now\n\n  x", "naïve Éeau ñ 123 4567!!  ", "<|endoftext|> is text", "日本語 のテキスト 😀", "x" * 5000, "the cat sat " * 900, " \t\n", *[f"the {k} cat sat on mat number {k * k} of the {'very ' * (k * 7)}long hall" for k in range(60)]]


def test_encoder_equals_the_library():
    enc = packing.Encoder(packing.read_vocabulary(vocabulary()))
    assert [[*enc.ids(t).tolist(), 0] for t in TEXTS] == reference_ids(TEXTS)


def test_other_files_are_encoded_by_the_library():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    enc, library = packing.Encoder(packing.read_vocabulary(text), special=True), Tokenizer.from_str(text)
    assert [enc.ids(t).tolist() for t in TEXTS[:6]] == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS[:6]]


def brute_fill(items, least, idf, mean, window):
    """Seeds by their nearest neighbour; each takes its best unused ones, if these fill the window."""

    def share(q, d):
        score = lambda x: sum(idf[t] * (f := (x == t).sum()) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in sorted(set(q.tolist())) if (x == t).any())
        return score(d) / score(q)

    table = np.array([[-np.inf if i == j else share(q, d) for j, (d, _) in enumerate(items)] for i, (q, _) in enumerate(items)])
    left, first, out = [n for _, n in items], [0] * len(items), []
    for s in sorted(range(len(items)), key=lambda i: -table[i].max()):
        if not left[s]:
            continue
        near = [j for j in sorted(range(len(items)), key=lambda j: -table[s][j]) if left[j] and table[s][j] >= least]
        room, taken = window - left[s], []
        while room > 0 and near:
            taken.append(near.pop(0))
            room -= left[taken[-1]]
        if room > 0:
            continue
        name, offset = s * 1000 + first[s], 0
        for j in [s, *taken]:
            n = min(left[j], window - offset)
            out.append((name, j * 1000 + first[j], n, offset))
            offset, left[j], first[j] = offset + n, left[j] - n, first[j] + n
    return out


def test_windows_of_a_shard_equal_brute_force():
    rng = np.random.default_rng(8)
    for trial in range(6):
        docs = [rng.integers(0, 60, rng.integers(5, 90)).astype(np.int64) for _ in range(40)]
        docs[3], docs[9] = docs[5].copy(), np.append(docs[5], 61)
        n = rng.integers(1, 30, 40)
        df = np.zeros(100)
        for d in docs:
            df[np.unique(d)] += 1
        idf, mean = np.log1p((40 - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])
        pairs = [np.unique(d, return_counts=True) for d in docs]
        shard = packing.Shard(np.arange(40) * 1000, n, np.array([len(d) for d in docs]), [t for t, _ in pairs], [c for _, c in pairs], idf, mean)
        least = (0.0, 0.4, 0.8)[trial % 3]
        got, want = shard.fill(least, 64), brute_fill(list(zip(docs, n.tolist(), strict=True)), least, idf, mean, 64)
        assert got == want and (least or got)


def check(rows, ids_of, window):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == ids_of.keys()
    for d, ps in pieces.items():
        at, ids = 0, np.array(ids_of[d], "<u4")
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == window or (at < window and at & (at - 1) == 0)
    return sequences


def test_every_id_is_in_one_piece_and_nothing_is_padded(spark):
    df = spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, length string, start int")
    ids = dict(enumerate(reference_ids(TEXTS)))
    check(packing.pack(df, vocabulary()).collect(), ids, 1024)
    check(packing.pack(df, vocabulary(), window=64, shard_rows=5).collect(), ids, 64)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).collect() == []


def test_scores_equal_brute_force_and_near_rests_meet():
    rng = np.random.default_rng(3)
    rests = [rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint32) for _ in range(30)]
    rests[7] = np.arange(60, 90, dtype=np.uint32)
    rests[21] = np.arange(62, 92, dtype=np.uint32)
    df = np.zeros(100)
    for r in rests:
        df[np.unique(r)] += 1
    idf, mean = np.log1p((30 - df + 0.5) / (df + 0.5)), np.mean([len(r) for r in rests])
    index = packing.Index(rests, idf, mean)
    for q in rests:
        want = [sum(idf[t] * (tf := (d == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(q.tolist()) if (d == t).any()) for d in rests]
        assert np.allclose(index.scores(q), want)
    assert index.scores(rests[7]).argsort()[-2:].tolist() in ([21, 7], [7, 21])


def test_neighbours_come_from_all_shards(spark):
    rng = np.random.default_rng(5)
    words = [[f"{a}{b}" for b in ("stone", "river", "cloud", "field", "horse", "lamp")] for a in ("ash", "oak", "elm", "fir", "yew", "bay", "fig", "nut", "rye", "hop", "pea", "tea", "ivy", "hay", "rue", "gum", "box", "sap", "bur", "cob")]
    texts = [" ".join(rng.choice(w, 20)) for w in words for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sequences = defaultdict(set)
    for r in packing.pack(df, vocabulary(), window=128, shard_rows=5).collect():
        sequences[r["sequence_id"]].add(r["doc_id"])
    met = sum(any({2 * k, 2 * k + 1} <= s for s in sequences.values()) for k in range(20))
    assert met >= 15


def test_a_rest_is_found_by_its_whole_document(spark, monkeypatch):
    many = lambda w, n: " ".join([w] * n)
    texts = [many("river", 64), many("stone", 20), many("river", 30), many("stone", 63)]  # of the first, the end id is left; of the last, nothing
    ids, seen, packed = reference_ids(texts), [], packing._packed
    assert [len(x) % 64 for x in ids] == [1, 21, 31, 0]
    monkeypatch.setattr(packing, "_packed", lambda rests, index, *rest: seen.append(index.value) or packed(rests, index, *rest))
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), vocabulary(), window=64).collect()
    first = next(r for r in rows if r["doc_id"] == 0 and r["start"] == 64)
    assert next(r["doc_id"] for r in rows if r["sequence_id"] == first["sequence_id"] and r["offset"] == 1) == 2
    idf, mean = seen[0]
    assert mean == np.mean([len(x) for x in ids])
    assert all(np.isclose(idf[t], np.log1p((4 - n + 0.5) / (n + 0.5))) for t, n in ((0, 4), (7815, 2), (7850, 2), (1, 0)))


def test_keys_weigh_terms_by_all_documents(spark, monkeypatch):
    """More documents than the 2,048 whose sample weighed the terms before."""
    rng, seen, packed = np.random.default_rng(4), [], packing._packed
    texts = [" ".join(rng.choice(["sea", "sun", "moon", "star", "wind", "rain"], 5)) + (" granite" if k % 7 == 0 else "") for k in range(2600)]
    monkeypatch.setattr(packing, "_packed", lambda rests, index, *rest: seen.append((rests, index)) or packed(rests, index, *rest))
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary(), window=64, shard_rows=500).collect()
    ids = reference_ids(texts)
    check(rows, dict(enumerate(ids)), 64)
    rests, index = seen[0]
    have = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=len(index.value[0]))
    assert np.allclose(index.value[0], np.log1p((2600 - have + 0.5) / (have + 0.5)))
    for key in range(packing.KEYS):
        order = packing.orders(np.log1p((2600 - have + 0.5) / (have + 0.5)), key)
        got = rests.select("doc_id", "terms").mapInArrow(packing._keyed(index, key), "doc_id long, terms binary, key long").collect()
        assert len(got) == sum(len(x) % 64 > 0 for x in ids)
        for r in got:
            want = 0
            for o in order:
                want = want << 16 | min(set(ids[r["doc_id"]]), key=lambda t: o[t])
            assert r["key"] == np.array([want & 2**64 - 1], np.uint64).astype(np.int64)[0]


def test_added_tokens_are_special_in_the_query(spark, tmp_path):
    texts = [*TEXTS, "a <|endoftext|> is", "<|endoftext|><|endoftext|>x  <|endof", "e\n<|endoftext|>\n\nf"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    enc = packing.Encoder(packing.read_vocabulary(vocabulary()), special=True)
    assert [enc.ids(t).tolist() for t in texts] == want and want[len(TEXTS)] == [64, 220, 50256, 318]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check(op8_packing(spark, str(tmp_path)).collect(), {i: [*x, 0] for i, x in enumerate(want)}, 1024)
