import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from helixframe.llm import pii
from helixframe.llm.registry import PII_KEY


def shingles(t, n=5):
    w = t.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_stages_and_their_effects(spark, tmp_path):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(2000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(30) for _ in range(4)]
    docs, labels = [], []
    for i in range(220):
        t = text(rng.randrange(20, 200))
        toxic = i % 9 == 0
        if toxic:
            t[3:3] = ["idiot", "scum"]
        labels.append((i, 1, int(toxic)))
        docs.append((i, t))
    for i in range(220, 240):  # near copies of clean documents
        base = list(docs[i - 219][1] if (i - 219) % 9 else docs[i - 218][1])
        base[0] = "changed"
        docs.append((i, base))
    for i in range(240, 250):
        t = text(60)
        t[20:20] = items[i % 4]
        docs.append((i, t))
    docs.append((250, [*text(40), "bo.42@mail8.example.com", "4041894974608795", *text(40)]))
    rows = [(i, " ".join(t), "en", "src", len(" ".join(t))) for i, t in docs] + [(300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == columns, name
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"]: r["text"] for r in frame.collect()})
    toxic = {i for i, _, t in labels if t}
    assert {i for i, *_ in rows} - set(kept[0]) == toxic
    # of linked documents the least id stays
    sets = {i: shingles(t or "") for i, t in kept[0].items()}
    label = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert set(kept[1]) == {i for i in sets if label[i] == i} and len(kept[1]) < len(kept[0])
    leaks = {i for i, t in kept[1].items() for x in items if t and 10 * len(shingles(t) & shingles(" ".join(x))) >= 8 * len(shingles(" ".join(x)))}
    assert set(kept[1]) - set(kept[2]) == leaks and len(leaks) == 10
    assert set(kept[3]) == set(kept[2]) and "bo.42@" not in kept[3][250] and "4041894974608795" not in kept[3][250]
    assert {i for i in kept[2] if kept[2][i] != kept[3][i]} == {250}
    back = pii.reveal(spark.createDataFrame([(kept[3][250],)], "text string"), PII_KEY).collect()[0][0]
    assert back == kept[2][250]

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = defaultdict(int)
    for r in out:
        total[r["doc_id"]] += r["length"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in kept[3].items()}
    assert dict(total) == want
    assert np.array([r["length"] for r in out]).max() <= 1024
