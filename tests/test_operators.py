import numpy as np
import pandas as pd

from helixframe.operators import assembly as A
from helixframe.operators import coverage as C
from helixframe.operators import graphs as G
from helixframe.operators import intervals as I


def test_components(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (4, 2), (1, 4), (7, 8)] + [(k, k + 1) for k in range(100, 160)], "a long, b long")
    got = {r["node"]: r["component"] for r in G.components(e).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 4: 0, 7: 7, 8: 7} | {k: 100 for k in range(100, 161)}


def windows_by_hand(cov, compat=False):
    thr, out, start = sum(cov) // len(cov) // 4, [], 0
    while start < len(cov):
        end = start
        while end < len(cov) and cov[end] > thr:
            end += 1
        if end - start > 6:
            n = (end - start) // 20
            out += [(start, end)] if n == 0 else [(start + i * 20, start + i * 20 + 20 if i < (start + (n - 1) * 20 if compat else n - 1) else end) for i in range(n + 1)]
        start = end + 1
    return sorted((max(s, 1), e) for s, e in out)


def test_windows(spark):
    for cov in ([10] * 5000, [10 if 100 < i < 500 else 100 for i in range(4000)], [9] * 45 + [0] + [9] * 7 + [0] + [9] * 6 + [0] * 40):
        df = spark.createDataFrame([(0, i, c) for i, c in enumerate(cov)], "contig long, unit long, cov long")
        for compat in (False, True):
            assert sorted((r["start"], r["end"]) for r in C.windows(df, compat=compat).collect()) == windows_by_hand(cov, compat)


def test_first_interval_and_compat(spark):
    points = spark.createDataFrame([(0, 5), (0, 2500), (0, 40)], "contig long, at long")
    genes = spark.createDataFrame([(0, 0, 3000, "b", 2), (0, 4, 10, "a", 1), (0, 30, 35, "c", 3)], "contig long, start long, end long, gene string, ord long")
    got = {r["at"]: r["found"] for r in I.in_first_interval(points, genes, ["contig"], "at", "gene", "ord").collect()}
    assert got == {5: "a", 2500: "b", 40: "b"}
    old = {r["at"]: r["found"] for r in I.in_first_interval(points, genes, ["contig"], "at", "gene", "ord", compat=True).collect()}
    assert old == {5: None, 2500: "a", 40: "a"}


def test_unitigs_and_paths(spark):
    chain = [(0, 1, 9), (1, 2, 8), (2, 3, 7), (2, 4, 3), (4, 5, 2)]
    rows = [(0, a, True, b, False, n) for a, b, n in chain] + [(0, b, False, a, True, n) for a, b, n in chain]
    df = spark.createDataFrame(rows, "cluster long, a long, a_tail boolean, b long, b_tail boolean, occ long")
    walks = {}
    for r in A.unitigs_by_cluster(df).orderBy("unitig", "pos").collect():
        walks.setdefault(r["unitig"], []).append(r["node"])
    assert sorted(walks.values()) == [[0, 1, 2], [3], [4, 5]]
    assert [r["node"] for r in A.simple_paths(df).orderBy("pos").collect()] == [0, 1, 2, 3]


def test_matching_is_the_best_of_the_largest():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(30):
        w = rng.integers(0, 9, (4, 5)).astype(float)
        best = max((sum(w[i, p[i]] > 0 for i in range(4)), sum(w[i, p[i]] for i in range(4))) for p in permutations(range(5), 4))
        got = A.matching(w)
        assert (len(got), sum(w[i, j] for i, j in got)) == best and len({j for _, j in got}) == len(got)


def test_gibbs_finds_planted_clusters(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 4, 30)
    other = base.copy()
    other[::5] = (other[::5] + 1) % 4
    truth = np.arange(40) % 2
    reads = np.where(truth[:, None] == 0, base, other)
    noise = rng.random(reads.shape) < 0.05
    reads = np.where(noise, rng.integers(0, 4, reads.shape), reads)
    z = A.gibbs(reads, 2)
    assert max((z == truth).mean(), (z != truth).mean()) > 0.95
    assert A.gibbs(reads[:2], 2).tolist() == [0, 0] and A.gibbs(reads, 1).sum() == 0
    kept = A.gibbs(reads, 2, forbidden={0: {0}})
    assert kept[0] == 1
    rows = spark.createDataFrame(pd.DataFrame([(1, r, p, "ACGT"[reads[r, p]]) for r in range(40) for p in range(30)], columns=["win", "read_id", "pos", "base"]))
    assert A.gibbs_by_window(rows, 2).count() == 40


def test_alignments():
    a = [(0, 1), (1, 0), (2, 1)]
    assert A.label_score(a, a) == 3 and A.label_score(a, [(0, 0), (1, 0), (2, 1)]) == 1 and A.label_score(a, [(7, 1)]) <= 0
    rng = np.random.default_rng(2)
    s = "".join(rng.choice(list("ACGT"), 120))
    turned = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    n = len(s) * 2
    start, end = A.unchimeric(s + turned, 30)
    assert (start, end) in ((len(s), n), (0, len(s)))
    assert A.unchimeric(s[:60], 30) == (0, 60)


def slow_local_alignment(x, y):
    """The recurrence, cell by cell: the score alone."""
    low = -(10**9)
    h, e, best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)], [[low] * (len(y) + 1) for _ in range(len(x) + 1)], 0
    for i in range(1, len(x) + 1):
        f = low
        for j in range(1, len(y) + 1):
            e[i][j] = max(h[i - 1][j] - 4, e[i - 1][j] - 1)
            f = max(h[i][j - 1] - 4, f - 1)
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x[i - 1] == y[j - 1] else -1), e[i][j], f)
            best = max(best, h[i][j])
    return best


def score_of(x, y):
    """Best score of an alignment of all of x and all of y."""
    low = -(10**9)
    h, e = [[low] * (len(y) + 1) for _ in range(len(x) + 1)], [[low] * (len(y) + 1) for _ in range(len(x) + 1)]
    h[0][0] = 0
    for i in range(len(x) + 1):
        f = low
        for j in range(len(y) + 1):
            if i:
                e[i][j] = max(h[i - 1][j] - 4, e[i - 1][j] - 1)
            if j:
                f = max(h[i][j - 1] - 4, f - 1)
            h[i][j] = max(h[i][j], e[i][j], f, h[i - 1][j - 1] + (1 if x[i - 1] == y[j - 1] else -1) if i and j else low)
    return h[-1][-1]


def test_local_alignment_equals_the_recurrence():
    rng = np.random.default_rng(12)
    for _ in range(40):
        x = "".join(rng.choice(list("ACGT"), rng.integers(1, 40)))
        y = "".join(rng.choice(list("ACGT"), rng.integers(1, 40)))
        if rng.random() < 0.6:
            y = y[:10] + x[3:20] + "A" * rng.integers(0, 4) + x[20:] + y[10:]
        score, xs, xe, ys, ye = A.local_alignment(x, y)
        assert score == slow_local_alignment(x, y) and (score == 0 or score_of(x[xs:xe], y[ys:ye]) == score)


def test_parts_that_stay():
    assert A.kept_part(10, (0, 50), (0, 50), 100) is None
    assert A.kept_part(90, (100, 900), (120, 920), 5000) == (510, 5000) and A.kept_part(90, (4100, 4900), (4120, 4920), 5000) == (0, 4510)
    assert A.kept_part(90, (0, 300), (2000, 2300), 9000) == (2000, 9000) and A.kept_part(90, (5000, 5300), (8000, 8300), 9000) == (0, 5300)
    assert A.kept_part(90, (0, 1000), (500, 1500), 9000) is None


def test_correction_restores_planted_labels(spark):
    rng = np.random.default_rng(3)
    rows = []
    for read in range(24):
        path = [(w, read % 2 if w > 2 else 0) for w in range(8)]
        if read % 3 == 0:
            path = path[::-1]
        rows += [(read, i, w, 5 if rng.random() < 0.1 else c) for i, (w, c) in enumerate(path)]
    got = A.corrected_units(spark.createDataFrame(rows, "read_id long, pos long, win long, cluster long")).collect()
    true = lambda read, win: read % 2 if win > 2 else 0
    wrong = sum(r["cluster"] != true(r["read_id"], r["win"]) for r in got)
    before = sum(c != true(read, w) for read, _, w, c in rows)
    # a read of which nearly half is wrong is like no other and stays
    assert len(got) == len(rows) and before > 12 and wrong <= 4


def test_position_weights_find_the_telling_place():
    rng = np.random.default_rng(6)
    labels = np.repeat([0, 1], 30)
    lk = rng.normal(size=(60, 7, 2)) * 0.1
    lk[:, 4, 0] += np.where(labels == 0, 1.5, -1.5)
    w = A.position_weights(lk, labels)
    assert w.argmax() == 4 and w.max() == 2 and np.sort(w)[-2] < 0.6


def test_digamma(spark):
    from pyspark.sql import functions as F

    from helixframe.functions import numbers as N

    got = [r[0] for r in spark.createDataFrame([(1.0,), (0.5,), (20.0,), (-0.5,), (-2.0,)], "x double").select(N.digamma(F.col("x"))).collect()]
    euler = 0.5772156649015329
    harmonic = sum(1 / k for k in range(1, 20))
    assert np.allclose(got[:4], [-euler, -euler - 2 * np.log(2), harmonic - euler, -euler - 2 * np.log(2) + 2]) and got[4] == -np.inf


def test_every_query_has_an_oracle():
    from helixframe.plans import registry

    from helixframe.plans import native

    assert set(registry.queries()) - set(native.QUERIES) == set(registry.oracle_sql())


def test_regions_merge_unless_reads_forbid_it(spark):
    from helixframe.operators import regions as R

    reads = {0: set(range(40)), 1: set(range(20, 60)), 2: set(range(45, 70))}
    assert [c["regions"] for c in R.merge_clusters(reads, {}, set(), least=10)] == [{0, 1, 2}]
    barred = {1: set(range(0, 39))}
    assert [c["regions"] for c in R.merge_clusters(reads, barred, set(), least=10)] == [{0}, {1, 2}]
    assert [c["regions"] for c in R.merge_clusters(reads, barred, {0, 1, 2}, least=10)] == [{0, 1, 2}]
    units = spark.createDataFrame([(r, k, 0, k) for r in range(30) for k in range(r, r + 40)], "read_id long, pos long, contig long, unit long")
    regions = spark.createDataFrame([(0, 0, 30, 34, False)], "region int, contig long, start long, end long, confluent boolean")
    assert {r["read_id"] for r in R.spanning_reads(units, regions).collect()} == {r for r in range(30) if r < 26 and r + 40 > 38}
    assert R.initial_clusters(units, regions).count() == 30


def test_confluent_regions(spark):
    from helixframe.operators import regions as R

    rows = [(r, k, 0, 30 + r % 2 + k) for r in range(120) for k in range(12)] + [(300 + r, k, 0, k) for r in range(40) for k in range(60)]
    rows += [(400 + r, k, 0, (r * 7) % 90 + k) for r in range(80) for k in range(11)]
    df = spark.createDataFrame(rows, "read_id long, pos long, contig long, unit long")
    got = [(r["start"], r["end"], r["down"]) for r in R.confluent_regions(df, least=15, sigmas=1.0).collect()]
    assert (30, 32, True) in got and all(not (down and end < 5) for _, end, down in got)
