"""Grouped algorithms of the assembly: unitigs, simple paths, matching, read clustering, chimeras, label alignment.

Each works on one bounded group (a cluster's graph, a window's reads, a read) inside a grouped pandas function.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import kmer_entropy


def unitigs(edges: pd.DataFrame) -> list[list[tuple[int, bool]]]:
    """Maximal unbranched walks of a bidirected graph, each once, as (node, forward). edges: a, a_tail, b, b_tail."""
    out: dict[tuple[int, bool], set[tuple[int, bool]]] = defaultdict(set)
    nodes = set()
    for a, at, b, bt in edges[["a", "a_tail", "b", "b_tail"]].itertuples(index=False):
        out[int(a), bool(at)].add((int(b), bool(bt)))
        out[int(b), bool(bt)].add((int(a), bool(at)))
        nodes |= {int(a), int(b)}
    only = lambda end: next(iter(out[end])) if len(out[end]) == 1 else None

    def next_of(node: int, forward: bool) -> tuple[int, bool] | None:
        """The node that alone follows, if it is alone followed by this one."""
        there = only((node, forward))
        if there is None or only(there) != (node, forward) or there[0] == node:
            return None
        return there[0], not there[1]

    seen: set[int] = set()
    walks = []
    for n in sorted(nodes):
        if n in seen:
            continue
        walk = [(n, True)]
        seen.add(n)
        for forward in (True, False):
            step = next_of(n, forward)
            while step and step[0] not in seen:
                seen.add(step[0])
                walk = [*walk, step] if forward else [(step[0], not step[1]), *walk]
                step = next_of(*step)
        walks.append(walk)
    return walks


def unitigs_by_cluster(edges: DataFrame) -> DataFrame:
    """(cluster, unitig, pos, node, forward) for edges (cluster, a, a_tail, b, b_tail)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf["cluster"].iloc[0]
        return pd.DataFrame([(c, i, k, n, f) for i, w in enumerate(unitigs(pdf)) for k, (n, f) in enumerate(w)], columns=["cluster", "unitig", "pos", "node", "forward"])

    return edges.groupBy("cluster").applyInPandas(run, "cluster long, unitig int, pos int, node long, forward boolean")


def simple_path(edges: pd.DataFrame) -> list[int]:
    """From the end of the most frequent edge, always the most frequent step to a node not yet met (smallest id of equals)."""
    step: dict[tuple[int, bool], list[tuple[int, int, bool]]] = defaultdict(list)
    for a, at, b, bt, n in edges[["a", "a_tail", "b", "b_tail", "occ"]].itertuples(index=False):
        step[int(a), bool(at)].append((-int(n), int(b), bool(bt)))
    if not step:
        return []
    node, tail = min(step, key=lambda k: (min(step[k])[0], k))
    path, seen = [node], {node}
    while options := [s for s in sorted(step[node, tail]) if s[1] not in seen]:
        _, node, entered = options[0]
        path.append(node)
        seen.add(node)
        tail = not entered
    return path


def simple_paths(edges: DataFrame) -> DataFrame:
    """(cluster, pos, node)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["cluster"].iloc[0], k, n) for k, n in enumerate(simple_path(pdf))], columns=["cluster", "pos", "node"])

    return edges.groupBy("cluster").applyInPandas(run, "cluster long, pos int, node long")


def matching(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a matching of greatest total weight among the largest ones (entries over 0 are edges), by shortest augmenting paths."""
    n, m = weights.shape
    left, right = [-1] * n, [-1] * m
    while True:
        far, via = {i: 0.0 for i in range(n) if left[i] < 0}, {}
        dist: dict[tuple[str, int], float] = {("l", i): d for i, d in far.items()}
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if ("l", i) not in dist:
                    continue
                for j in range(m):
                    if weights[i, j] > 0 and left[i] != j and dist["l", i] - weights[i, j] < dist.get(("r", j), np.inf) - 1e-12:
                        dist["r", j], via["r", j], changed = dist["l", i] - weights[i, j], i, True
            for j in range(m):
                i = right[j]
                if i >= 0 and ("r", j) in dist and dist["r", j] + weights[i, j] < dist.get(("l", i), np.inf) - 1e-12:
                    dist["l", i], via["l", i], changed = dist["r", j] + weights[i, j], j, True
        free = [(d, j) for (s, j), d in dist.items() if s == "r" and right[j] < 0]
        if not free:
            return [(i, j) for i, j in enumerate(left) if j >= 0]
        j = min(free)[1]
        while True:
            i = via["r", j]
            left[i], old = j, left[i]
            right[j] = i
            if old < 0:
                break
            j = old


def gibbs(counts: np.ndarray, k: int, *, forbidden: dict[int, set[int]] | None = None, rounds: int = 60, restarts: int = 4, seed: int = 1) -> np.ndarray:
    """Cluster of each read by a Gibbs sampler over a product of categorical positions.

    counts: (reads, positions) of base codes, -1 for none. Reads keep out of their forbidden clusters. Up to one cluster or
    two reads everything is cluster 0. This is a model of our own for reads of one window: positions are independent within
    a cluster, with a smoothing of one half.
    """
    n, p = counts.shape
    if k <= 1 or n <= 2:
        return np.zeros(n, np.int64)
    base = np.zeros((n, p, 4))
    i, j = np.nonzero(counts >= 0)
    base[i, j, counts[i, j]] = 1
    flat = base.reshape(n, p * 4)
    best, best_score = np.zeros(n, np.int64), -np.inf
    may = np.ones((n, k), bool)
    for r, out in (forbidden or {}).items():
        may[r, [c for c in out if c < k]] = False
    for t in range(restarts):
        rng = np.random.default_rng([seed, t])
        z = np.array([rng.choice(np.flatnonzero(m)) if m.any() else 0 for m in may])
        total = np.stack([flat[z == c].sum(0) for c in range(k)])
        size = np.bincount(z, minlength=k).astype(float)
        for step in range(rounds):
            beta = min(1.0, 0.1 * 1.12**step)
            moved = 0
            for r in rng.permutation(n):
                total[z[r]] -= flat[r]
                size[z[r]] -= 1
                q = total.reshape(k, p, 4) + 0.5
                lk = (np.log(q / q.sum(2, keepdims=True)).reshape(k, -1) @ flat[r]) + np.log(size + 1.0)
                w = np.where(may[r], beta * 3 * (lk - lk.max()), -np.inf)
                w = np.exp(w - w.max()) if may[r].any() else np.eye(k)[0]
                c = int(rng.choice(k, p=w / w.sum())) if beta < 1 else int(w.argmax())
                moved += c != z[r]
                z[r] = c
                total[c] += flat[r]
                size[c] += 1
            if beta == 1.0 and not moved:
                break
        q = total.reshape(k, p, 4) + 0.5
        score = float((np.log(q / q.sum(2, keepdims=True)).reshape(k, -1) * total).sum())
        if score > best_score:
            best, best_score = z.copy(), score
    return best


def gibbs_by_window(rows: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(win, read_id, cluster) for rows (win, read_id, pos, base); one window's reads are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        reads, pos = np.unique(pdf["read_id"]), np.unique(pdf["pos"])
        table = np.full((len(reads), len(pos)), -1)
        table[np.searchsorted(reads, pdf["read_id"]), np.searchsorted(pos, pdf["pos"])] = pdf["base"].map({"A": 0, "C": 1, "G": 2, "T": 3}).fillna(-1)
        return pd.DataFrame({"win": pdf["win"].iloc[0], "read_id": reads, "cluster": gibbs(table, k, seed=seed)})

    return rows.groupBy("win").applyInPandas(run, "win long, read_id long, cluster long")


def _label_table(a: list[tuple], b: list[tuple]) -> np.ndarray:
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = max(d[i - 1, j - 1] + _label_match(x, y), d[i - 1, j] - 1, d[i, j - 1] - 1)
    return d


def _label_match(x: tuple, y: tuple) -> int:
    return 1 if x == y else -1 if x[0] == y[0] else -100


def label_score(a: list[tuple], b: list[tuple]) -> int:
    """Semi-global alignment of two reads' units: 1 for equal (window, cluster), -1 for other clusters or gaps, -100 for other windows."""
    d = _label_table(a, b)
    return int(max(d[-1].max(), d[:, -1].max()))


def label_pairs(a: list[tuple], b: list[tuple], least: int) -> list[tuple[int, int]]:
    """Places of a and b that this alignment sets beside each other; none if its score is ``least`` or less."""
    d = _label_table(a, b)
    ends = [(int(d[i, len(b)]), i, len(b)) for i in range(len(a) + 1)] + [(int(d[len(a), j]), len(a), j) for j in range(len(b) + 1)]
    score, i, j = max(ends)
    out = []
    while score > least and i and j:
        if d[i, j] == d[i - 1, j - 1] + _label_match(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif d[i, j] == d[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return out


def corrected_units(units: DataFrame, least: int = 2) -> DataFrame:
    """(read_id, pos, win, cluster): the commonest label that other reads have beside each unit of a read.

    units: (read_id, pos, win, cluster), pos from 0. Reads that share a label are aligned, forwards or else backwards;
    pairs meet on shared labels, each pair is one row, and the votes are counted by Spark. Ties go to the least label.
    """
    reads = units.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "win", "cluster"))).alias("u"))  # one read
    have = units.select("read_id", "win", "cluster").distinct()
    pairs = have.join(have.withColumnRenamed("read_id", "other"), ["win", "cluster"]).select("read_id", "other").distinct()
    both = pairs.join(reads, "read_id").join(reads.select(F.col("read_id").alias("other"), F.col("u").alias("v")), "other").select("read_id", "u", "v")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for read, u, v in zip(f["read_id"], f["u"], f["v"], strict=True):
                own, other = ([(x["win"], x["cluster"]) for x in w] for w in (u, v))
                found = label_pairs(own, other, least)
                if not found:
                    other = other[::-1]
                    found = label_pairs(own, other, least)
                out += [(read, i, *other[j]) for i, j in found]
            yield pd.DataFrame(out, columns=["read_id", "pos", "win", "cluster"])

    votes = both.mapInPandas(run, "read_id long, pos long, win long, cluster long").groupBy("read_id", "pos", "win", "cluster").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("read_id", "pos").agg(F.max(F.struct("n", (-F.col("win")).alias("w"), (-F.col("cluster")).alias("c"))).alias("b"))
    back = lambda c, old: F.coalesce(-F.col(f"b.{c}"), F.col(old)).alias(old)
    return units.join(best, ["read_id", "pos"], "left").select("read_id", "pos", back("w", "win"), back("c", "cluster"))


def local_alignment(x: str, y: str) -> tuple[int, int, int, int, int]:
    """(score, x start, x end, y start, y end) of the best local alignment: match 1, mismatch -1, gap -4 and -1 further.

    A row of the table at a time: gaps along the row come from a running maximum of what they could open at. Of equal
    scores the first row, then the first column counts.
    """
    a, b = np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)
    m = len(b)
    place, low = np.arange(m + 1), np.int64(-(10**9))
    h, e = np.zeros(m + 1, np.int64), np.full(m + 1, low)
    begun, e_begun = place.copy(), place.copy()  # where the alignment of a cell begins, as row * (m + 1) + column
    best = (0, 0, 0, 0, 0)
    for i in range(1, len(a) + 1):
        here = i * (m + 1) + place
        opened = h - 4 >= e - 1
        e, e_begun = np.where(opened, h - 4, e - 1), np.where(opened, begun, e_begun)
        top, from_ = np.zeros(m + 1, np.int64), here.copy()
        diagonal = h[:-1] + np.where(b == a[i - 1], 1, -1)
        better = diagonal > 0
        top[1:][better], from_[1:][better] = diagonal[better], begun[:-1][better]
        better = e > top
        top, from_ = np.where(better, e, top), np.where(better, e_begun, from_)
        open_at = top + place
        reach = np.maximum.accumulate(open_at)
        source = np.maximum.accumulate(np.where(open_at == reach, place, 0))
        along = np.full(m + 1, low)
        along[1:] = reach[:-1] - place[1:] - 3
        better = along > top
        better[0] = False
        h, begun = np.where(better, along, top), from_.copy()
        at = np.flatnonzero(better)
        begun[at] = from_[source[at - 1]]
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), int(begun[j]) // (m + 1), i, int(begun[j]) % (m + 1), j)
    return best


def kept_part(score: int, x: tuple[int, int], y: tuple[int, int], n: int, least: int = 80, near: int = 100) -> tuple[int, int] | None:
    """The part of a read that stays if x and y (on the read) are a stretch and its reverse complement; None for all of it.

    If the two lie at one place the read turns back in its middle, and the longer side of the middle stays. If they are
    apart, what lies beyond the later one or before the earlier one does. Others overlap by chance.
    """
    if score < least:
        return None
    if abs(x[0] - y[0]) < near and x[1] - y[1] < near:
        start, end = (x[0] + y[0]) // 2, (x[1] + y[1]) // 2
        return ((start + end) // 2, n) if start < n - end else (0, (start + end) // 2)
    late, early = max(x[0], y[0]), min(x[1], y[1])
    if early < late:
        return (late, n) if min(x[0], y[0]) < n - max(x[1], y[0]) else (0, early)
    return None


def unchimeric(seq: str, least: int = 80) -> tuple[int, int]:
    """The part of a read that stays."""
    n = len(seq)
    turned = seq.upper().translate(str.maketrans("ACGT", "TGCA"))[::-1]
    score, xs, xe, ys, ye = local_alignment(seq.upper(), turned)
    return kept_part(score, (xs, xe), (n - ye, n - ys), n, least) or (0, n)


def clipped(reads: DataFrame, least: int = 80, seq: str = "seq") -> DataFrame:
    """``reads`` with start and end of the part that stays, and ``seq`` cut to it. Reads are aligned with themselves turned round."""

    @F.pandas_udf("struct<start: long, end: long>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unchimeric(x, least) for x in s], columns=["start", "end"])

    part = reads.withColumn("__part", run.asNondeterministic()(F.col(seq)))
    part = part.withColumns({"start": F.col("__part.start"), "end": F.col("__part.end")})
    return part.withColumn(seq, F.expr(f"substring({seq}, cast(start + 1 as int), cast(end - start as int))")).drop("__part")


def quality_reads(reads: DataFrame, mapped: DataFrame, entropy: float = 7.0, least_length: int = 1000, score: int = 80) -> DataFrame:
    """Reads (read_id, seq) that have an alignment, are long and varied, with self-chimeric ends cut off."""
    picked = reads.join(mapped.select("read_id").distinct(), "read_id", "left_semi").filter(F.length("seq") > least_length)
    varied = picked.withColumn("__h", kmer_entropy(F.col("seq"))).filter(F.col("__h") > entropy).drop("__h")
    return clipped(varied, score)


def matched_clusters(graph: DataFrame) -> DataFrame:
    """(win, a, b): of each window's cluster graph (win, a, b, weight) the matching of greatest weight. A window has a handful of clusters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.unique(pdf["a"]), np.unique(pdf["b"])
        w = np.zeros((len(a), len(b)))
        w[np.searchsorted(a, pdf["a"]), np.searchsorted(b, pdf["b"])] = pdf["weight"]
        return pd.DataFrame([(pdf["win"].iloc[0], a[i], b[j]) for i, j in matching(w)], columns=["win", "a", "b"])

    return graph.groupBy("win").applyInPandas(run, "win long, a long, b long")


def position_weights(likelihoods: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of positions that tell clusters apart, for likelihoods (reads, positions, clusters) and each read's cluster.

    Over all pairs of clusters the matrices of covariance of (centred) likelihood gaps, signed by the label, are added;
    the first eigenvector's absolute entries are the weights, scaled so that the greatest is 2.
    """
    k, total = likelihoods.shape[2], np.zeros((likelihoods.shape[1],) * 2)
    for i in range(k):
        for j in range(i):
            use = (labels == i) | (labels == j)
            gap = likelihoods[use, :, i] - likelihoods[use, :, j]
            gap = (gap - gap.mean(0)) * np.where(labels[use] == i, 1.0, -1.0)[:, None]
            total += np.outer(gap.sum(0), gap.sum(0))
    w = np.abs(np.linalg.eigh(total)[1][:, -1])
    return 2 * w / w.max() if w.max() > 0 else w


def masked(seq: Column, start: Column, end: Column) -> Column:
    """Upper case within [start, end), lower case elsewhere."""
    return F.concat(F.lower(F.substring(seq, F.lit(1), start)), F.upper(F.substring(seq, start + 1, end - start)), F.lower(F.substring(seq, end + 1, F.length(seq))))


def rotated(seq: Column, at: int = 10_000) -> Column:
    """A circular sequence from another base on."""
    return F.concat(F.substring(seq, at + 1, 2**31 - 1), F.substring(seq, 1, at))
