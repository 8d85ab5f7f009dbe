"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct lower-cased runs of letters, hashed to 62 bits. The machine scores
``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)`` over the terms that it has learned, so two terms that are mild alone
can weigh much together (an insult beside a group mention). Terms that it has not met add nothing. A term is learned for
its own sake, if the classes have it at different rates, or for a pair: if having both, or just one, of two terms goes
with the label beyond what each does alone.

Defined results: a null or empty text has no terms and gets the bias' score; a very long text is read whole, in one task;
repeated rows are scored alike; ids that are null or repeated are allowed; of several labels for one id the highest
counts; with no labelled row, or none of label 1, every score is sigmoid(-50), with none of label 0 sigmoid(50); an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.textblocks import WordHasher, frugal, give_back, non_letters, slices, text_bytes

#: Most labelled documents that a model is fitted on; the sample is the ids of least hash.
TRAIN_ROWS = 16_384
#: A term is learned if so many sampled documents have it.
MIN_DOCS = 8
#: ... and if its rates in the two classes differ by so many standard errors: others would only carry noise.
LEAST_Z = 5.0
#: Terms whose pairs are looked at, those of greatest variance; and the least correlation of a pair with the label, in
#: standard errors, for that both its terms are learned. There are half a million pairs, so chance alone reaches 5.
PAIR_TERMS, LEAST_PAIR_Z = 1024, 6.5
FACTORS, EPOCHS, BATCH, RATE, L1, L2 = 4, 30, 256, 0.15, 0.002, 0.0005


@dataclass
class Machine:
    """terms: sorted hashes. weight, factor: by term. The size is bounded by the sample."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def document_terms(column: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) for the distinct terms of each text, rows ascending."""
    raw, off = text_bytes(column)
    starts, ends, row = hasher.spans(raw, off)
    h = hasher.hashes(raw, starts, ends) >> np.uint64(2)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def _hasher() -> WordHasher:
    return WordHasher(11, non_letters(), lower=True)


def _logit(m: Machine, row: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and the factor sums of each row."""
    v = m.factor[at]
    total = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])], 1)
    square = np.bincount(row, (v * v).sum(1), n)
    return m.bias + np.bincount(row, m.weight[at], n) + 0.5 * ((total**2).sum(1) - square), total


def paired_terms(row: np.ndarray, at: np.ndarray, labels: np.ndarray, docs: np.ndarray, min_docs: int) -> np.ndarray:
    """Terms of pairs whose centred product correlates with the label."""
    n = len(labels)
    use = np.flatnonzero(docs >= min_docs)
    use = use[np.argsort(-(docs[use] * (n - docs[use])), kind="stable")[:PAIR_TERMS]]
    if len(use) < 2 or labels.min(initial=1) == labels.max(initial=0):
        return np.zeros(0, np.int64)
    back = np.full(len(docs), -1)
    back[use] = np.arange(len(use))
    mean, residual = (docs[use] / n).astype(np.float32), (labels - labels.mean()).astype(np.float32)
    along, spread = np.zeros((len(use), len(use)), np.float32), np.zeros((len(use), len(use)), np.float32)
    for i in range(0, n, 1024):
        lo, hi = np.searchsorted(row, (i, min(i + 1024, n)))
        c = np.zeros((min(1024, n - i), len(use)), np.float32)
        mine = back[at[lo:hi]]
        c[row[lo:hi][mine >= 0] - i, mine[mine >= 0]] = 1
        c -= mean
        r = residual[i : i + 1024, None]
        along += (c * r).T @ c
        c *= c
        spread += (c * (r * r)).T @ c
    z = np.abs(along) / np.sqrt(np.maximum(spread, 1e-12))
    np.fill_diagonal(z, 0)
    # chance pairs of rare terms are no normal numbers: the two must meet, or be expected to, often enough
    often = np.maximum(np.outer(mean, mean) * n, 0) >= min_docs
    return use[((z > LEAST_PAIR_Z) & often).any(1)]


def _known(row: np.ndarray, flat: np.ndarray, terms: np.ndarray, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(row, index of its term) of the occurrences of ``terms``, which are sorted."""
    rows, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(flat) if len(terms) else 0, step):
        place = np.minimum(np.searchsorted(terms, flat[i : i + step]), len(terms) - 1)
        hit = terms[place] == flat[i : i + step]
        rows.append(row[i : i + step][hit])
        at.append(place[hit])
    return np.concatenate(rows), np.concatenate(at)


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, *, factors: int = FACTORS, epochs: int = EPOCHS, min_docs: int = MIN_DOCS, seed: int = 5) -> Machine:
    """Adagrad on the logistic loss, classes weighed alike; L1 on the weights sets idle terms to 0 exactly. ``rows`` is emptied."""
    n = len(rows)
    size = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).astype(np.uint64, copy=False)
    rows.clear()
    terms, docs = np.unique(flat, return_counts=True)
    # most terms are rare; what follows holds the others only
    terms, docs = terms[docs >= min_docs], docs[docs >= min_docs]
    row, at = _known(np.repeat(np.arange(n, dtype=np.int32), size), flat, terms)
    del flat
    positive = int(labels.sum())
    toxic_docs = np.bincount(at, labels[row], len(terms)) if n else np.zeros(0)
    rate = docs / max(n, 1)
    error = np.sqrt(rate * (1 - rate) * (1 / max(positive, 1) + 1 / max(n - positive, 1)))
    apart = np.abs(toxic_docs / max(positive, 1) - (docs - toxic_docs) / max(n - positive, 1))
    alone = apart > LEAST_Z * error
    if n:
        alone[paired_terms(row, at, labels, docs, min_docs)] = True
    kept = np.flatnonzero(alone)
    back = np.full(len(terms), -1)
    back[kept] = np.arange(len(kept))
    at = back[at]
    row, at = row[at >= 0], at[at >= 0]
    rng = np.random.default_rng(seed)
    m = Machine(terms[kept], 0.0, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), factors)))
    if not n or positive in (0, n):
        m.bias = -50.0 if positive == 0 else 50.0
        m.factor[:] = 0
        return m
    begin = np.searchsorted(row, np.arange(n + 1))
    cost = np.where(labels == 1, n / (2 * positive), n / (2 * (n - positive)))
    gw, gv, gb = np.full(len(kept), 1e-8), np.full(m.factor.shape, 1e-8), 1e-8
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            index = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in part])
            r, a = np.repeat(np.arange(len(part)), begin[part + 1] - begin[part]), at[index]
            z, total = _logit(m, r, a, len(part))
            e = cost[part] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]) / len(part) * 4
            near, a2 = np.unique(a, return_inverse=True)
            dw = np.bincount(a2, e[r], len(near))
            dv = np.stack([np.bincount(a2, e[r] * (total[r, f] - m.factor[a, f]), len(near)) for f in range(factors)], 1) + L2 * m.factor[near]
            gw[near] += dw**2
            gv[near] += dv**2
            gb += e.sum() ** 2
            step = RATE / np.sqrt(gw[near])
            w = m.weight[near] - step * dw
            m.weight[near] = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
            m.factor[near] -= 0.3 * RATE / np.sqrt(gv[near]) * dv
            m.bias -= RATE / np.sqrt(gb) * e.sum()
    idle = (m.weight == 0) & (np.abs(m.factor).max(1, initial=0) < 0.02)
    return Machine(m.terms[~idle], m.bias, m.weight[~idle], m.factor[~idle])


def score_column(m: Machine, column: pa.Array, hasher: WordHasher) -> np.ndarray:
    row, term = document_terms(column, hasher)
    if not len(m.terms):
        return np.full(len(column), 1 / (1 + np.exp(-m.bias)))
    at = np.minimum(np.searchsorted(m.terms, term), len(m.terms) - 1)
    hit = m.terms[at] == term
    z, _ = _logit(m, row[hit], at[hit], len(column))
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Machine:
    """Fits on at most ``train_rows`` labelled documents for which ``may_learn`` (a condition on the id) holds."""
    spark = docs.sparkSession
    marked = labels.filter(may_learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("label"))
    picked = marked.join(docs.select(id_col).distinct(), id_col, "left_semi").orderBy(F.xxhash64(id_col), id_col).limit(train_rows).collect()  # at most train_rows ids
    if not picked:
        return fit_machine([], np.zeros(0))
    chosen = spark.createDataFrame([(r[0], r[1]) for r in picked], T.StructType([docs.select(id_col).schema[0], T.StructField("label", T.IntegerType())]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            for b in slices(batch, "text"):
                row, term = document_terms(b.column("text"), hasher)
                cut = np.searchsorted(row, np.arange(len(b) + 1))
                yield pa.record_batch([b.column("id"), b.column("label"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term.astype(np.int64)))], ["id", "label", "terms"])

    found = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("id"), "label", "text")
    table = found.mapInArrow(frugal(features), T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("terms", T.ArrayType(T.LongType()))])).toArrow()
    ids, marks, lists = table["id"].to_pylist(), table["label"].to_pylist(), [x.values.to_numpy().view(np.uint64) for x in table["terms"]]
    first: dict = {}
    for k, i in enumerate(ids):  # of repeated ids one row, whichever comes first in the order of its terms
        if i not in first or lists[k].tobytes() < lists[first[i]].tobytes():
            first[i] = k
    order = [first[i] for i in sorted(first)]
    rows, y = [lists[k] for k in order], np.array([marks[k] for k in order])
    del table, lists
    machine = fit_machine(rows, y)
    give_back()
    return machine


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with score and prediction added; columns of those names are replaced."""
    docs = docs.drop(score_col, predicted_col)
    shared = docs.sparkSession.sparkContext.broadcast((machine.terms, machine.bias, machine.weight, machine.factor))
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = Machine(*shared.value), _hasher()
        for batch in batches:
            for b in slices(batch, text_col):
                s = score_column(m, b.column(text_col), hasher)
                yield pa.record_batch([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(frugal(run), schema)
