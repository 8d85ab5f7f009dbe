"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are integer rows. Candidates are split into blocks; a block keeps a posting list for each component (term): the
candidates where it is not 0, with their weights; a list that most candidates are in is a dense row. A block of queries
then goes through its terms one at a time: each adds weight times postings to a dense array of scores, queries by
candidates. Partition selection keeps the k best of each block, and a merge over blocks keeps the k best of all. Nothing
is skipped, so the result is exact.

Blocks bound memory: scores of QUERY_BLOCK x ROW_BLOCK. Rows are dealt into groups, and queries too once they are more
than QUERY_NUMBERS numbers. A cell is a group of queries with a group of rows: one task holds its queries and lets its
rows stream by. Both sides go to the cells by a shuffle, whatever their size, so the driver holds no vector; a query is
copied once for each group of rows, and a row once for each group of queries.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; vectors of different
lengths meet on the components that both have; ties go to the smaller id; rows that repeat an id count as one (the row
with the greatest vector).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.textblocks import frugal

QUERY_BLOCK, ROW_BLOCK = 512, 4096
#: Queries that go through the terms together: their scores stay in a core's cache.
TILE = 64
#: A posting list with more than one in so many rows of a block is a dense row.
DENSE = 8
#: Rows of a group, at most; numbers in the queries of a group, about.
ROW_GROUP, QUERY_NUMBERS = 1 << 17, 1 << 24


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component, usable vectors only, one row for each id."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(~bad).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(v).alias("v"))


def accumulate(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of every query against every row, a term at a time."""
    dims = min(q.shape[1], rows.shape[1])
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    kind = np.int32 if most(q) * most(rows) * max(dims, 1) < 2**31 else np.int64
    asks, terms = (np.ascontiguousarray(x.T[:dims].astype(kind)) for x in (q, rows))
    lists = [np.flatnonzero(t) for t in terms]
    scores, added = np.zeros((len(q), len(rows)), kind), np.empty((min(TILE, len(q)), len(rows)), kind)
    for a in range(0, len(q), TILE):
        tile = scores[a : a + TILE]
        for t, post in enumerate(lists):
            weight = asks[t, a : a + TILE, None]
            if not len(post) or not weight.any():
                continue
            if len(post) * DENSE > len(rows):
                tile += np.multiply(weight, terms[t], out=added[: len(tile)])
            else:
                tile[:, post] += weight * terms[t, post]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows but the query's own: higher score first, then smaller id."""
    may = np.flatnonzero(ids != own)
    s = scores[may].astype(np.int64)
    if len(s) > k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        may, s = may[s >= edge], s[s >= edge]
    order = np.lexsort((ids[may], -s))[:k]
    return ids[may[order]], s[order]


class Best:
    """The k best rows that each query has met. Rows come by ascending id, so a later one needs a higher score."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.ids, self.scores, self.n = np.zeros((len(own), k), np.int64), np.zeros((len(own), k), np.int64), np.zeros(len(own), np.int64)

    def meet(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of the queries from ``first`` on against the rows ``ids``."""
        at = slice(first, first + len(scores))
        full, edge = self.n[at] == self.k, self.scores[at, -1]
        for j in np.flatnonzero(~full | (scores.max(1) > edge)).tolist():
            i, hit = first + j, np.flatnonzero(scores[j] > edge[j]) if full[j] else slice(None)
            held, found = slice(0, self.n[i]), best(scores[j][hit], ids[hit], self.own[i], self.k)
            x, s = best(np.append(self.scores[i, held], found[1]), np.append(self.ids[i, held], found[0]), self.own[i], self.k)
            self.ids[i, : len(x)], self.scores[i, : len(x)], self.n[i] = x, s, len(x)

    def rows(self) -> pa.RecordBatch:
        there = np.arange(self.k) < self.n[:, None]
        return pa.record_batch([pa.array(np.repeat(self.own, self.n)), pa.array(self.ids[there]), pa.array(self.scores[there])], names=["query_id", "vec_id", "score"])


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, each number in as few as the batch allows: (id, width, v)."""
    for b in batches:
        vectors = b.column("v")
        flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64), vectors.offsets.to_numpy().astype(np.int64)
        width = next(w for w in (2, 4, 8) if w == 8 or (-(2 ** (8 * w - 1)) <= flat.min(initial=0) and flat.max(initial=0) < 2 ** (8 * w - 1)))
        at = ((offsets - offsets[0]) * width).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.astype(f"<i{width}").tobytes())])
        yield pa.record_batch([b.column("id"), pa.array(np.full(len(b), width, np.int32)), coded.cast(pa.binary())], names=["id", "width", "v"])


def _matrix(width: np.ndarray, coded: pa.Array) -> np.ndarray:
    """Coded vectors as rows; short ones end in zeros."""
    raw = coded.to_pylist()
    length = np.array([len(x) for x in raw]) // width
    if (length == length[0]).all() and (width == width[0]).all():
        return np.frombuffer(b"".join(raw), f"<i{width[0]}").reshape(len(raw), length[0])
    out = np.zeros((len(raw), length.max()), np.int64)
    for i, (w, x) in enumerate(zip(width.tolist(), raw, strict=True)):
        out[i, : length[i]] = np.frombuffer(x, f"<i{w}")
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    wide = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts])


def _search(k: int, query_block: int, row_block: int):
    """Rows come by cell, in it the queries (kind 0) first, then the candidates (kind 1) by id. Gives the k best of each query and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asks, asked, held = None, [], None, None
        for batch in batches:
            cells, kinds, ids, width = (batch.column(c).to_numpy() for c in ("cell", "kind", "id", "width"))
            cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if cells[a] != cell:
                    if held is not None:
                        yield held.rows()
                    cell, asks, asked, held = cells[a], [], None, None
                if kinds[a] == 0:
                    asks.append((ids[a:b], _matrix(width[a:b], batch.column("v").slice(a, b - a))))
                    continue
                if held is None and asks:
                    held, asked, asks = Best(np.concatenate([x for x, _ in asks]), k), _joined([x for _, x in asks]), []
                for r in range(a, b, row_block) if held is not None else ():
                    end = min(r + row_block, b)
                    rows = _matrix(width[r:end], batch.column("v").slice(r, end - r))
                    for q in range(0, len(asked), query_block):
                        held.meet(q, accumulate(asked[q : q + query_block], rows), ids[r:end])
        if held is not None:
            yield held.rows()

    return run


def exact_topk(df: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row for which ``is_query`` (a condition on ``id``) holds."""
    rows = integer_vectors(df, id_col, vec_col, scale)
    asks = rows.filter(is_query)
    sizes = df.select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("size"))
    n, m, wide = sizes.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max("size")).first()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_groups = max(1, -(-n // min(ROW_GROUP, max(ROW_BLOCK, -(-n // parts)))))
    query_groups = max(1, -(-m // max(1, QUERY_NUMBERS // max(wide or 0, 1))))
    coded = lambda side: side.mapInArrow(_code, "id long, width int, v binary")
    group = lambda name, of: F.pmod(F.xxhash64("id", F.lit(name)), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    cells = coded(rows).select("*", group("row", row_groups).alias("r"), each(query_groups).alias("q"), F.lit(1).alias("kind"))
    cells = cells.unionByName(coded(asks).select("*", each(row_groups).alias("r"), group("query", query_groups).alias("q"), F.lit(0).alias("kind")))
    cells = cells.select((F.col("r") * query_groups + F.col("q")).alias("cell"), "kind", "id", "width", "v")
    dealt = cells.repartitionById(row_groups * query_groups, "cell").sortWithinPartitions("cell", "kind", "id")
    found = dealt.mapInArrow(frugal(_search(k, QUERY_BLOCK, ROW_BLOCK)), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
