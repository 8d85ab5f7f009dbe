"""Packing: token sequences filled by lexical retrieval.

A document's ids are followed by the end id. Full windows are cut from its start as they are; what is left over (its
rest, shorter than a window) is packed with the rests of other documents that are lexically near:

* in rounds, rests are dealt into shards of bounded size, each of which builds a BM25 inverted index and returns the
  unused neighbours of its seeds, which fill their windows greedily. A rest is found, and asks, by all ids of its
  document, also those in full windows. Document frequencies and the mean length are counted over all documents; as
  terms are token ids, that table has as many rows as the vocabulary;
* rests go to shards in the order of a lexical key: the least terms of the document under random orders in which rare
  terms come early, so documents are neighbours in the key as often as they share terms. Each round has a key of its
  own, so a rest that is still open asks another shard in each round. The first rounds take close neighbours only (a score of
  a given share of the seed's score with itself), the later ones the best there is;
* the last neighbour of a window is cut, and what is left of it is a rest again. Only full windows are kept, so what a
  round leaves is rests. When they are no more than a shard they are filled in one task, window by window; the end is
  cut into pieces whose lengths are powers of two, and no sequence is padded.

The work of a round is linear in the rests; a search of all rests for each window would be quadratic. The README tells
how near the neighbours are that windows so get, against a search of everything. The keys weigh terms as the index does,
by their document frequencies over all documents, so they are made once these are counted.

Defined results: a null text is empty and has the end id only; equal scores go to the rest that is read first; rows that
repeat an id are packed as documents of their own; a very long text is cut like any other, within one task; an empty
table gives no pieces; other columns play no part.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import stored
from helixframe.llm.textblocks import frugal, mix, slices

WINDOW = 1024
#: Rests of a shard: the unit of work of a search.
SHARD_ROWS = 1024
#: Least share of a seed's score with itself that a neighbour needs, by round. Later rounds take any.
NEAR = (0.85, 0.7)
#: Terms of a lexical key; keys: later rounds use them again.
KEY_TERMS, KEYS = 4, 3
K1, B = 1.2, 0.75
DENSE = 16


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file of the tokenizers library, read on the driver. ranks: of its tokens as bytes; none if only the library can encode by it."""

    text: str
    size: int
    ranks: dict[bytes, int]
    added: dict[str, int]


def read_vocabulary(text: str) -> Vocabulary:
    model = json.loads(text)
    added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    vocab, pre = model["model"]["vocab"], model.get("pre_tokenizer") or {}
    size = max(vocab.values()) + 1
    # the split that the encoder knows is that of the library's byte level; any other file goes to the library
    plain = model["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or model.get("normalizer") or model["model"].get("byte_fallback") or model["model"].get("ignore_merges"):
        return Vocabulary(text, size, {}, added)
    # byte-level alphabets write printable bytes as themselves and the others as code points from 256 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return Vocabulary("", size, {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}, added)


class Encoder:
    """Byte-level BPE by a vocabulary file of the tokenizers library.

    special: literals of the file's added tokens in a text become their ids, as the library does it by default; else they
    are text like any other (its encode_special_tokens).
    """

    def __init__(self, vocabulary: Vocabulary, special: bool = False):
        if not vocabulary.ranks:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(vocabulary.text)
            library.encode_special_tokens = not special
            self.encode = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
            return
        import tiktoken

        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        made = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=vocabulary.ranks, special_tokens=vocabulary.added if special else {})
        self.encode = partial(made.encode_to_numpy, allowed_special="all" if special else set(), disallowed_special=())

    def ids(self, text: str | None) -> np.ndarray:
        return self.encode(text) if text else np.zeros(0, np.uint32)


def encoder(vocabulary: Vocabulary, special: bool = False) -> Encoder:
    """One encoder for each worker process, kept between tasks."""
    kept = sys.__dict__.setdefault("_helixframe_encoders", {})
    key = vocabulary.size, hash(vocabulary.text), hash(tuple(vocabulary.ranks.items())), special
    if key not in kept:
        kept[key] = Encoder(vocabulary, special)
    return kept[key]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


_CUT = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, rest_id long, ids binary, size long, terms binary, times binary"


def _short(x: np.ndarray) -> bytes:
    """Two bytes for each number where that is enough, else four; as many as there are terms."""
    return x.astype("<u2" if not len(x) or x.max() < 65536 else "<u4").tobytes()


def _long(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def _terms(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64)


def orders(weight: np.ndarray, key: int) -> np.ndarray:
    """For each place in a key: a random order of the terms, in which heavy ones tend to come early."""
    term = np.arange(len(weight), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = np.array([mix(term + np.uint64(k + 1)) >> np.uint64(11) for k in range(key * KEY_TERMS, (key + 1) * KEY_TERMS)]).astype(float)
    return (-np.log((drawn + 1) / 2**53) / np.maximum(weight, 1e-9)).astype(np.float32)


def lexical_key(terms: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """A key for each document, given by its distinct terms: the first of its terms in each of several orders."""
    n = np.array([len(t) for t in terms])
    flat, first = np.concatenate(terms).astype(np.int64), np.cumsum(n) - n
    out = np.zeros(len(terms), np.int64)
    for o in order:
        value = o[flat]
        at = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, first), n))
        least = np.zeros(len(terms), np.int64)
        least[np.searchsorted(first, at, "right") - 1] = flat[at] & 0xFFFF
        out = (out << 16) | least
    return out


def _cut(tokens, special: bool, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, rest_id = encoder(tokens.value, special), TaskContext.get().partitionId() << 32
        have = np.zeros(tokens.value.size, np.int64)  # documents of the task that have each id

        def shaped(columns: list) -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _CUT.split(", ")])

        for batch in batches:
            for b in slices(batch, "text"):
                out: list[list] = [[] for _ in range(10)]
                for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids = np.append(enc.ids(text), np.uint32(end_id))
                    full = len(ids) // window * window
                    rows = [(i, len(ids), s, window, crc(ids[s : s + window]), None, None, None, None, None) for s in range(0, full, window)]
                    # the whole text is indexed, and counted also where no rest is left of it
                    terms, times = np.unique(ids, return_counts=True)
                    if terms[-1] >= len(have):
                        have = np.append(have, np.zeros(terms[-1] + 1 - len(have), np.int64))
                    have[terms] += 1
                    rest = ids[full:]
                    rows.append((i, len(ids), full, len(rest), None, rest_id if len(rest) else None, rest.astype("<u4").tobytes(), len(ids), terms.astype("<u4").tobytes(), _short(times)))
                    rest_id += 1
                    for c, v in zip(out, zip(*rows, strict=True), strict=True):
                        c += v
                yield shaped(out)
        # a row of its own, without a size, tells how many documents have each id
        at = np.flatnonzero(have)
        if len(at):
            yield shaped([*[[None]] * 8, [at.astype("<u4").tobytes()], [have[at].astype("<u8").tobytes()]])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each id: one row for each id and task that cut."""
    for b in batches:
        for raw, n in zip(b.column("terms").to_pylist(), b.column("times").to_pylist(), strict=True):
            yield pa.record_batch([pa.array(_terms(raw)), pa.array(np.frombuffer(n, "<u8").astype(np.int64))], names=["term", "n"])


class Index:
    """BM25 postings of a shard, by term. idf: by term, over the corpus.

    The postings of a term that many rests have are a dense row over all rests; there are at most DENSE rows for each
    distinct term of a mean rest. The others are lists.
    """

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        counted = [np.unique(r, return_counts=True) for r in rests]
        self._post([t for t, _ in counted], [n for _, n in counted], np.array([len(r) for r in rests]), idf, mean)

    @classmethod
    def counted(cls, terms: list[np.ndarray], times: list[np.ndarray], size: np.ndarray, idf: np.ndarray, mean: float) -> Index:
        """Of texts whose distinct terms are counted."""
        self = cls.__new__(cls)
        self._post(terms, times, size, idf, mean)
        return self

    def _post(self, terms: list[np.ndarray], times: list[np.ndarray], size: np.ndarray, idf: np.ndarray, mean: float) -> None:
        self.n = len(terms)
        term, doc, tf = np.concatenate(terms).astype(np.int64), np.repeat(np.arange(self.n), [len(t) for t in terms]), np.concatenate(times)
        by = np.argsort(term, kind="stable")
        term, self.doc, tf = term[by], doc[by], tf[by]
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / mean))
        often = np.bincount(term, minlength=len(idf)) * DENSE > self.n
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), self.n), np.float32)
        at = often[term]
        self.rows[self.row[term[at]], self.doc[at]] = self.weight[at]
        term, self.doc, self.weight = term[~at], self.doc[~at], self.weight[~at]
        self.begin = np.searchsorted(term, np.arange(len(idf) + 1))

    def keep(self, open_: np.ndarray) -> None:
        """Drops the listed postings of other rests."""
        kept = open_[self.doc]
        self.begin = np.concatenate(([0], np.cumsum(kept)))[self.begin]
        self.doc, self.weight = self.doc[kept], self.weight[kept]

    def _listed(self, seeds: list[np.ndarray]) -> np.ndarray:
        """The scores that the listed terms of several seeds give, as rows."""
        count = np.array([len(s) for s in seeds])
        terms, seed = np.concatenate(seeds).astype(np.int64), np.repeat(np.arange(len(seeds)), count)
        first, n = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.bincount(np.repeat(seed * self.n, n) + self.doc[at], self.weight[at], len(seeds) * self.n).reshape(len(seeds), self.n)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Of every rest of the shard for the distinct terms of a seed."""
        return self.block([np.unique(ids)])[0].astype(float)

    def block(self, seeds: list[np.ndarray]) -> np.ndarray:
        """The scores of several seeds, each given by its distinct terms, as rows."""
        asked = np.zeros((len(seeds), len(self.rows)), np.float32)
        for i, terms in enumerate(seeds):
            row = self.row[terms]
            asked[i, row[row >= 0]] = 1
        return asked @ self.rows + self._listed(seeds).astype(np.float32)


class Shard:
    """Open rests. item: its first id that is left; n: how many are left."""

    def __init__(self, item: np.ndarray, n: np.ndarray, size: np.ndarray, terms: list[np.ndarray], times: list[np.ndarray], idf: np.ndarray, mean: float):
        self.item, self.n = item.copy(), n.copy()
        index = Index.counted(terms, times, size, idf, mean)
        count = np.array([len(x) for x in terms])
        flat, tf = np.concatenate(terms), np.concatenate(times)
        own = np.add.reduceat(idf[flat] * tf * (K1 + 1) / (tf + np.repeat(K1 * (1 - B + B * size / mean), count)), np.cumsum(count) - count).astype(np.float32)
        self.share = np.concatenate([index.block(terms[i : i + 256]) for i in range(0, len(terms), 256)]) / np.maximum(own, 1e-6)[:, None]
        np.fill_diagonal(self.share, -np.inf)

    def fill(self, least: float, window: int) -> list[tuple[int, int, int, int]]:
        """(window, item, length, offset) of the pieces of full windows; what is left is open.

        A seed's window takes its best unused neighbours while these have so great a share of the seed's score with
        itself; one that does not get full so is given up. Seeds with the nearest neighbours come first.
        """
        used, out = np.zeros(len(self.n), np.float32), []  # -inf once used
        for seed in np.argsort(-self.share.max(1), kind="stable").tolist():
            if used[seed]:
                continue
            room, taken, share = window - int(self.n[seed]), [], self.share[seed] + used
            while room > 0:
                best = int(share.argmax())
                if not share[best] >= least:
                    break
                taken.append(best)
                share[best] = -np.inf
                room -= int(self.n[best])
            if room > 0:
                continue
            name, offset = int(self.item[seed]), 0
            for row in [seed, *taken]:
                length = min(int(self.n[row]), window - offset)
                out.append((name, int(self.item[row]), length, offset))
                offset += length
                self.item[row] += length
                self.n[row] -= length
                if not self.n[row]:
                    used[row] = -np.inf
        return out


_OPEN = "kind int, window_id long, item_id long, n long, offset long, size long, terms binary, times binary, key long"


def _keyed(shared, key: int):
    """Rests with one of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = orders(shared.value[0], key)
        for b in batches:
            if len(b):
                made = lexical_key([_terms(t) for t in b.column("terms").to_pylist()], order)
                yield pa.record_batch([*b.columns, pa.array(made)], names=[*b.schema.names, "key"])

    return run


def _round(shared, window: int, least: float, shard_rows: int, following: int):
    """Rows come in the order of the round's key. Gives the pieces of full windows (kind 1) and the open rests (kind 0).

    Open rests get the ``following`` key.

    In rounds that take any neighbour, what is open at a shard's end goes on in the next shard of its task.
    """
    names = [c.split()[0] for c in _OPEN.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = shared.value
        order = orders(idf, following)

        def solve(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
            item, n, size = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 5))
            terms = [_terms(r[6]) for r in rows]
            s = Shard(item, n, size, terms, [_long(r[7], len(t)) for r, t in zip(rows, terms, strict=True)], idf, mean)
            pieces = [(1, *p, *[None] * 4) for p in s.fill(least, window)]
            open_ = np.flatnonzero(s.n).tolist()
            keys = lexical_key([terms[k] for k in open_], order).tolist() if open_ else []
            return pieces, [(0, None, int(s.item[k]), int(s.n[k]), 0, *rows[k][5:8], key) for k, key in zip(open_, keys, strict=True)]

        def shaped(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 4096):
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 4096], strict=True), kinds, strict=True)], names=names)

        carried: list[tuple] = []
        kept: list[tuple] = []
        for b in batches:
            kept += zip(*(b.column(c).to_pylist() for c in names), strict=True)
            while len(kept) >= 2 * shard_rows:  # the last two shards share what is there
                pieces, left = solve(carried + kept[:shard_rows])
                carried, kept = left if least == 0 else [], kept[shard_rows:]
                yield from shaped(pieces if least == 0 else pieces + left)
        while kept:
            step = len(kept) if len(kept) <= shard_rows else -(-len(kept) // 2)
            pieces, left = solve(carried + kept[:step])
            kept = kept[step:]
            carried = left if least == 0 and kept else []
            yield from shaped(pieces if carried else pieces + left)

    return run


Piece = tuple[int, int, int]


def fill(terms: list[np.ndarray], times: list[np.ndarray], size: np.ndarray, length: list[int], idf: np.ndarray, mean: float, window: int) -> Iterator[list[Piece]]:
    """Sequences of what is left in the end: lists of (rest, first id, length). Each is as long as the window or a power of two."""
    if not terms:
        return
    index, open_ = Index.counted(terms, times, size, idf, mean), np.ones(len(terms), bool)
    queue, held, loose = deque(), len(terms), []
    while queue or open_.any():
        if not queue:
            queue.append([(int(open_.argmax()), 0, length[int(open_.argmax())])])
            open_[queue[0][0][0]] = False
        if (n := int(open_.sum())) < 0.85 * held:
            index.keep(open_)
            held = n
        pieces = queue.popleft()
        room, score = window - sum(n for _, _, n in pieces), None
        while room and open_.any():
            if score is None:
                score = np.where(open_, index.scores(terms[pieces[0][0]]), -1.0)
            last = int(score.argmax())
            open_[last], score[last] = False, -1.0
            end = min(length[last], room)
            pieces.append((last, 0, end))
            room -= end
            if end < length[last]:
                queue.appendleft([(last, end, length[last] - end)])
        if room:  # there is no more
            loose += pieces
        else:
            yield pieces
    yield from powers(loose, window)


def powers(pieces: list[Piece], window: int) -> Iterator[list[Piece]]:
    """The same ids, cut into windows and then into sequences whose lengths are powers of two, longest first."""
    left = sum(n for _, _, n in pieces)
    queue = deque(pieces)
    while left:
        room, out = window if left >= window else 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            d, s, n = queue.popleft()
            out.append((d, s, min(n, room)))
            if n > room:
                queue.appendleft((d, s + room, n - room))
            room -= min(n, room)
        yield out


_PIECE = "window_id long, item_id long, n long, offset long"


def _finish(shared, window: int):
    """All that is left, in one task: a shard of rows, or less than a window of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("item_id", "n", "size", "terms", "times")), strict=True))
        items, length, size = ([r[k] for r in rows] for k in range(3))
        terms, out = [_terms(r[3]) for r in rows], []
        for pieces in fill(terms, [_long(r[4], len(t)) for r, t in zip(rows, terms, strict=True)], np.array(size), length, *shared.value, window):
            offset, sequence = 0, items[pieces[0][0]] + pieces[0][1]
            for d, s, n in pieces:
                out.append((sequence, items[d] + s, n, offset))
                offset += n
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in _PIECE.split(", ")])

    return run


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, shard_rows: int = SHARD_ROWS, special: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece. vocabulary: the file's text; special: see Encoder."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = read_vocabulary(vocabulary)
    tokens = spark.sparkContext.broadcast(known)  # a file of a fixed size
    cut = stored(spark, own.mapInArrow(frugal(_cut(tokens, special, window, end_id)), _CUT), "cut")
    rests, texts = cut.filter("rest_id is not null"), cut.filter("size is not null")
    n, total = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    counted = cut.filter("size is null and terms is not null").select("terms", "times").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary
    size = max([known.size, *(r["term"] + 1 for r in counted)])
    df = np.zeros(size)
    df[[r["term"] for r in counted]] = [r["n"] for r in counted]
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    index = spark.sparkContext.broadcast((idf, max(total / max(n, 1), 1.0)))
    pieces = _packed(rests, index, window, shard_rows)
    packed = pieces.join(rests.select("rest_id", "doc_id", "doc_tokens", "start", "ids"), "rest_id").select(
        "doc_id", (F.col("start") + F.col("s")).alias("start"), F.col("n").alias("length"),
        F.crc32(F.substring("ids", (F.col("s") * 4 + 1).cast("int"), (F.col("n") * 4).cast("int"))).alias("ids_crc32"),
        "doc_tokens", (F.col("window_id") * 2 + 1).alias("sequence_id"), "offset")
    full = cut.filter("ids_crc32 is not null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)


def _packed(rests: DataFrame, index, window: int, shard_rows: int) -> DataFrame:
    """The pieces of all rests. An item is a rest, or what is left of one: item_id is rest_id * window + the first id that is left."""
    spark = rests.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    zero = F.lit(0).cast("long")
    left = rests.select(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("window_id"), (F.col("rest_id") * window).alias("item_id"), F.col("length").alias("n"), zero.alias("offset"), "size", "terms", "times")
    placed: list[str] = []  # files of each round, read together: plans stay as small as in the first round
    k, slow, (n, ids) = 0, False, left.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), zero)).first()
    if n > shard_rows and ids >= window:
        left = left.mapInArrow(_keyed(index, 0), _OPEN)
    while n > shard_rows and ids >= window:
        least = NEAR[k] if k < len(NEAR) else 0.0
        # shards follow each other within a partition, so there are no more of these than the session asks for; a round
        # that takes any neighbour leaves less than a window of each partition
        wide = min(parts, -(-n // (12 * max(shard_rows, window))))
        dealt = left.coalesce(1) if slow else left.repartitionByRange(wide, "key", "item_id")
        out = stored(spark, dealt.sortWithinPartitions("key", "item_id").mapInArrow(frugal(_round(index, window, least, shard_rows, (k + 1) % KEYS)), _OPEN), "round")
        placed += out.inputFiles()
        left = out.filter("kind = 0")
        before, (n, ids) = n, left.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), zero)).first()
        k, slow = k + 1, least == 0 and 2 * n > before
    ended = stored(spark, left.select("item_id", "n", "size", "terms", "times").repartition(1).mapInArrow(_finish(index, window), _PIECE), "ended")
    if placed:
        ended = spark.read.schema(_PIECE + ", kind int").parquet(*placed).filter("kind = 1").drop("kind").union(ended)
    rest_of = F.call_function("div", F.col("item_id"), F.lit(window)).alias("rest_id")
    return ended.select("window_id", rest_of, (F.col("item_id") % window).alias("s"), "n", "offset")
