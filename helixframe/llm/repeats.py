"""Removal of repeated passages (substring dedup) by recompression.

1. Texts that equal an earlier text are set aside by hash: all their windows begin earlier, so nothing need be searched.
2. Recompression (``recompress``) gives each window of ``width`` words an anchor, a symbol of the highest level that the
   window holds whole. Anchors that the corpus has once only are dropped: their windows cannot repeat.
3. The windows of the others are verified by a 95-bit hash of all their words: in the order of documents and places, the
   first of a hash stays and the others are repeats. With 10**13 such windows the chance that two different ones
   anywhere have one hash is about one in 800.
4. Each document drops the words that its repeats cover.

Anchors and windows are sorted, once each, and read in runs; no run is gathered. Windows of an anchor that very many
texts have are dealt over several tasks, each of which keeps its first one; these few meet in a second step. Texts that
have a repeated anchor only are sent, and only their keys tell which.

Defined results: documents come in the order of doc_id, null ids last, rows of one id by text; rows of equal id and text
count as one document, so each gets that document's result and none repeats the other; a null or empty text has no words
and keeps the hash of an empty text; texts shorter than a window stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import discard, small_or_shuffled, stored, with_keys, without_keys
from helixframe.llm.recompress import window_anchors
from helixframe.llm.textblocks import WordHasher, frugal, grams, slices, text_bytes

WIDTH = 20
#: Windows of one anchor that go to one task; more are dealt over several.
HOT = 20_000
_ROWS = 200_000


def kept_text(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray | None = None) -> bytes:
    words = zip(starts.tolist(), ends.tolist(), strict=True) if gone is None else zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)
    return b" ".join([text[a:b] for a, b in words])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text and the hash of its words joined by one space."""
    h = WordHasher(1)
    for batch in batches:
        for b in slices(batch, "text"):
            raw, off = text_bytes(b.column("text"))
            starts, ends, row = h.spans(raw, off)
            cut, data = np.searchsorted(row, np.arange(len(b) + 1)), raw.tobytes()
            sha = [hashlib.sha256(kept_text(data, starts[i:j], ends[i:j])).hexdigest() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("t1"), b.column("t2"), pa.array(np.diff(cut)), pa.array(sha)], names=["doc_id", "t1", "t2", "n_words", "sha"])


def _unseen(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    """The rows whose text no earlier row of the task has."""
    new = []
    for x in batch.column("t1").to_pylist():
        new.append(x not in seen)
        seen.add(x)
    return batch.filter(pa.array(new, pa.bool_()))


def _anchor_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, seen = WordHasher(1), set()
        for batch in batches:
            for b in slices(_unseen(batch, seen), "text"):
                raw, off = text_bytes(b.column("text"))
                starts, ends, row = h.spans(raw, off)
                at, key, place = window_anchors(h.hashes(raw, starts, ends), row, width)
                new = np.ones(len(at), bool)
                new[1:] = (place[1:] != place[:-1]) | (key[1:] != key[:-1])
                # once for each text, with the number of its places
                doc, own = row[at[new]], key[new]
                order = np.lexsort((own, doc))
                doc, own = doc[order], own[order]
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])))) if len(doc) else doc
                n = np.diff(np.append(first, len(doc))).astype(np.int32)
                yield pa.record_batch([pa.array(own[first].view(np.int64)), pa.array(b.column("t1").to_numpy()[doc[first]]), pa.array(n)], names=["key", "t1", "n"])

    return run


_WINDOW = ["w1", "w2", "salt", "id", "tie", "pos"]


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, seen = WordHasher(1), WordHasher(2), set()
        for batch in batches:
            for b in slices(_unseen(batch, seen), "text"):
                raw, off = text_bytes(b.column("text"))
                starts, ends, row = one.spans(raw, off)
                words = one.hashes(raw, starts, ends)
                at, key, _ = window_anchors(words, row, width)
                keys = b.column("keys")
                edge = keys.offsets.to_numpy()
                marked, tasks = (c.to_numpy() for c in keys.values.flatten())
                marked = marked.view(np.uint64)
                # windows of each document whose anchor is among its repeated ones, and the tasks that these go to
                hit, dealt = np.zeros(len(at), bool), np.ones(len(at), np.int64)
                cut = np.searchsorted(row[at], np.arange(len(b) + 1))
                for i in range(len(b)):
                    own = np.argsort(marked[edge[i] : edge[i + 1]]) + edge[i]
                    place = np.minimum(np.searchsorted(marked[own], key[cut[i] : cut[i + 1]]), len(own) - 1)
                    hit[cut[i] : cut[i + 1]] = marked[own][place] == key[cut[i] : cut[i + 1]]
                    dealt[cut[i] : cut[i + 1]] = tasks[own][place]
                w1, _, place = grams(words, row, width)
                w2, _, _ = grams(two.hashes(raw, starts, ends), row, width)
                first = np.searchsorted(row, row[place])
                doc, t1 = row[place][hit], b.column("t1").to_numpy()
                salt = ((t1[doc] & 0xFFFFFF) % dealt[hit]).astype(np.int32)
                salt[dealt[hit] == 1] = -1
                cols = [w1[hit].view(np.int64), (w2[hit] >> np.uint64(33)).astype(np.int32), salt, b.column("id").to_numpy()[doc], (t1 >> 32).astype(np.int32)[doc], (place - first)[hit].astype(np.int32)]
                for i in range(0, len(doc), _ROWS):
                    yield pa.record_batch([pa.array(c[i : i + _ROWS]) for c in cols], names=_WINDOW)

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch of sorted rows, with: does the row's run of equal keys begin here?"""
    last: tuple | None = None
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        new = np.ones(len(b), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], 0)
        new[0] = last != tuple(c[0] for c in cols)
        last = tuple(c[-1] for c in cols)
        yield b, new


def _repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t1, n) of rows, sorted by key, whose key others have too, or their text has at several places."""
    held: pa.RecordBatch | None = None  # the first row of a run, until another comes
    for b, new in _runs(batches, ["key"]):
        more = np.append(~new[1:], False)  # does the next row go on with the run
        several = b.column("n").to_numpy() > 1
        again = ~new | more | several
        if held is not None and not new[0]:
            yield held
        held = None
        if new[-1] and not several[-1]:
            held = b.slice(len(b) - 1, 1)
        yield b.filter(pa.array(again))


def _later_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows, sorted by (w1, w2, salt, place): all but the first of each run, and the first ones of those that were dealt out.

    Rows that repeat a document repeat its places; those of a run's first place are not later ones.
    """
    place: tuple | None = None
    moved = False  # has the last run another place than its first by now
    for b, new in _runs(batches, ["w1", "w2", "salt"]):
        cols = [b.column(k).to_numpy() for k in ("id", "tie", "pos")]
        other = np.ones(len(b), bool)
        other[1:] = np.any([c[1:] != c[:-1] for c in cols], 0)
        other[0] = place != tuple(c[0] for c in cols)
        place = tuple(c[-1] for c in cols)
        run = np.cumsum(new)
        steps = np.cumsum(other & ~new)
        begin = np.concatenate(([0], steps[new]))  # steps before each run of the batch
        later = steps > begin[run]
        later[run == 0] |= moved
        moved = bool(later[-1])
        first = new & (b.column("salt").to_numpy() >= 0)
        out = b.filter(pa.array(later | first))
        yield pa.record_batch([*out.columns, pa.array(first[later | first])], names=[*_WINDOW, "unsure"])


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = WordHasher(1)
        for batch in batches:
            for b in slices(batch, "text"):
                raw, off = text_bytes(b.column("text"))
                starts, ends, row = h.spans(raw, off)
                cut, data, out = np.searchsorted(row, np.arange(len(b) + 1)), raw.tobytes(), []
                for i, places in enumerate(b.column("places")):
                    n = cut[i + 1] - cut[i]
                    delta = np.zeros(n + 1, np.int64)
                    p = np.asarray(places.values.to_numpy(), np.int64)
                    np.add.at(delta, p, 1)
                    np.add.at(delta, p + width, -1)
                    gone = np.cumsum(delta)[:n] > 0
                    out.append((kept_text(data, starts[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]], gone), int(gone.sum())))
                yield pa.record_batch([b.column("t1"), b.column("t2"), pa.array([k for _, k in out], pa.int64()), pa.array([t.decode("utf-8", "replace") for t, _ in out], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t, _ in out])], names=["t1", "t2", "n_gone", "kept_text", "kept_sha"])

    return run


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(facts, cleaned).

    facts: doc_id, t1, t2, n_words, sha, first_id (the smallest id of that text, null if all are null) for each row.
    cleaned: t1, t2, n_gone, kept_text, kept_sha for each text that loses words where it comes first; rows that repeat an
    id and text repeat it.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(29), F.col("text")).alias("t2"))
    facts = stored(spark, keyed.mapInArrow(frugal(_facts), "doc_id long, t1 long, t2 long, n_words long, sha string"), "facts")
    same = facts.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    facts = facts.join(same, ["t1", "t2"])
    long = facts.filter(F.col("n_words") >= width)
    later = long.filter(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "t1", "t2").distinct()
    later_n = later.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = F.lit(2**63 - 1)  # null ids come last
    named = lambda d: d.withColumns({"id": F.coalesce("doc_id", last), "none": F.col("doc_id").isNull()}).drop("doc_id")
    first = without_keys(named(keyed), named(later), ["id", "none", "t1", "t2"], later_n).drop("none")
    # anchors that the corpus has more than once, by the texts that have them
    anchors = first.select("text", "t1").mapInArrow(frugal(_anchor_rows(width)), "key long, t1 long, n int")
    again = stored(spark, anchors.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(frugal(_repeated_keys), "key long, t1 long, n int"), "anchors")
    hot = again.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT)
    hot = stored(spark, hot.select("key", F.ceil(F.col("n") / HOT).cast("int").alias("tasks")), "hot")
    dealt = again.join(small_or_shuffled(hot, hot.count()), "key", "left").select("t1", F.struct("key", F.coalesce("tasks", F.lit(1)).alias("tasks")).alias("k"))
    marked = stored(spark, dealt.groupBy("t1").agg(F.collect_set("k").alias("keys")), "marked")  # bounded by one text
    # the texts that have such anchors, once each
    held = stored(spark, with_keys(first, marked, ["t1"], marked.count(), None), "held")
    discard(again)
    windows = held.select("id", "text", "t1", "keys").mapInArrow(frugal(_window_rows(width)), "w1 long, w2 int, salt int, id long, tie int, pos int")
    # documents in order: by id, those of one id by the upper half of their text's hash
    runs = windows.repartition(parts, "w1", "salt").sortWithinPartitions("w1", "w2", "salt", "id", "tie", "pos")
    later = stored(spark, runs.mapInArrow(frugal(_later_rows), "w1 long, w2 int, salt int, id long, tie int, pos int, unsure boolean"), "later")
    place = F.struct("id", "tie", "pos")
    unsure = later.filter("unsure").select("w1", "w2", place.alias("place"))
    earliest = unsure.groupBy("w1", "w2").agg(F.min("place").alias("first"))
    sure = unsure.join(earliest, ["w1", "w2"]).filter("place <> first").select("place.*").unionByName(later.filter("not unsure").select("id", "tie", "pos"))
    places = stored(spark, sure.groupBy("id", "tie").agg(F.collect_set("pos").alias("places")), "places")  # bounded by one text
    losing = held.select("t1", "t2", "text", "id", F.shiftright("t1", 32).cast("int").alias("tie"))
    losing = with_keys(losing, places, ["id", "tie"], places.count(), None)
    cleaned = losing.select("t1", "t2", "text", "places").mapInArrow(frugal(_remove(width)), "t1 long, t2 long, n_gone long, kept_text string, kept_sha string")
    return facts, cleaned


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    facts, cleaned = find_repeats(docs, id_col=id_col, text_col=text_col, width=width)
    copy = (F.col("n_words") >= width) & ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    return facts.join(cleaned.drop("kept_text").distinct(), ["t1", "t2"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_gone", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )
