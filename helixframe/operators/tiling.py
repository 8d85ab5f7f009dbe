"""Tiling: reads cut into encoded reference units and gaps, from alignments with operations.

One group is one read with its alignments; groups are bounded by a read. The walk through an alignment's operations is
sequential, so it runs in a grouped pandas function; the join of reads, alignments and contigs is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 100
SCHEMA = "read_id string, pos int, is_gap boolean, contig int, unit int, is_forward boolean, bases string, ops string, gap_lo int, gap_hi int"
_TURN = str.maketrans("ACGT", "TGCA")


def take_reference(ops: list[tuple[str, int]], n: int) -> tuple[int, list[tuple[str, int]]]:
    """Pops operations (last first) until ``n`` reference bases are used; the read bases used and the operations taken.

    M uses both, I the read only, D the reference only; one that crosses the end is split.
    """
    ref, read, taken = 0, 0, []
    while ref < n and ops:
        op, k = ops.pop()
        if op == "I":
            read += k
        else:
            use = min(k, n - ref)
            if use < k:
                ops.append((op, k - use))
            k, ref = use, ref + use
            if op == "M":
                read += k
        taken.append((op, k))
    return read, taken


def encode_alignment(a: dict, seq: str, stop: int) -> list[tuple[int, int, int, int, list[tuple[str, int]]]]:
    """(unit, start, end, contig, ops) of the units that an alignment holds whole and that end before ``stop`` on the read."""
    start, end = a["ref_start"], a["ref_end"]
    first = 0 if start == 0 else start // UNIT + 1
    last = end // UNIT
    ops = list(reversed(a["ops"]))
    if a["fwd"]:
        units, lead = list(range(first, last)), first * UNIT - start
    else:
        units, lead = list(range(last - 1, first - 1, -1)), end - last * UNIT
    at, out = a["read_start"], []
    if units:
        at += take_reference(ops, lead)[0]
    for u in units:
        read, taken = take_reference(ops, UNIT)
        if at + read < stop:
            out.append((u, at, at + read, a["contig"], taken))
        at += read
    return out


def keep_outer(rows: list[dict]) -> list[dict]:
    """By start, longest, best score: those that end after the last kept end and one."""
    out: list[dict] = []
    for r in sorted(rows, key=lambda r: (r["read_start"], -r["read_end"], -r["score"])):
        if not out or r["read_end"] > out[-1]["read_end"] + 1:
            out.append(r)
    return out


def tile_read(read_id: str, seq: str, alignments: Iterable[dict]) -> list[tuple]:
    rows = keep_outer([a for a in alignments if sum(k for _, k in a["ops"]) > 3 * UNIT])
    found, done = [], 0
    for i, a in enumerate(rows):
        nxt = rows[i + 1] if i + 1 < len(rows) else None
        stop = a["read_end"] if nxt is None or a["read_end"] < nxt["read_start"] or a["contig"] < nxt["contig"] else nxt["read_start"]
        for u, s, e, contig, ops in encode_alignment(a, seq, stop):
            if s >= done:
                found.append((u, s, e, contig, a["fwd"], ops))
                done = e
    out: list[tuple] = []

    def gap(s: int, e: int, pair: tuple | None) -> None:
        if e > s:
            out.append((read_id, len(out), True, None, None, None, seq[s:e], None, *(pair or (None, None))))

    at, before = 0, None
    for u, s, e, contig, fwd, ops in found:
        gap(at, s, None if before is None else (min(before, contig), max(before, contig)))
        out.append((read_id, len(out), False, contig, u, fwd, seq[s:e], "".join(f"{o}{k}" for o, k in ops), None, None))
        at, before = e, contig
    gap(at, len(seq), None)
    return out


def tile(reads: DataFrame, alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """Units and gaps of each read (see SCHEMA). Reads without alignments are one gap.

    reads: (id, seq). alignments: the reader's columns; side 1 is the contig. contigs: (contig, name), a row for each.
    """
    known = alignments.join(F.broadcast(contigs.select(F.col("name").alias("s1_name"), "contig")), "s1_name")
    rows = known.select(
        F.col("s2_name").alias("id"), "contig", "score", "ops", F.col("s1_start").alias("ref_start"), (F.col("s1_start") + F.col("s1_matchlen")).alias("ref_end"),
        F.col("s2_fwd_start").alias("read_start"), F.col("s2_fwd_end").alias("read_end"), F.col("s2_fwd").alias("fwd"),
    )
    each = rows.groupBy("id").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "id"))).alias("alns"))  # bounded by one read
    both = reads.select("id", "seq").join(each, "id", "left")

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            out: list[tuple] = []
            for read_id, seq, alns in pdf.itertuples(index=False):
                have = [] if alns is None else [{k: a[k] for k in ("contig", "score", "ref_start", "ref_end", "read_start", "read_end", "fwd")} | {"ops": _oriented(a)} for a in alns]
                out += tile_read(read_id, seq or "", have)
            frame = pd.DataFrame(out, columns=columns)
            for c in ("contig", "unit", "gap_lo", "gap_hi"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return both.mapInPandas(run, SCHEMA)


def _oriented(a: dict) -> list[tuple[str, int]]:
    """Operations along the read's forward strand."""
    ops = [(o["op"], int(o["len"])) for o in a["ops"]]
    return ops if a["fwd"] else ops[::-1]


def forward_bases(units: DataFrame) -> DataFrame:
    """Encoded units with bases turned to the contig's strand."""
    return units.filter(~F.col("is_gap")).withColumn("bases", F.when(F.col("is_forward"), F.upper("bases")).otherwise(F.reverse(F.translate(F.upper("bases"), "ACGT", "TGCA"))))


def read_back(units: DataFrame) -> DataFrame:
    """(read_id, seq): the read's bases put together again."""
    at = F.array_sort(F.collect_list(F.struct("pos", "bases")))
    return units.groupBy("read_id").agg(F.array_join(F.transform(at, lambda x: x["bases"]), "").alias("seq"))
