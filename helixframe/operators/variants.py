"""Pileups, allele calls and co-occurrence of variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import log_factorials

BASES = ("a", "c", "g", "t")
_GAP = ord("-")


def bases_of(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """(read_id, pos, base), positions from 0. Texts are cut into single letters once, not by substr at each place."""
    return reads.select("read_id", F.posexplode(F.filter(F.split(seq, ""), lambda x: x != "")).alias("pos", "base")).withColumn("pos", F.col("pos").cast("long"))


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, the row and the place of each. Letters are ASCII."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    row = np.repeat(np.arange(len(column)), np.diff(off))
    return raw, row, np.arange(len(raw)) - (off[:-1] - off[0])[row]


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, len(batch), rows))


class _Sums:
    """Counts by place and channel that grow with the places seen: a task's result has a row for each place."""

    def __init__(self, channels: int):
        self.n = np.zeros((0, channels), np.int64)

    def add(self, place: np.ndarray, channel: int) -> None:
        more = np.bincount(place)
        if len(more) > len(self.n):
            self.n = np.concatenate((self.n, np.zeros((len(more) - len(self.n), self.n.shape[1]), np.int64)))
        self.n[: len(more), channel] += more

    def rows(self, names: list[str]) -> pa.RecordBatch:
        at = np.flatnonzero(self.n.any(1))
        return pa.record_batch([pa.array(at), *(pa.array(self.n[at, k]) for k in range(self.n.shape[1]))], names=["pos", *names])


def pileup_of(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """``pileup`` of whole sequences: each task counts its own by place, so places are shuffled and not bases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(4)
        for batch in batches:
            for b in _slices(batch):
                raw, _, place = _letters(b.column(0))
                for k, letter in enumerate(b"ACGT"):
                    sums.add(place[raw == letter], k)
        yield sums.rows(list(BASES))

    return reads.select(seq).mapInArrow(run, "pos long, a long, c long, g long, t long").groupBy("pos").agg(*(F.sum(b).alias(b) for b in BASES))


def gap_runs_of(reads: DataFrame, seq: str) -> DataFrame:
    """``indel_runs`` of whole gapped sequences, by the same way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(1)
        for batch in batches:
            for b in _slices(batch):
                raw, _, place = _letters(b.column(0))
                gap = raw == _GAP
                first = gap.copy()
                first[1:] &= ~gap[:-1] | (place[1:] == 0)
                sums.add(place[first], 0)
        yield sums.rows(["n"])

    return reads.select(seq).mapInArrow(run, "pos long, n long").groupBy("pos").agg(F.sum("n").alias("n"))


def transitions_of(pairs: DataFrame, r: str = "r", q: str = "q") -> DataFrame:
    """(op, next, n) of whole gapped pairs of equal lengths: consecutive operations, and with a null next all of each."""
    ops = "MXID"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((4, 5), np.int64)
        for batch in batches:
            for b in _slices(batch):
                (x, row, _), (y, _, _) = _letters(b.column(0)), _letters(b.column(1))
                op = np.where(x == _GAP, 2, np.where(y == _GAP, 3, np.where(x != y, 1, 0)))
                same = row[1:] == row[:-1]
                n[:, :4] += np.bincount(op[:-1][same] * 4 + op[1:][same], minlength=16).reshape(4, 4)
                n[:, 4] += np.bincount(op, minlength=4)
        i, j = np.nonzero(n)
        yield pa.record_batch([pa.array([ops[k] for k in i], pa.string()), pa.array([ops[k] if k < 4 else None for k in j], pa.string()), pa.array(n[i, j])], names=["op", "next", "n"])

    return pairs.select(r, q).mapInArrow(run, "op string, next string, n long").groupBy("op", "next").agg(F.sum("n").alias("n"))


def pileup(bases: DataFrame) -> DataFrame:
    """(pos, a, c, g, t): counts of each base at each place; gaps do not count."""
    return bases.filter(F.col("base").isin("A", "C", "G", "T")).groupBy("pos").agg(*(F.count_if(F.col("base") == b.upper()).alias(b) for b in BASES))


def ranked_bases() -> Column:
    """The bases of a pileup row by count; of equal counts the later base comes first."""
    return F.sort_array(F.array(*(F.struct(F.col(b).alias("n"), F.lit(i).alias("i")) for i, b in enumerate(BASES))), asc=False)


def minor_alleles(piles: DataFrame) -> DataFrame:
    """(pos, major, minor, n_minor, total, maf)."""
    r = piles.withColumn("r", ranked_bases()).withColumn("total", F.col("a") + F.col("c") + F.col("g") + F.col("t"))
    name = lambda k: F.substring(F.lit("ACGT"), F.col("r")[k]["i"] + 1, F.lit(1))
    return r.select("pos", name(0).alias("major"), name(1).alias("minor"), F.col("r")[1]["n"].alias("n_minor"), "total", F.try_divide(F.col("r")[1]["n"], F.col("total")).alias("maf"))


def call_variants(piles: DataFrame, p: float, sigmas: float = 8.0) -> DataFrame:
    """Places whose minor fraction exceeds p by ``sigmas`` standard errors."""
    return minor_alleles(piles).filter(F.col("maf") > p + sigmas * F.sqrt(F.lit(p * (1 - p)) / F.col("total")))


def variant_pairs(bases: DataFrame, sites: DataFrame, least: int = 3) -> DataFrame:
    """(pos1, pos2, tot, mac1, mac2, share) of pairs of sites over the reads that cover both, with share > ``least``."""
    at = bases.join(sites.select("pos", "minor"), "pos").select("read_id", "pos", (F.col("base") == F.col("minor")).alias("m"))
    a, b = at.select("read_id", F.col("pos").alias("pos1"), F.col("m").alias("m1")), at.select("read_id", F.col("pos").alias("pos2"), F.col("m").alias("m2"))
    both = a.join(b, "read_id").filter("pos1 < pos2")
    n = lambda c: F.count_if(c)
    return both.groupBy("pos1", "pos2").agg(F.count(F.lit(1)).alias("tot"), n(F.col("m1")).alias("mac1"), n(F.col("m2")).alias("mac2"), n(F.col("m1") & F.col("m2")).alias("share")).filter(F.col("share") > least)


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """``pairs`` with mlp = -ln P(X > share), X hypergeometric: mac1 draws from tot with mac2 marked; 10000 where P is 0."""
    x = F.sequence(F.col("share") + 1, F.least("mac1", "mac2"))
    xs = F.when(F.col("share") < F.least("mac1", "mac2"), x).otherwise(F.array().cast("array<bigint>"))
    lf = log_factorials
    choose = lambda n, k: lf(n) - lf(k) - lf(n - k)
    rows = pairs.withColumn("x", F.explode_outer(xs))
    possible = F.col("mac1") - F.col("x") <= F.col("tot") - F.col("mac2")
    log_p = choose(F.col("mac2"), F.col("x")) + choose(F.col("tot") - F.col("mac2"), F.col("mac1") - F.col("x")) - choose(F.col("tot"), F.col("mac1"))
    rows = rows.withColumn("lp", F.when(F.col("x").isNotNull() & possible, log_p))
    keys = pairs.columns
    tail = rows.groupBy(*keys).agg(F.max("lp").alias("top"), F.collect_list("lp").alias("lps"))  # bounded by one pair's counts
    total = F.col("top") + F.log(F.aggregate("lps", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top"))))
    return tail.select(*keys, F.coalesce(-total, F.lit(10000.0)).alias("mlp"))


def majority_variants(piles: DataFrame, freq: float = 0.7, least_depth: int = 30) -> DataFrame:
    """(pos, count_max, depth, alt): the most frequent base where it has more than ``freq`` of more than ``least_depth``."""
    r = piles.withColumn("r", ranked_bases()).withColumn("depth", F.col("a") + F.col("c") + F.col("g") + F.col("t"))
    return r.filter((F.col("depth") > least_depth) & (F.col("r")[0]["n"] > F.col("depth") * freq)).select("pos", F.col("r")[0]["n"].alias("count_max"), "depth", F.substring(F.lit("ACGT"), F.col("r")[0]["i"] + 1, F.lit(1)).alias("alt"))


def divergence(piles: DataFrame, ins: DataFrame, dels: DataFrame, over: int = 20) -> DataFrame:
    """(Pos, ErrorRate, Coverage, Type) for places covered more than ``over`` times: substitutions and both kinds of runs."""
    at = minor_alleles(piles).filter(F.col("total") > over).join(ins.withColumnRenamed("n", "i"), "pos", "left").join(dels.withColumnRenamed("n", "d"), "pos", "left").fillna(0, ["i", "d"])
    rate = lambda n: n / (F.col("total") + n)
    wide = at.select(F.col("pos").alias("Pos"), F.col("total").alias("Coverage"), F.col("maf").alias("Sub"), rate(F.col("i")).alias("Ins"), rate(F.col("d")).alias("Del"))
    return wide.unpivot(["Pos", "Coverage"], ["Sub", "Ins", "Del"], "Type", "ErrorRate")


def error_rates(pairs: DataFrame) -> DataFrame:
    """(mismatch, insertion, deletion): shares of columns of gapped pairs (pos, r, q), over all alignments."""
    kind = F.when(F.col("r") == "-", "I").when(F.col("q") == "-", "D").when(F.col("r") != F.col("q"), "X").otherwise("M")
    n = lambda k: F.count_if(kind == k) / F.count(F.lit(1))
    return pairs.agg(n("X").alias("mismatch"), n("I").alias("insertion"), n("D").alias("deletion"))
