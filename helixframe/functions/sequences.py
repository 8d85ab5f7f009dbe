"""Column functions on base sequences and alignment operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Upper case; letters that are no base stay what they are."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def base_count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def kmer_index(kmer: Column) -> Column:
    """Two bits for each base."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def parse_cigar(text: Column) -> Column:
    """``10,1:0,5`` -> [(M,10),(D,1),(M,5)]: ``a:b`` is a bases of the reference only, then b of the read only; zeros go."""

    def part(p: Column) -> Column:
        two = F.split(p, ":")
        pair = F.array(F.struct(F.lit("D").alias("op"), two[0].cast("int").alias("len")), F.struct(F.lit("I").alias("op"), F.get(two, F.lit(1)).cast("int").alias("len")))
        return F.when(F.size(two) == 2, pair).otherwise(F.array(F.struct(F.lit("M").alias("op"), p.cast("int").alias("len"))))

    return F.filter(F.flatten(F.transform(F.split(text, ","), part)), lambda x: x["len"] > 0)


def alignment_length(ops: Column) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda acc, x: acc + x["len"])


def forward_start(start: Column, length: Column, total: Column, fwd: Column) -> Column:
    """Start on the forward strand."""
    return F.when(fwd, start).otherwise(total - length - start)


def kmer_entropy_of(seq: str | None, k: int = 6, compat: bool = False) -> float | None:
    """Shannon entropy (bits) of a sequence's k-mers; null if it has none.

    compat: the window skips base k - 1 and the shares are of one k-mer more than were counted.
    """
    if seq is None or len(seq) < k or (compat and len(seq) == k):
        return None
    code = np.frombuffer(seq.encode("utf-8", "replace"), np.uint8).astype(np.int64) & 7
    if compat:
        code = np.delete(code, k - 1)
    n = len(code) - k + 1
    if n <= 0:
        return None
    kmer = np.zeros(n, np.int64)
    for i in range(k):
        kmer = kmer * 8 + code[i : i + n]
    _, count = np.unique(kmer, return_counts=True)
    p = count / (n + 1 if compat else n)
    return float(-(p * np.log2(p)).sum() + 0.0)


def kmer_entropies(texts: list[str | None], k: int = 6, compat: bool = False) -> np.ndarray:
    """``kmer_entropy_of`` each text, NaN for null, worked out over all of them at once."""
    raw = [b"" if x is None or len(x) < k or (compat and len(x) == k) else x.encode("ascii", "replace") for x in texts]
    size = np.array([len(x) for x in raw], np.int64)
    code, row = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) & 7, np.repeat(np.arange(len(raw)), size)
    if compat:
        keep = np.ones(len(code), bool)
        keep[(np.cumsum(size) - size)[size > 0] + k - 1] = False
        code, row, size = code[keep], row[keep], size - (size > 0)
    m = max(len(code) - k + 1, 0)
    kmer = np.zeros(m, np.int64)
    for i in range(k):
        kmer = kmer * 8 + code[i : i + m]
    whole = row[:m] == row[k - 1 :][:m] if m else np.zeros(0, bool)
    found, n = np.unique((row[:m][whole] << (3 * k)) | kmer[whole], return_counts=True)
    owner = found >> (3 * k)
    total = np.maximum(size - k + 1, 0) + (1 if compat else 0)
    p = n / total[owner]
    out = -np.bincount(owner, p * np.log2(p), len(raw)) + 0.0
    return np.where(size >= k, out, np.nan)


def kmer_entropy(seq: Column, k: int = 6, compat: bool = False) -> Column:
    """Worked out once for each row, also where a filter looks at it: the plan may not copy it."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        out, texts = [], s.tolist()
        for i in range(0, len(texts), 64):
            out.append(kmer_entropies(texts[i : i + 64], k, compat))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    h = run.asNondeterministic()(seq)
    return F.nanvl(h, F.lit(None).cast("double"))


def log_factorials(n: Column) -> Column:
    """ln n! by Stirling's series from 16 on, exact products below."""
    small = F.get(F.array(*(F.lit(float(np.log(float(f)))) for f in np.cumprod([1.0, *range(1, 16)]))), n.cast("int"))
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * float(np.log(2 * np.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 16, small).otherwise(series)
