"""Pileups of six channels from alignment operations, the long-read caller, error models and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = ("a", "c", "g", "t", "ins", "del")


def six_channels(alns: DataFrame) -> DataFrame:
    """(contig, pos, a, c, g, t, ins, del) of alignments (contig, start, ops, seq), ops an array of (op, len).

    M, = and X consume both sides; I and S and H the read only; D the reference only. An insertion of n bases counts at
    n consecutive places from where it stands. Bases of either case count; others don't.
    """

    def step(s: Column, o: Column) -> Column:
        both, read = o["op"].isin("M", "=", "X"), o["op"].isin("I", "S", "H")
        return F.struct((s["r"] + F.when(both | (o["op"] == "D"), o["len"]).otherwise(0)).alias("r"), (s["q"] + F.when(both | read, o["len"]).otherwise(0)).alias("q"),
                        F.concat(s["out"], F.array(F.struct(o["op"].alias("op"), o["len"].alias("len"), s["r"].alias("r"), s["q"].alias("q")))).alias("out"))

    none = F.array().cast("array<struct<op:string,len:bigint,r:bigint,q:bigint>>")
    ops = F.transform("ops", lambda o: F.struct(o["op"].alias("op"), o["len"].cast("long").alias("len")))
    runs = F.aggregate(ops, F.struct(F.col("start").cast("long").alias("r"), F.lit(0).cast("long").alias("q"), none.alias("out")), step, lambda s: s["out"])
    runs = alns.select("contig", "seq", F.explode(runs).alias("x")).filter("x.op in ('M', '=', 'X', 'I', 'D') and x.len > 0")
    each = runs.select("contig", "x.op", F.col("x.r").alias("r"), F.posexplode(F.split(F.when(F.col("x.op").isin("I", "D"), F.repeat(F.lit("-"), F.col("x.len").cast("int"))).otherwise(F.expr("upper(substring(seq, cast(x.q + 1 as int), cast(x.len as int)))")), "")).alias("k", "base")).filter("base <> ''")
    n = lambda c: F.count_if(c)
    same = ~F.col("op").isin("I", "D")
    return each.groupBy("contig", (F.col("r") + F.col("k")).alias("pos")).agg(*(n(same & (F.col("base") == b.upper())).alias(b) for b in CHANNELS[:4]), n(F.col("op") == "I").alias("ins"), n(F.col("op") == "D").alias("del"))


def long_read_calls(piles: DataFrame, references: DataFrame, freq: float = 0.7, least_depth: int = 30, every: bool = False) -> DataFrame:
    """(contig, pos, depth, n, ref, alt) where a base other than the reference's, insertions or deletions have more than ``freq`` of the depth.

    references: (contig, pos, ref). Of equal counts the later base is the commonest. every: the base of every place.
    """
    top = F.array_max(F.array(*(F.struct(F.col(b).alias("n"), F.lit(i).alias("i")) for i, b in enumerate(CHANNELS[:4]))))
    rows = piles.join(references, ["contig", "pos"]).withColumns({"top": top, "depth": F.col("a") + F.col("c") + F.col("g") + F.col("t")})
    alt = F.substring(F.lit("ACGT"), F.col("top.i") + 1, F.lit(1))
    deep, often = F.col("depth") > least_depth, lambda n: n > F.col("depth") * freq
    call = lambda when, n, ref, alt: F.when(when, F.struct(n.alias("n"), ref.alias("ref"), alt.alias("alt")))
    base = (deep & often(F.col("top.n")) & (F.upper("ref") != alt)) | F.lit(every)
    calls = F.array_compact(F.array(call(base, F.col("top.n"), F.col("ref"), alt), *(call(deep & often(F.col(c)), F.col(c), F.lit("-"), F.lit(k)) for c, k in (("ins", "I"), ("del", "D")))))
    return rows.select("contig", "pos", "depth", F.explode(calls).alias("x")).select("contig", "pos", "depth", "x.*")


def alignment_columns(pairs: DataFrame) -> DataFrame:
    """Columns of gapped pairs (pos, r, q) with their operation: Match, Mism, In (the read has more) or Del."""
    kind = F.when(F.col("r") == "-", "In").when(F.col("q") == "-", "Del").when(F.upper("r") != F.upper("q"), "Mism").otherwise("Match")
    return pairs.withColumn("op", kind)


def match_lines(pairs: DataFrame) -> DataFrame:
    """(read_id, ref, line, query) of whole alignments from their columns: ``|`` for equal letters, ``X`` for others, spaces at gaps."""
    mark = F.when((F.col("r") == "-") | (F.col("q") == "-"), " ").when(F.upper("r") == F.upper("q"), "|").otherwise("X")
    rows = pairs.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "r", "q", mark.alias("m")))).alias("x"))  # bounded by one alignment
    return rows.select("read_id", *(F.array_join(f"x.{c}", "").alias(n) for c, n in (("r", "ref"), ("m", "line"), ("q", "query"))))


def error_model(transitions: DataFrame, n_alignments: int) -> DataFrame:
    """One row of probabilities from counts (op, next, n) of consecutive operations M, X, I, D and totals (op, null, n).

    Alignments begin with a match, which no operation goes before.
    """
    op, nxt = F.col("op"), F.col("next")
    mm = lambda c: c.isin("M", "X")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    total = lambda c: n(nxt.isNull() & c)
    step = lambda a, b: n(nxt.isNotNull() & a & b)
    t = transitions.agg(total(mm(op)).alias("mm"), total(op == "X").alias("x"), total(op == "I").alias("i"), total(op == "D").alias("d"),
                        step(mm(op), mm(nxt)).alias("mm_mm"), step(mm(op), nxt == "I").alias("mm_i"), step(mm(op), nxt == "D").alias("mm_d"), step(op == "I", nxt == "I").alias("i_i"), step(op == "D", nxt == "D").alias("d_d"), step(op == "D", nxt == "I").alias("d_i"))
    inner = F.col("mm") - n_alignments
    div = lambda a, b: F.try_divide(a, b)
    return t.select(div(F.col("x"), F.col("mm")).alias("mismatch"), div(F.col("mm_mm"), inner).alias("p_match"), div(F.col("mm_i"), inner).alias("p_ins"), div(F.col("mm_d"), inner).alias("p_del"), div(F.col("i_i"), F.col("i")).alias("p_extend_ins"), div(F.col("d_d"), F.col("d")).alias("p_extend_del"), div(F.col("d_i"), F.col("d")).alias("p_del_to_ins"))


def covered_columns(pairs: DataFrame) -> DataFrame:
    """(pos, cov): alignments whose read has a base there."""
    return pairs.filter("q <> '-'").groupBy("pos").agg(F.count(F.lit(1)).alias("cov"))


def reference_columns(pairs: DataFrame) -> DataFrame:
    """Columns where the reference has a base, both sides in upper case; lower-case ones count like others."""
    return pairs.filter("r <> '-'").select("read_id", "pos", F.upper("r").alias("r"), F.upper("q").alias("q"))


def masked(bases: DataFrame, depth: DataFrame) -> DataFrame:
    """(contig, seq): bases (contig, pos, base) in lower case where ``depth`` (contig, pos, n) has more than one, else upper."""
    m = bases.join(depth, ["contig", "pos"], "left").withColumn("b", F.when(F.col("n") > 1, F.lower("base")).otherwise(F.upper("base")))
    return m.groupBy("contig").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "").alias("seq"))  # a sequence is one value


def deepest_stretch(depth: DataFrame) -> DataFrame:
    """(contig, start, end, peak): of runs (contig, start, end, peak) of depth over 0 the deepest, then the widest, then the first."""
    order = F.struct("peak", (F.col("end") - F.col("start")).alias("w"), (-F.col("start")).alias("s"))
    return depth.groupBy("contig").agg(F.max_by(F.struct("start", "end", "peak"), order).alias("x")).select("contig", "x.*")
