"""Queries over the alignments view."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import numbers as N
from helixframe.operators import coverage as C
from helixframe.operators import intervals as I
from helixframe.operators import ranges as R
from helixframe.plans.adapters import ALNS_SQL, READS_SQL, UNITS_SQL, alns, reads, units


def _pairs(s, d):
    a = alns(s, d)
    return a.select("read_id", "fwd", "score", F.col("contig").alias("c1"), F.col("st").alias("s1"), (F.col("en") - F.col("st")).alias("m1"), (F.col("ln") % 4).alias("c2"), F.expr("score % 1500").alias("s2"), (F.col("en") - F.col("st") + F.col("ln") * 7).alias("m2"))


_PAIRS = f"""WITH {ALNS_SQL}, p AS (SELECT read_id, fwd, score, contig AS c1, st AS s1, en - st AS m1, ln % 4 AS c2, score % 1500 AS s2, en - st + ln * 7 AS m2 FROM alns)"""


def _contigs(s, d):
    return s.createDataFrame([(0, 450), (1, 480), (2, 500)], "contig long, length long")


def _genes(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select((F.col("p_partkey") % 4).alias("contig"), (F.col("p_partkey") * 7 % 2000).alias("start"), (F.col("p_partkey") * 7 % 2000 + F.col("p_size") * 10).cast("long").alias("end"), F.col("p_name").alias("gene"), F.col("p_partkey").alias("ord"))


def _repeats(s, d):
    return _genes(s, d).select("contig", F.col("start").alias("rs"), F.col("end").alias("re"), "ord")


def _keyed(s, d):
    p = alns(s, d).filter("read_id % 3 = 0")
    return p.select((F.col("read_id") * 10 + F.col("ln")).alias("key"), F.col("contig").alias("c1"), (F.col("st") * 17 % 9000).alias("s1"), (F.col("st") * 17 % 9000 + F.col("ln") * 9).alias("e1"), ((F.col("contig") + 1) % 4).alias("c2"), (F.col("en") * 13 % 9000).alias("s2"), (F.col("en") * 13 % 9000 + F.col("ln") * 7).alias("e2"))


def _spans(s):
    return s.createDataFrame([(0, 0, 10, 14), (1, 0, 50, 53), (2, 1, 20, 30), (3, 1, 70, 71), (4, 1, 90, 95)], "region long, contig long, start long, end long")


def _two(s, d):
    """Two log-likelihoods of each alignment, by read."""
    return alns(s, d).select("read_id", (-(F.col("score") % 37) / 3).alias("l1"), (-(F.col("st") % 31) / 3).alias("l2"))


_SPANS = 'sp AS (SELECT * FROM (VALUES (0, 0, 10, 14), (1, 0, 50, 53), (2, 1, 20, 30), (3, 1, 70, 71), (4, 1, 90, 95)) AS v(region, contig, "start", "end"))'
_TWO = "tw AS (SELECT read_id, -(score % 37) / 3 AS l1, -(st % 31) / 3 AS l2 FROM alns), sm AS (SELECT *, exp(l1) / (exp(l1) + exp(l2)) AS w1, exp(l2) / (exp(l1) + exp(l2)) AS w2 FROM tw), ent AS (SELECT *, ln(2) + w1 * ln(w1) + w2 * ln(w2) AS e FROM sm)"
_KEYED = "kp AS (SELECT read_id * 10 + ln AS key, contig AS c1, st * 17 % 9000 AS s1, st * 17 % 9000 + ln * 9 AS e1, (contig + 1) % 4 AS c2, en * 13 % 9000 AS s2, en * 13 % 9000 + ln * 7 AS e2 FROM alns WHERE read_id % 3 = 0)"
_UNION = "SELECT {k}, CAST(sum(greatest(en - greatest(st, coalesce(b, st)), 0)) AS BIGINT) AS covered, max(en) - min(st) AS span FROM (SELECT *, max(en) OVER (PARTITION BY {k} ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM alns) GROUP BY {k}"

QUERIES = {
    "interval_union_cover": lambda s, d: I.union_length(alns(s, d), ["read_id"]),
    "cover_semi": lambda s, d: alns(s, d).join(I.mostly_covered(alns(s, d), ["read_id"]), "read_id", "left_semi").select("read_id", "st", "en", "ln"),
    "cover_anti": lambda s, d: alns(s, d).join(I.mostly_covered(alns(s, d), ["read_id"]), "read_id", "left_anti").select("read_id", "st", "en", "ln"),
    "cover_matrix": lambda s, d: I.union_length(alns(s, d), ["contig", "ln"]),
    "containment_fold": lambda s, d: I.keep_outer(alns(s, d), ["read_id"]),
    "containment_anti": lambda s, d: I.not_contained(alns(s, d).select("read_id", "contig", "st", "en", "ln"), ["read_id"]),
    "repeat_depth_sweep": lambda s, d: I.depth(alns(s, d), ["contig"]),
    "pair_dedup": lambda s, d: I.pair_dedup(_pairs(s, d).select("c1", "c2", (F.col("s1") % 40).alias("s1"), (F.col("s2") % 40).alias("s2"), "score"), ["c1", "s1"], ["c2", "s2"], "score").select(F.col("lo.f0").alias("a_contig"), F.col("lo.f1").alias("a_start"), F.col("hi.f0").alias("b_contig"), F.col("hi.f1").alias("b_start"), "score", "n"),
    "repeat_filter": lambda s, d: I.repeats(_pairs(s, d), _contigs(s, d), 300).select("read_id", "c1", "s1", "m1", "c2", "s2", "m2"),
    "dotplot_repeat_filter": lambda s, d: I.repeats(_pairs(s, d), _contigs(s, d), 300, one_way=True).select("read_id", "c1", "s1", "m1", "c2", "s2", "m2"),
    "long_aln_annotate": lambda s, d: I.long_alignments(_pairs(s, d), 400),
    "gene_lookup": lambda s, d: I.in_first_interval(alns(s, d).select("read_id", "ln", "contig", "st"), _genes(s, d), ["contig"], "st", "gene", "ord").select("read_id", "ln", "contig", "st", F.col("found").alias("gene")),
    "cum_score_trim": lambda s, d: I.trim_ends(C.unit_coverage(units(s, d)).withColumn("c", F.col("cov") * (F.col("unit") % 50)), "contig", "unit", "c", F.lit(700)),
    "contained_in_repeat": lambda s, d: R.in_repeats(alns(s, d), _repeats(s, d)).select("read_id", "contig", "st", "en").distinct(),
    "not_in_repeat": lambda s, d: R.not_in_repeats(alns(s, d), _repeats(s, d), ["read_id", "ln", "contig", "st", "en"]).select("read_id", "ln", "contig", "st", "en"),
    "repeat_trimming": lambda s, d: R.trimmed(alns(s, d).select("read_id", "ln", "contig", "st", "en"), _repeats(s, d), ["read_id", "ln", "contig", "st", "en"]),
    "pair_containment": lambda s, d: R.not_in_other_pairs(_keyed(s, d)).select("key"),
    "split_counts": lambda s, d: R.region_pair_counts(_spans(s), units(s, d)),
    "far_regions": lambda s, d: R.far_from_pairs(units(s, d).select("contig", F.expr("unit div 4 * 4").alias("start"), F.expr("unit div 4 * 4 + 3").alias("end")).distinct(), _spans(s)),
    "boundary_reads": lambda s, d: R.boundary_reads(units(s, d), _spans(s)),
    "aligned_bases": lambda s, d: R.sequences_of(alns(s, d).select((F.col("read_id") % 100).alias("read_id"), "contig", (F.col("st") % 50).alias("st"), (F.col("st") % 50 + F.col("ln") * 4).alias("en")).distinct(), reads(s, d), _contigs(s, d)),
    "score_filter": lambda s, d: alns(s, d).filter("score >= 30000").select("read_id", "ln", "score"),
    "evalue_filter": lambda s, d: alns(s, d).withColumn("evalue", F.pow(F.lit(10.0), -F.col("ln") * 12)).filter(F.col("evalue") < 0.1**50).select("read_id", "ln"),
    "full_repeats": lambda s, d: I.repeats(_pairs(s, d), _contigs(s, d).withColumn("length", F.lit(1 << 40)), -1).select("read_id", "c1", "s1", "m1", "c2", "s2", "m2"),
    "name_remap": lambda s, d: alns(s, d).groupBy("contig").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(s.createDataFrame([(0, "mt0"), (2, "mt2")], "contig long, name string")), "contig", "left").select(F.coalesce("name", F.concat(F.lit("c"), F.col("contig").cast("string"))).alias("name"), "n"),
    "position_ranges": lambda s, d: alns(s, d).filter("(50 < st and st < 80) or (120 < st and st < 160)").filter("score < 20000").select("read_id", "ln", "st"),
    "natural_order": lambda s, d: alns(s, d).select(F.concat_ws("_", "contig", "ln").alias("name")).distinct().select("name", N.natural_parts(F.col("name")).alias("p")).select("name", F.col("p.a").alias("a"), F.col("p.b").alias("b")),
    "unit_indices": lambda s, d: alns(s, d).select("read_id", "ln", F.expr("st div 100").alias("first"), F.expr("en div 100").alias("last"), N.last_unit(F.col("en")).alias("last_whole"), N.short_count(F.col("score")).alias("short")),
    "votes_of_two": lambda s, d: _two(s, d).groupBy("read_id").agg(*(f(F.col("l1"), F.col("l2")).alias(k) for k, f in N.VOTES.items())),
    "log_sums": lambda s, d: _two(s, d).groupBy("read_id").agg(F.collect_list("l1").alias("xs"), F.max("l1").alias("a"), F.min("l2").alias("b")).select("read_id", F.round(N.log_sum_exp(F.col("xs")), 6).alias("lse"), F.round(N.log_add(F.col("a"), F.lit(0.3), F.col("b"), F.lit(0.7)), 6).alias("mix")),
    "region_union": lambda s, d: units(s, d).filter("unit < 5").select("contig", "unit").distinct().withColumn("kind", F.lit("CP")).unionByName(units(s, d).filter("unit > 94").select("contig", "unit").distinct().withColumn("kind", F.lit("CR"))),
    "read_set_ops": lambda s, d: _sets(s, d),
    "breakdown": lambda s, d: units(s, d).filter("unit in (10, 20, 30)").groupBy("contig").agg(F.countDistinct("read_id").alias("in_any")).join(units(s, d).filter("unit in (10, 20, 30)").groupBy("contig", "read_id").agg(F.countDistinct("unit").alias("k")).groupBy("contig").agg(F.count_if(F.expr("k = 3")).alias("in_all")), "contig"),
    "two_range_reads": lambda s, d: units(s, d).groupBy("read_id").agg(F.bool_or(F.expr("contig = 0 and unit between 10 and 12")).alias("a"), F.bool_or(F.expr("contig = 1 and unit between 50 and 52")).alias("b")).filter("a and b").select("read_id"),
}


def _sets(s, d):
    a, b, c = (units(s, d).filter(f"contig = {k} and unit < 40").select("read_id").distinct() for k in range(3))
    out = [a.union(b).distinct().withColumn("op", F.lit("union")), a.intersect(b).withColumn("op", F.lit("intersect")), a.subtract(c).withColumn("op", F.lit("except"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


_REPEATS = "SELECT read_id, c1, s1, m1, c2, s2, m2 FROM p JOIN k x ON x.c = c1 JOIN k y ON y.c = c2 WHERE m1 > 300 AND m2 > 300 AND m1 < x.l AND m2 < y.l"
_GENES = "g AS (SELECT p_partkey % 4 AS contig, p_partkey * 7 % 2000 AS start, p_partkey * 7 % 2000 + p_size * 10 AS e, p_name AS gene, p_partkey AS ord FROM part)"
_K = "k(c, l) AS (VALUES (0, 450), (1, 480), (2, 500))"
_COVERED = f"m AS (SELECT read_id FROM ({_UNION.format(k='read_id')}) WHERE covered * 10 > span * 8)"

ORACLES = {
    "not_in_repeat": f"WITH {ALNS_SQL}, {{g}} SELECT read_id, ln, contig, st, en FROM alns a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.contig = a.contig AND g.start < a.st AND a.en < g.e)".replace("{g}", _GENES),
    "repeat_trimming": f"""WITH {ALNS_SQL}, {{g}}, h AS (SELECT a.read_id, a.ln, a.contig, a.st, a.en, (SELECT arg_min(g.start, g.ord) FROM g WHERE g.contig = a.contig AND greatest(g.start, 200) - 200 <= a.st AND a.en <= g.e + 200) AS rs FROM alns a),
      k AS (SELECT *, greatest(rs, 550) - 550 AS p1, greatest(greatest(rs, 550) - 550, 550) - 550 AS p2 FROM h)
      SELECT a.read_id, a.ln, a.contig, a.st, a.en FROM k a WHERE rs IS NULL OR EXISTS (SELECT 1 FROM alns b WHERE b.read_id = a.read_id AND ((b.st < p1 AND p1 < b.en) OR (b.st < p2 AND p2 < b.en)))""".replace("{g}", _GENES),
    "pair_containment": f"""WITH {ALNS_SQL}, {_KEYED}, sd AS (SELECT key, c1 AS c, s1 AS s, e1 AS e FROM kp UNION ALL SELECT key, c2, s2, e2 FROM kp)
      SELECT key FROM kp WHERE key NOT IN (SELECT x.key FROM sd x JOIN sd y ON x.c = y.c AND x.key <> y.key AND y.s <= x.s AND x.e <= y.e)""",
    "split_counts": f"""WITH {UNITS_SQL}, {_SPANS}, h AS (SELECT DISTINCT read_id, region, contig, "start" AS a, "end" AS b FROM units JOIN sp USING (contig) WHERE unit >= "start" AND unit < "end")
      SELECT x.contig, x.a AS a_start, x.b AS a_end, y.a AS b_start, y.b AS b_end, count(*) AS n FROM h x JOIN h y ON x.read_id = y.read_id AND x.contig = y.contig AND x.region < y.region GROUP BY ALL""",
    "far_regions": f"""WITH {UNITS_SQL}, {_SPANS}, r AS (SELECT DISTINCT contig, unit // 4 * 4 AS s, unit // 4 * 4 + 3 AS e FROM units) SELECT contig, s AS "start", e AS "end" FROM r WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.contig = r.contig AND s - 4 < sp."end" AND sp."start" < e + 4)""",
    "boundary_reads": f"""WITH {UNITS_SQL}, {_SPANS} SELECT DISTINCT region, read_id FROM units JOIN sp USING (contig) WHERE unit = "start" OR unit = "end" - 1""",
    "aligned_bases": f"WITH {ALNS_SQL}, {READS_SQL}, x AS (SELECT DISTINCT read_id % 100 AS read_id, contig, st % 50 AS st, st % 50 + ln * 4 AS en FROM alns WHERE contig < 3) SELECT x.*, substr(seq, CAST(st + 1 AS INT), CAST(en - st AS INT)) AS bases FROM x JOIN reads USING (read_id)",
    "score_filter": f"WITH {ALNS_SQL} SELECT read_id, ln, score FROM alns WHERE score >= 30000",
    "evalue_filter": f"WITH {ALNS_SQL} SELECT read_id, ln FROM alns WHERE ln >= 5",
    "full_repeats": f"{_PAIRS} SELECT read_id, c1, s1, m1, c2, s2, m2 FROM p WHERE c1 < 3 AND c2 < 3",
    "name_remap": f"WITH {ALNS_SQL} SELECT CASE contig WHEN 0 THEN 'mt0' WHEN 2 THEN 'mt2' ELSE 'c' || contig END AS name, count(*) AS n FROM alns GROUP BY 1",
    "position_ranges": f"WITH {ALNS_SQL} SELECT read_id, ln, st FROM alns WHERE (st BETWEEN 51 AND 79 OR st BETWEEN 121 AND 159) AND score < 20000",
    "natural_order": f"WITH {ALNS_SQL} SELECT DISTINCT contig || '_' || ln AS name, contig AS a, ln AS b FROM alns",
    "unit_indices": f"WITH {ALNS_SQL} SELECT read_id, ln, st // 100 AS \"first\", en // 100 AS \"last\", en // 100 - 1 AS last_whole, CASE WHEN score >= 1000 THEN (score // 1000) || 'k' ELSE CAST(score AS VARCHAR) END AS short FROM alns",
    "votes_of_two": f"WITH {ALNS_SQL}, {_TWO} SELECT read_id, CASE WHEN round(sum(l1 - l2), 9) >= 0 THEN 0 ELSE 1 END AS naive, CASE WHEN 2 * count(*) FILTER (l1 > l2) >= count(*) THEN 0 ELSE 1 END AS independent, CASE WHEN round(sum(e * (l1 - l2)), 9) >= 0 THEN 0 ELSE 1 END AS sol, CASE WHEN round(sum(e * (w1 - w2)), 9) >= 0 THEN 0 ELSE 1 END AS sow FROM ent GROUP BY 1",
    "log_sums": f"WITH {ALNS_SQL}, {_TWO} SELECT read_id, round(ln(sum(exp(l1))), 6) AS lse, round(ln(0.3 * exp(max(l1)) + 0.7 * exp(min(l2))), 6) AS mix FROM tw GROUP BY 1",
    "interval_union_cover": f"WITH {ALNS_SQL} {_UNION.format(k='read_id')}",
    "cover_semi": f"WITH {ALNS_SQL}, {_COVERED} SELECT read_id, st, en, ln FROM alns WHERE read_id IN (SELECT read_id FROM m)",
    "cover_anti": f"WITH {ALNS_SQL}, {_COVERED} SELECT read_id, st, en, ln FROM alns WHERE read_id NOT IN (SELECT read_id FROM m)",
    "cover_matrix": f"WITH {ALNS_SQL} {_UNION.format(k='contig, ln')}",
    "containment_fold": f"""WITH RECURSIVE {ALNS_SQL}, o AS (SELECT read_id, st, en, score, row_number() OVER (PARTITION BY read_id ORDER BY st, en DESC, score DESC) AS k FROM alns),
    r AS (SELECT read_id, k, st, en, score, en AS last, true AS kept FROM o WHERE k = 1
      UNION ALL SELECT o.read_id, o.k, o.st, o.en, o.score, CASE WHEN o.en > r.last + 1 THEN o.en ELSE r.last END, o.en > r.last + 1 FROM r JOIN o ON o.read_id = r.read_id AND o.k = r.k + 1)
    SELECT read_id, st, en, score FROM r WHERE kept""",
    "containment_anti": f"WITH {ALNS_SQL} SELECT read_id, contig, st, en, ln FROM alns a WHERE NOT EXISTS (SELECT 1 FROM alns b WHERE b.read_id = a.read_id AND b.st < a.st AND b.en > a.en)",
    "repeat_depth_sweep": f"""WITH {ALNS_SQL}, d AS (SELECT contig, x, sum(d) AS d FROM (SELECT contig, st AS x, 1 AS d FROM alns UNION ALL SELECT contig, en, -1 FROM alns) GROUP BY ALL)
    SELECT contig, x AS "at", CAST(sum(d) OVER (PARTITION BY contig ORDER BY x) AS BIGINT) AS depth FROM d""",
    "pair_dedup": f"""{_PAIRS}, q AS (SELECT c1 AS x0, s1 % 40 AS x1, c2 AS y0, s2 % 40 AS y1, score FROM p), o AS (SELECT *, (x0 < y0 OR (x0 = y0 AND x1 <= y1)) AS f FROM q)
    SELECT CASE WHEN f THEN x0 ELSE y0 END AS a_contig, CASE WHEN f THEN x1 ELSE y1 END AS a_start, CASE WHEN f THEN y0 ELSE x0 END AS b_contig, CASE WHEN f THEN y1 ELSE x1 END AS b_start, min(score) AS score, count(*) AS n FROM o GROUP BY 1, 2, 3, 4""",
    "repeat_filter": f"{_PAIRS}, {_K} {_REPEATS}",
    "dotplot_repeat_filter": f"{_PAIRS}, {_K} {_REPEATS} AND s1 < s2",
    "long_aln_annotate": f"{_PAIRS} SELECT read_id, c1, s1, s1 + m1 AS e1, CASE WHEN fwd THEN s2 ELSE s2 + m2 END AS q_start, CASE WHEN fwd THEN s2 + m2 ELSE s2 END AS q_end FROM p WHERE (m1 + m2) // 2 > 400",
    "gene_lookup": f"WITH {ALNS_SQL}, {_GENES}, h AS (SELECT contig, st, arg_min(gene, ord) AS gene FROM (SELECT DISTINCT contig, st FROM alns) a JOIN g USING (contig) WHERE st BETWEEN start AND e GROUP BY ALL) SELECT read_id, ln, contig, st, gene FROM alns LEFT JOIN h USING (contig, st)",
    "cum_score_trim": f"""WITH {UNITS_SQL}, spine AS (SELECT contig, CAST(unnest(range(0, mx + 1)) AS BIGINT) AS unit FROM (SELECT contig, max(unit) AS mx FROM units GROUP BY contig)),
    n AS (SELECT contig, unit, count(*) AS n FROM units GROUP BY ALL), c AS (SELECT contig, unit, CASE WHEN coalesce(n, 0) * (unit % 50) < 700 THEN 1 ELSE -1 END AS s FROM spine LEFT JOIN n USING (contig, unit)),
    b AS (SELECT *, sum(s) OVER (PARTITION BY contig ORDER BY unit) AS h, sum(s) OVER (PARTITION BY contig ORDER BY unit DESC) AS t FROM c),
    a AS (SELECT contig, unit, h, row_number() OVER (PARTITION BY contig ORDER BY h DESC, unit DESC) AS k, max(unit) OVER (PARTITION BY contig) AS last FROM b),
    st AS (SELECT contig, last, CASE WHEN h < 0 THEN 0 ELSE unit END AS start FROM a WHERE k = 1),
    z AS (SELECT contig, start, last, unit, t, row_number() OVER (PARTITION BY contig ORDER BY t DESC, unit DESC) AS k FROM b JOIN st USING (contig) WHERE unit >= start)
    SELECT contig, start, CASE WHEN t < 0 THEN last + 1 ELSE unit END AS stop FROM z WHERE k = 1""",
    "contained_in_repeat": f"WITH {ALNS_SQL}, {_GENES} SELECT DISTINCT read_id, a.contig, st, en FROM alns a JOIN g ON g.contig = a.contig AND g.start < st AND en < e",
    "region_union": f"WITH {UNITS_SQL} SELECT DISTINCT contig, unit, 'CP' AS kind FROM units WHERE unit < 5 UNION ALL SELECT DISTINCT contig, unit, 'CR' FROM units WHERE unit > 94",
    "read_set_ops": f"""WITH {UNITS_SQL}, a AS (SELECT DISTINCT read_id FROM units WHERE contig = 0 AND unit < 40), b AS (SELECT DISTINCT read_id FROM units WHERE contig = 1 AND unit < 40), c AS (SELECT DISTINCT read_id FROM units WHERE contig = 2 AND unit < 40)
    SELECT read_id, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT read_id, 'intersect' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT read_id, 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM c)""",
    "breakdown": f"""WITH {UNITS_SQL}, k AS (SELECT contig, read_id, count(DISTINCT unit) AS k FROM units WHERE unit IN (10, 20, 30) GROUP BY ALL) SELECT contig, count(*) AS in_any, count(*) FILTER (k = 3) AS in_all FROM k GROUP BY contig""",
    "two_range_reads": f"WITH {UNITS_SQL} SELECT read_id FROM units GROUP BY 1 HAVING bool_or(contig = 0 AND unit BETWEEN 10 AND 12) AND bool_or(contig = 1 AND unit BETWEEN 50 AND 52)",
}
