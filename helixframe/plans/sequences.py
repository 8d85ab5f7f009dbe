"""Queries over the reads and votes views."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import numbers as N
from helixframe.functions import sequences as S
from helixframe.operators import calling as G
from helixframe.operators import clusters as K
from helixframe.operators import generators as GEN
from helixframe.operators import variants as V
from helixframe.plans.adapters import READS_SQL, UNITS_SQL, VOTES_SQL, reads, units, votes



def _bases(s, d):
    return V.bases_of(reads(s, d))


def _gapped(s, d):
    """Gapped pairs as texts: the reads beside themselves shifted through the alphabet, gaps at W and F."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("read_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("t"))
    letters = "BDEFHIJKLMNOPQRSUVWXYZ"
    side = lambda gap, other: F.translate("t", letters, "".join("-" if x == gap else y for x, y in zip(letters, other, strict=True)))
    return docs.select("read_id", side("W", "ACGTACGTACGTACGTACGTAC").alias("r"), side("F", "ACGTACGTACGTACGTACGTCA").alias("q"))


def _pairs(s, d):
    """Their columns."""
    both = F.arrays_zip(F.filter(F.split("r", ""), lambda x: x != "").alias("r"), F.filter(F.split("q", ""), lambda x: x != "").alias("q"))
    return _gapped(s, d).select("read_id", F.posexplode(both).alias("pos", "x")).select("read_id", F.col("pos").cast("long").alias("pos"), "x.r", "x.q")


_B = f"WITH {READS_SQL}, b AS (SELECT read_id, CAST(unnest(range(0, length(seq))) AS BIGINT) AS pos, unnest(string_split(seq, '')) AS base FROM reads WHERE length(seq) > 0)"
_P = f"""{_B}, p AS (SELECT pos, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM b GROUP BY pos),
  k AS (SELECT pos, a, c, g, t, a + c + g + t AS total, list_reverse_sort([{{'n': a, 'i': 0}}, {{'n': c, 'i': 1}}, {{'n': g, 'i': 2}}, {{'n': t, 'i': 3}}]) AS r FROM p)"""
_M = f"{_P}, m AS (SELECT pos, substr('ACGT', r[1].i + 1, 1) AS major, substr('ACGT', r[2].i + 1, 1) AS minor, r[2].n AS n_minor, total, r[2].n / total AS maf FROM k)"
_C = f"{_M}, s AS (SELECT * FROM m WHERE maf > 0.15 + 8.0 * sqrt(CAST(0.15 AS DOUBLE) * 0.85 / total))"
_G = """g AS (SELECT read_id, pos, CASE WHEN x = 'W' THEN '-' ELSE translate(x, 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') END AS r,
  CASE WHEN x = 'F' THEN '-' ELSE translate(x, 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTCA') END AS q FROM (
  SELECT doc_id AS read_id, CAST(unnest(range(0, length(t))) AS BIGINT) AS pos, unnest(string_split(t, '')) AS x FROM (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS t FROM documents) WHERE length(t) > 0))"""
_KIND = "CASE WHEN r = '-' THEN 'I' WHEN q = '-' THEN 'D' WHEN r <> q THEN 'X' ELSE 'M' END"
_RUNS = "SELECT pos, count(*) AS n FROM (SELECT *, lag({c}) OVER (PARTITION BY read_id ORDER BY pos) AS b FROM g) WHERE {c} = '-' AND b IS DISTINCT FROM '-' GROUP BY pos"


def _sites(s, d):
    return V.call_variants(V.pileup_of(reads(s, d)), 0.15)


def _pair_sites(s, d):
    """Pairs over events: reads of units, a read has the minor allele of a unit where pos is a multiple of 3."""
    at = units(s, d).filter("contig = 0").groupBy("read_id", F.col("unit").alias("pos")).agg(F.max(F.expr("if(pos % 3 = 0, 'A', 'C')")).alias("base"))
    return V.variant_pairs(at, at.select("pos").distinct().withColumn("minor", F.lit("A")))


_PAIRSITES = f"""WITH {UNITS_SQL}, v AS (SELECT read_id, unit AS pos, max(CASE WHEN pos % 3 = 0 THEN 'A' ELSE 'C' END) = 'A' AS m FROM units WHERE contig = 0 GROUP BY ALL),
  pr AS (SELECT a.pos AS pos1, b.pos AS pos2, count(*) AS tot, count(*) FILTER (a.m) AS mac1, count(*) FILTER (b.m) AS mac2, count(*) FILTER (a.m AND b.m) AS share FROM v a JOIN v b ON a.read_id = b.read_id AND a.pos < b.pos GROUP BY ALL HAVING count(*) FILTER (a.m AND b.m) > 3)"""

QUERIES = {
    "base_freq": lambda s, d: reads(s, d).agg(*((F.sum(S.base_count(F.col("seq"), b)) / F.sum(F.length("seq"))).alias(f"f_{b.lower()}") for b in "ACGT"), F.sum(F.length("seq")).alias("n")),
    "revcomp": lambda s, d: reads(s, d).select("read_id", S.reverse_complement(F.col("seq")).alias("rc")),
    "kmer_entropy": lambda s, d: reads(s, d).select("read_id", F.round(S.kmer_entropy(F.col("seq")), 6).alias("h6"), F.length("seq").alias("len")).filter("h6 > 7.0 and len > 1000").select("read_id", "h6"),
    "pileup": lambda s, d: V.pileup_of(reads(s, d)),
    "minor_allele": lambda s, d: V.minor_alleles(V.pileup_of(reads(s, d))),
    "variant_call": _sites,
    "majority_variants": lambda s, d: V.majority_variants(V.pileup_of(reads(s, d)), 0.4, 10),
    "indel_runs": lambda s, d: V.gap_runs_of(_gapped(s, d), "q"),
    "unpivot_divergence": lambda s, d: V.divergence(V.pileup_of(reads(s, d)), V.gap_runs_of(_gapped(s, d), "r"), V.gap_runs_of(_gapped(s, d), "q")).withColumn("ErrorRate", F.round("ErrorRate", 9)),
    "error_rate": lambda s, d: V.error_rates(_pairs(s, d)),
    "error_profile": lambda s, d: V.transitions_of(_gapped(s, d)).filter("next is not null"),
    "error_model": lambda s, d: G.error_model(V.transitions_of(_gapped(s, d)), _gapped(s, d).filter("r <> ''").count()),
    "six_channels": lambda s, d: G.six_channels(_aligned(s, d)),
    "long_read_calls": lambda s, d: G.long_read_calls(G.six_channels(_aligned(s, d)), _references(s), 0.3, 10),
    "match_lines": lambda s, d: G.match_lines(_pairs(s, d)),
    "covered_columns": lambda s, d: G.covered_columns(_pairs(s, d)),
    "reference_columns": lambda s, d: G.reference_columns(_pairs(s, d).filter("pos < 40")),
    "coverage_mask": lambda s, d: G.masked(_bases(s, d).select(F.col("read_id").alias("contig"), "pos", "base"), _bases(s, d).filter("base = 'A' and pos % 2 = 0").select(F.col("read_id").alias("contig"), "pos", F.lit(2).alias("n"))),
    "deepest_stretch": lambda s, d: G.deepest_stretch(units(s, d).groupBy("contig", F.expr("unit div 8 * 8").alias("start")).agg(F.max("pos").alias("peak"), (F.max("unit") + 1).alias("end"))),
    "entropy_band": lambda s, d: reads(s, d).select("read_id", S.kmer_entropy(F.col("seq")).alias("h6")).filter("h6 > 8 and h6 < 9").select("read_id", F.round("h6", 6).alias("h6")),
    "well_names": lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select(F.concat_ws("/", "conv_id", "role", "turn").alias("name")).select("name", N.well_of(F.col("name")).alias("well")),
    "mock_genome": lambda s, d: GEN.looped_genome(s, 4, 60, 5, 0.2),
    "mutated": lambda s, d: GEN.mutated(reads(s, d).select("read_id", F.substring("seq", 1, 80).alias("seq")), 9, 0.02, 0.03, 0.03),
    "labelled_reads": lambda s, d: GEN.labelled_reads(s, 12, 3, 40, 2, 0.1),
    "variant_pairs": _pair_sites,
    "cooccurrence_pvalue": lambda s, d: V.cooccurrence(_pair_sites(s, d)).select("pos1", "pos2", F.round("mlp", 6).alias("mlp")),
    "edit_distance": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("dist")),
    "cigar": lambda s, d: _cigars(s, d).select("read_id", "ln", S.alignment_length(F.col("ops")).alias("len"), F.size("ops").cast("long").alias("n_ops"), F.array_join(F.transform("ops", lambda x: F.concat(x["op"], x["len"].cast("string"))), "").alias("ops")),
    "well_longest": lambda s, d: K.longest_of_session(s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.expr("turn div 2").alias("well"), F.length("text").cast("long").alias("len")), "conv_id", "turn", "well", "len"),
    "cluster_vote": lambda s, d: K.vote(votes(s, d), "cluster", "truth"),
    "label_default": lambda s, d: K.with_default(votes(s, d), "truth").select("read_id", "cluster", "truth"),
    "dense_cluster_rename": lambda s, d: K.dense_rename(votes(s, d).withColumn("cluster", F.col("cluster") * 7 % 11), "cluster").select("read_id", "cluster", "new"),
    "forbidden_having": lambda s, d: K.frequent_labels(votes(s, d), "cluster", "truth", 2),
    "confusion_accuracy": lambda s, d: K.confusion(votes(s, d).select((F.col("truth") >= 2).cast("int").alias("a"), (F.col("cluster") % 2).alias("b")), "a", "b"),
    "cluster_fraction": lambda s, d: K.fractions(votes(s, d), ["win"], "cluster"),
    "consensus_mode": lambda s, d: K.vote(units(s, d).withColumn("v", F.expr("unit % 11")), "pos", "v"),
    "top_quantile": lambda s, d: K.quantile_cut(votes(s, d).withColumn("w", F.expr("read_id * 7919 % 1009")), "cluster", "w", "read_id", 95, 2),
    "mean_sd": lambda s, d: votes(s, d).groupBy("cluster").agg(F.round(F.avg("win"), 9).alias("mean"), F.round(F.stddev_samp("win"), 9).alias("sd"), F.percentile("win", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))[1].alias("median")),
    "histogram": lambda s, d: reads(s, d).groupBy(F.floor(F.length("seq") / 500).alias("bin")).agg(F.count(F.lit(1)).alias("n")),
    "cluster_bucket": lambda s, d: votes(s, d).join(F.broadcast(votes(s, d).agg(F.max("truth").alias("mx")))).select("read_id", F.coalesce("truth", F.col("mx") + 1).alias("bucket")),
}


_LENGTHS = "(read_id % 7 + 5)"


def _aligned(s, d):
    """The first bases of reads against two references: matches, a deletion, an insertion, matches again."""
    k = F.col("read_id")
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("long").alias("len"))
    ops = F.array(op("S", F.lit(2)), op("M", k % 7 + 5), op("D", k % 3), op("I", F.lit(2)), op("M", F.lit(10)))
    return reads(s, d).filter("length(seq) >= 40").select((k % 2).alias("contig"), (k % 5).alias("start"), ops.alias("ops"), "seq")


def _references(s):
    at = s.range(40).select(F.col("id").alias("pos"))
    return at.select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("contig"), "pos").withColumn("ref", F.substring(F.lit("aCGT"), ((F.col("pos") + F.col("contig")) % 4 + 1).cast("int"), F.lit(1)))


_SIX = f"""WITH {READS_SQL}, al AS (SELECT read_id, read_id % 2 AS contig, read_id % 5 AS st, seq, read_id % 7 + 5 AS m, read_id % 3 AS dl FROM reads WHERE length(seq) >= 40),
  ev AS (SELECT contig, st + i AS pos, substr(seq, CAST(3 + i AS INT), 1) AS ch FROM (SELECT *, unnest(range(0, m)) AS i FROM al)
    UNION ALL SELECT contig, st + m + i, 'del' FROM (SELECT *, unnest(range(0, dl)) AS i FROM al)
    UNION ALL SELECT contig, st + m + dl + i, 'ins' FROM (SELECT *, unnest(range(0, 2)) AS i FROM al)
    UNION ALL SELECT contig, st + m + dl + i, substr(seq, CAST(5 + m + i AS INT), 1) FROM (SELECT *, unnest(range(0, 10)) AS i FROM al)),
  six AS (SELECT contig, pos, count(*) FILTER (ch = 'A') AS a, count(*) FILTER (ch = 'C') AS c, count(*) FILTER (ch = 'G') AS g, count(*) FILTER (ch = 'T') AS t, count(*) FILTER (ch = 'ins') AS ins, count(*) FILTER (ch = 'del') AS del FROM ev GROUP BY ALL)"""
_STEPS = f"""WITH {_G}, o AS (SELECT read_id, {_KIND} AS op, lead({_KIND}) OVER (PARTITION BY read_id ORDER BY pos) AS nx FROM g),
  n AS (SELECT count(*) FILTER (op IN ('M', 'X')) AS mm, count(*) FILTER (op = 'X') AS x, count(*) FILTER (op = 'I') AS i, count(*) FILTER (op = 'D') AS d, count(DISTINCT read_id) AS k,
    count(*) FILTER (op IN ('M', 'X') AND nx IN ('M', 'X')) AS mm_mm, count(*) FILTER (op IN ('M', 'X') AND nx = 'I') AS mm_i, count(*) FILTER (op IN ('M', 'X') AND nx = 'D') AS mm_d,
    count(*) FILTER (op = 'I' AND nx = 'I') AS i_i, count(*) FILTER (op = 'D' AND nx = 'D') AS d_d, count(*) FILTER (op = 'D' AND nx = 'I') AS d_i FROM o)"""


def _cigars(s, d):
    l = s.read.parquet(f"{d}/lineitem.parquet")  # noqa: E741
    q, k = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    text = F.concat_ws(",", q.cast("string"), F.concat((k % 3).cast("string"), F.lit(":"), (q % 4).cast("string")), (q + k).cast("string"), F.concat(F.lit("0:"), k.cast("string")), k.cast("string"))
    return l.select(F.col("l_orderkey").alias("read_id"), k.alias("ln"), S.parse_cigar(text).alias("ops"))


ORACLES = {
    "error_model": f"{_STEPS} SELECT x / mm AS mismatch, mm_mm / (mm - k) AS p_match, mm_i / (mm - k) AS p_ins, mm_d / (mm - k) AS p_del, i_i / i AS p_extend_ins, d_d / d AS p_extend_del, d_i / d AS p_del_to_ins FROM n",
    "six_channels": f"{_SIX} SELECT * FROM six",
    "long_read_calls": f"""{_SIX}, r AS (SELECT *, a + c + g + t AS depth, greatest(a, c, g, t) AS mx, substr('aCGT', CAST((pos + contig) % 4 + 1 AS INT), 1) AS ref FROM six WHERE a + c + g + t > 10),
      b AS (SELECT *, CASE WHEN t = mx THEN 'T' WHEN g = mx THEN 'G' WHEN c = mx THEN 'C' ELSE 'A' END AS alt FROM r)
      SELECT contig, pos, depth, mx AS n, ref, alt FROM b WHERE upper(ref) <> alt AND mx > depth * 0.3 UNION ALL SELECT contig, pos, depth, ins, '-', 'I' FROM b WHERE ins > depth * 0.3 UNION ALL SELECT contig, pos, depth, del, '-', 'D' FROM b WHERE del > depth * 0.3""",
    "match_lines": f"WITH {_G} SELECT read_id, string_agg(r, '' ORDER BY pos) AS ref, string_agg(CASE WHEN r = '-' OR q = '-' THEN ' ' WHEN r = q THEN '|' ELSE 'X' END, '' ORDER BY pos) AS line, string_agg(q, '' ORDER BY pos) AS query FROM g GROUP BY 1",
    "covered_columns": f"WITH {_G} SELECT pos, count(*) AS cov FROM g WHERE q <> '-' GROUP BY 1",
    "reference_columns": f"WITH {_G} SELECT read_id, pos, r, q FROM g WHERE r <> '-' AND pos < 40",
    "coverage_mask": f"{_B} SELECT read_id AS contig, string_agg(CASE WHEN base = 'A' AND pos % 2 = 0 THEN 'a' ELSE base END, '' ORDER BY pos) AS seq FROM b GROUP BY 1",
    "deepest_stretch": f"""WITH {UNITS_SQL}, x AS (SELECT contig, unit // 8 * 8 AS s, max(pos) AS peak, max(unit) + 1 AS e FROM units GROUP BY ALL)
      SELECT contig, s AS start, e AS "end", peak FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY peak DESC, e - s DESC, s) AS k FROM x) WHERE k = 1""",
    "entropy_band": f"""WITH {READS_SQL}, k AS (SELECT read_id, substr(seq, CAST(i AS BIGINT), 6) AS k FROM (SELECT read_id, seq, unnest(range(1, length(seq) - 4)) AS i FROM reads WHERE length(seq) > 5)),
      c AS (SELECT read_id, k, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT read_id, n / sum(n) OVER (PARTITION BY read_id) AS p FROM c), h AS (SELECT read_id, -sum(p * log2(p)) AS h6 FROM t GROUP BY read_id) SELECT read_id, round(h6, 6) AS h6 FROM h WHERE h6 > 8 AND h6 < 9""",
    "well_names": "SELECT conv_id || '/' || role || '/' || turn AS name, conv_id || '/' || role AS well FROM conversations",
    "mock_genome": """WITH p AS (SELECT unnest(range(0, 240)) AS i), b AS (SELECT i, md5('5:genome:' || i) AS h FROM p), g AS (SELECT i, substr('ACGT', 1 + CAST(ascii(substr(h, 1, 1)) % 4 AS INT), 1) AS base, substr(md5('5:loop:' || i), 1, 8) < '33333333' AS hit, substr('ACGT', 1 + CAST((ascii(substr(h, 1, 1)) + 1 + ascii(substr(md5('5:other:' || i), 1, 1)) % 3) % 4 AS INT), 1) AS other FROM b)
      SELECT 'linear' AS name, string_agg(base, '' ORDER BY i) AS seq FROM g UNION ALL
      SELECT 'looped', string_agg(CASE WHEN hit THEN other ELSE base END, '' ORDER BY CASE i // 60 WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 2 END, i) FROM g WHERE i // 60 <> 1""",
    "mutated": f"""WITH {READS_SQL}, c AS (SELECT read_id, unnest(range(0, least(length(seq), 80))) AS i, seq FROM reads), x AS (SELECT read_id, i, substr(seq, CAST(i + 1 AS INT), 1) AS b, substr(md5('9:kind:' || read_id || ':' || i), 1, 8) AS u, ascii(substr(md5('9:base:' || read_id || ':' || i), 1, 1)) AS o FROM c)
      SELECT r.read_id, coalesce((SELECT string_agg(CASE WHEN u < '051eb851' THEN substr('ACGT', 1 + CAST((strpos('ACGT', b) + o % 3) % 4 AS INT), 1) WHEN u < '0ccccccc' THEN '' WHEN u < '147ae147' THEN substr('ACGT', 1 + CAST(o % 4 AS INT), 1) || b ELSE b END, '' ORDER BY i) FROM x WHERE x.read_id = r.read_id), '') AS seq FROM reads r""",
    "labelled_reads": """WITH t AS (SELECT unnest(range(0, 40)) AS i), b AS (SELECT i, ascii(substr(md5('2:template:' || i), 1, 1)) % 4 AS b FROM t), k AS (SELECT unnest(range(0, 3)) AS label),
      c AS (SELECT label, i, CASE WHEN label > 0 AND substr(md5('2:site:' || label || ':' || i), 1, 8) < '19999999' THEN (b + 1 + ascii(substr(md5('2:alt:' || label || ':' || i), 1, 1)) % 3) % 4 ELSE b END AS b FROM b, k),
      s AS (SELECT label, string_agg(substr('ACGT', 1 + CAST(b AS INT), 1), '' ORDER BY i) AS seq FROM c GROUP BY 1) SELECT r AS read_id, label, seq FROM (SELECT unnest(range(0, 12)) AS r) JOIN s ON s.label = r % 3""",
    "base_freq": f"WITH {READS_SQL} SELECT " + ", ".join(f"sum(length(seq) - length(replace(seq, '{b}', ''))) / sum(length(seq)) AS f_{b.lower()}" for b in "ACGT") + ", CAST(sum(length(seq)) AS BIGINT) AS n FROM reads",
    "revcomp": f"WITH {READS_SQL} SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads",
    "kmer_entropy": f"""WITH {READS_SQL}, k AS (SELECT read_id, substr(seq, CAST(i AS BIGINT), 6) AS k FROM (SELECT read_id, seq, unnest(range(1, length(seq) - 4)) AS i FROM reads WHERE length(seq) > 1000)),
    c AS (SELECT read_id, k, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT read_id, n / sum(n) OVER (PARTITION BY read_id) AS p FROM c), h AS (SELECT read_id, round(-sum(p * log2(p)), 6) AS h6 FROM t GROUP BY read_id)
    SELECT read_id, h6 FROM h WHERE h6 > 7.0""",
    "pileup": f"{_P} SELECT pos, a, c, g, t FROM p",
    "minor_allele": f"{_M} SELECT pos, major, minor, n_minor, total, maf FROM m",
    "variant_call": f"{_C} SELECT pos, major, minor, n_minor, total, maf FROM s",
    "majority_variants": f"{_P} SELECT pos, r[1].n AS count_max, total AS depth, substr('ACGT', r[1].i + 1, 1) AS alt FROM k WHERE total > 10 AND r[1].n > total * CAST(0.4 AS DOUBLE)",
    "indel_runs": f"WITH {_G} {_RUNS.format(c='q')}",
    "unpivot_divergence": f"""{_M}, {_G}, i AS ({_RUNS.format(c='r')}), d AS ({_RUNS.format(c='q')}),
    w AS (SELECT m.pos AS "Pos", total AS "Coverage", maf AS "Sub", coalesce(i.n, 0) / (total + coalesce(i.n, 0)) AS "Ins", coalesce(d.n, 0) / (total + coalesce(d.n, 0)) AS "Del" FROM m LEFT JOIN i USING (pos) LEFT JOIN d USING (pos) WHERE total > 20)
    SELECT "Pos", "Coverage", 'Sub' AS "Type", round("Sub", 9) AS "ErrorRate" FROM w UNION ALL SELECT "Pos", "Coverage", 'Ins', round("Ins", 9) FROM w UNION ALL SELECT "Pos", "Coverage", 'Del', round("Del", 9) FROM w""",
    "error_rate": f"WITH {_G} SELECT count(*) FILTER ({_KIND} = 'X') / count(*) AS mismatch, count(*) FILTER ({_KIND} = 'I') / count(*) AS insertion, count(*) FILTER ({_KIND} = 'D') / count(*) AS deletion FROM g",
    "error_profile": f"WITH {_G}, t AS (SELECT {_KIND} AS op, lead({_KIND}) OVER (PARTITION BY read_id ORDER BY pos) AS next FROM g) SELECT op, next, count(*) AS n FROM t WHERE next IS NOT NULL GROUP BY ALL",
    "variant_pairs": f"{_PAIRSITES} SELECT * FROM pr",
    "cooccurrence_pvalue": f"""{_PAIRSITES}, x AS (SELECT *, unnest(CASE WHEN share < least(mac1, mac2) THEN range(share + 1, least(mac1, mac2) + 1) ELSE [NULL] END) AS x FROM pr),
    l AS (SELECT *, CASE WHEN x IS NOT NULL AND mac1 - x <= tot - mac2 THEN lgamma(mac2 + 1) - lgamma(x + 1) - lgamma(mac2 - x + 1) + lgamma(tot - mac2 + 1) - lgamma(mac1 - x + 1) - lgamma(tot - mac2 - mac1 + x + 1) - lgamma(tot + 1) + lgamma(mac1 + 1) + lgamma(tot - mac1 + 1) END AS lp FROM x)
    SELECT pos1, pos2, round(coalesce(-ln(sum(exp(lp))), 10000.0), 6) AS mlp FROM l GROUP BY pos1, pos2""",
    "edit_distance": "SELECT p_partkey, levenshtein(p_name, p_type) AS dist FROM part",
    "cigar": """WITH o AS (SELECT l_orderkey AS read_id, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS k FROM lineitem)
    SELECT read_id, ln, q + k % 3 + q % 4 + (q + k) + k + k AS len, 4 + CAST(k % 3 > 0 AS BIGINT) + CAST(q % 4 > 0 AS BIGINT) AS n_ops,
      'M' || q || CASE WHEN k % 3 > 0 THEN 'D' || (k % 3) ELSE '' END || CASE WHEN q % 4 > 0 THEN 'I' || (q % 4) ELSE '' END || 'M' || (q + k) || 'I' || k || 'M' || k AS ops FROM o""",
    "well_longest": """WITH c AS (SELECT conv_id, turn, turn // 2 AS well, length(text) AS len FROM conversations), n AS (SELECT *, CASE WHEN lag(well) OVER (PARTITION BY conv_id ORDER BY turn) = well THEN 0 ELSE 1 END AS new FROM c),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY len DESC, turn DESC) AS k FROM r) SELECT conv_id, run, well, len, turn FROM k WHERE k = 1""",
    "cluster_vote": f"WITH {VOTES_SQL}, n AS (SELECT cluster, truth, count(*) AS n FROM votes WHERE truth IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, truth) AS k FROM n) SELECT cluster, truth, n FROM k WHERE k = 1",
    "label_default": f"WITH {VOTES_SQL} SELECT read_id, cluster, coalesce(truth, -1) AS truth FROM votes",
    "dense_cluster_rename": f"WITH {VOTES_SQL} SELECT read_id, cluster * 7 % 11 AS cluster, dense_rank() OVER (ORDER BY cluster * 7 % 11) - 1 AS new FROM votes",
    "forbidden_having": f"WITH {VOTES_SQL} SELECT cluster, truth, count(*) AS n FROM votes WHERE truth IS NOT NULL GROUP BY ALL HAVING count(*) > 2",
    "confusion_accuracy": f"""WITH {VOTES_SQL}, x AS (SELECT CAST(truth >= 2 AS INT) AS a, cluster % 2 AS b FROM votes), c AS (SELECT count(*) FILTER (a = 0 AND b = 0) AS c00, count(*) FILTER (a = 0 AND b = 1) AS c01, count(*) FILTER (a = 1 AND b = 0) AS c10, count(*) FILTER (a = 1 AND b = 1) AS c11 FROM x)
    SELECT *, greatest(c00 + c11, c01 + c10) / (c00 + c01 + c10 + c11) AS accuracy FROM c""",
    "cluster_fraction": f"WITH {VOTES_SQL} SELECT win, cluster, count(*) / sum(count(*)) OVER (PARTITION BY win) AS fraction FROM votes GROUP BY win, cluster",
    "consensus_mode": f"WITH {UNITS_SQL}, n AS (SELECT pos, unit % 11 AS v, count(*) AS n FROM units GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, v) AS k FROM n) SELECT pos, v, n FROM k WHERE k = 1",
    "top_quantile": f"WITH {VOTES_SQL}, k AS (SELECT cluster, read_id * 7919 % 1009 AS w, row_number() OVER (PARTITION BY cluster ORDER BY read_id * 7919 % 1009, read_id) - 1 AS k, count(*) OVER (PARTITION BY cluster) AS n FROM votes) SELECT cluster, w AS thr FROM k WHERE k = greatest(least(n * 95 // 100, n - 2), 0)",
    "mean_sd": f"WITH {VOTES_SQL} SELECT cluster, round(avg(win), 9) AS mean, round(stddev_samp(win), 9) AS sd, quantile_cont(win, 0.5) AS median FROM votes GROUP BY cluster",
    "histogram": f"WITH {READS_SQL} SELECT length(seq) // 500 AS bin, count(*) AS n FROM reads GROUP BY 1",
    "cluster_bucket": f"WITH {VOTES_SQL} SELECT read_id, coalesce(truth, (SELECT max(truth) FROM votes) + 1) AS bucket FROM votes",
}
