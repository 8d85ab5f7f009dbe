"""Queries over reads as runs of units and gaps, and over summaries of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import readunits as U
from helixframe.operators import summaries as Y
from helixframe.plans.adapters import ALNS_SQL, READS_SQL, UNITS_SQL, VOTES_SQL, alns, reads, units, votes


def _chunks(s, d):
    """Units as chunks: every fifth is a gap, odd reads run backwards."""
    u = units(s, d)
    back = F.col("read_id") % 2 == 1
    return u.select("read_id", "pos", (F.col("unit") % 5 == 0).alias("is_gap"), (F.col("read_id") % 3).alias("contig"), F.when(back, 1000 - F.col("pos")).otherwise(F.col("pos")).alias("unit"), (~back).alias("fwd"), F.when(F.col("contig") == 0, F.col("unit") + 70).otherwise(F.col("unit") * 40).alias("n_bases"))


_CHUNKS = f"""WITH {UNITS_SQL}, ch AS (SELECT read_id, pos, unit % 5 = 0 AS is_gap, read_id % 3 AS contig, CASE WHEN read_id % 2 = 1 THEN 1000 - pos ELSE pos END AS unit,
  read_id % 2 = 0 AS fwd, CASE WHEN contig = 0 THEN unit + 70 ELSE unit * 40 END AS n_bases FROM units)"""
_EDGES = f"{_CHUNKS}, e AS (SELECT read_id, arg_min(is_gap, pos) AS hg, arg_min(n_bases, pos) AS hn, arg_max(is_gap, pos) AS tg, arg_max(n_bases, pos) AS tn, bool_and(is_gap) AS only_gap FROM ch GROUP BY read_id)"


def _nodes(s, d):
    """Nodes of reads cut from documents: node i begins at 90 i and is 80 to 100 long."""
    r = reads(s, d).select("read_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("least(length(seq) div 100, 20)"))).alias("pos"))
    return r.select("read_id", "pos", (F.col("pos") * 90).alias("start"), (F.col("pos") * 90 + 80 + (F.col("read_id") + F.col("pos")) % 21).alias("end"))


_NODES = f"""WITH {READS_SQL}, nd AS (SELECT read_id, pos, pos * 90 AS start, pos * 90 + 80 + (read_id + pos) % 21 AS en FROM (SELECT read_id, unnest(range(0, least(length(seq) // 100, 20) + 1)) AS pos FROM reads)),
  ed AS (SELECT read_id, pos, en, nxt - en AS off FROM (SELECT *, lead(start) OVER (PARTITION BY read_id ORDER BY pos) AS nxt FROM nd) WHERE nxt IS NOT NULL)"""


def _regions(s):
    return s.createDataFrame([(0, 0, 10, 30), (1, 1, 40, 45), (2, 2, 80, 99)], "region long, contig long, start long, end long")


_REGIONS = 'rg AS (SELECT * FROM (VALUES (0, 0, 10, 30), (1, 1, 40, 45), (2, 2, 80, 99)) AS v(region, contig, "start", "end"))'


def _clusters(s, d):
    """Customers' nations stand for clusters; three of four users have one."""
    return units(s, d).select("read_id").distinct().filter("read_id % 4 > 0").withColumn("cluster", F.col("read_id") % 7)


_CLUSTERS = "cl AS (SELECT DISTINCT read_id, read_id % 7 AS cluster FROM units WHERE read_id % 4 > 0)"


def _cov(s, d):
    return units(s, d).groupBy("contig", F.col("unit").alias("at")).agg(F.count(F.lit(1)).alias("cov"))


def _scores(s, d):
    a = alns(s, d)
    return a.select("contig", "ln", (F.col("score") % 97 / 97).alias("tp_new"), (F.col("st") % 89 / 89).alias("tn_new"), (F.col("en") % 83 / 83).alias("tp_old"), (F.col("st") % 79 / 79).alias("tn_old"))


def _windows(s, d, k):
    return votes(s, d).filter(f"win % 2 = {k}").select("cluster", (F.col("read_id") % 20).alias("read_id"))


_F = "CASE WHEN {a} + {b} = 0 THEN NULL ELSE 2 * {a} * {b} / ({a} + {b}) END"
_GAIN = f"{_F.format(a='tpn', b='tnn')} - {_F.format(a='tpo', b='tno')}"

QUERIES = {
    "gap_fill": lambda s, d: U.gaps_filled(_chunks(s, d)),
    "clip_flags": lambda s, d: U.clip_flags(_chunks(s, d)),
    "gap_ends": lambda s, d: U.gap_ends(_chunks(s, d)),
    "clone_within": lambda s, d: U.within(units(s, d), 1, 20, 60),
    "touching_reads": lambda s, d: U.touching(units(s, d), 2, 30, 33),
    "selected_within": lambda s, d: U.selected_within(units(s, d).withColumn("contig", F.col("contig") - F.col("contig")), 0, 0, 50),
    "majority_strand": lambda s, d: U.majority_strand(_chunks(s, d).withColumn("fwd", F.col("pos") % 3 > 0), [0, 1, 2]),
    "node_edges": lambda s, d: U.node_edges(_nodes(s, d), reads(s, d)),
    "encoded_metrics": lambda s, d: U.encoded_metrics(_nodes(s, d), U.node_edges(_nodes(s, d), reads(s, d)), reads(s, d)),
    "labels_first": lambda s, d: U.labels_first(units(s, d).select("read_id").distinct(), _clusters(s, d)).select("read_id", "label", F.col("place.unlabelled").alias("unlabelled")),
    "region_predicates": lambda s, d: U.spanning(units(s, d), _regions(s)),
    "position_votes": lambda s, d: Y.position_votes(votes(s, d).select(F.col("win").alias("position"), F.when(F.col("read_id") % 3 > 0, F.col("cluster") * 0 + F.col("win") % 2 + F.when(F.col("read_id") % 11 == 0, 1).otherwise(0)).alias("label")), 5),
    "occupied_clusters": lambda s, d: Y.occupied(units(s, d).withColumn("unit", F.expr("unit div 10 * 10 + read_id % 7")), _clusters(s, d)),
    "low_coverage": lambda s, d: Y.low_coverage(_cov(s, d)),
    "window_fractions": lambda s, d: Y.window_fractions(votes(s, d)),
    "cluster_peaks": lambda s, d: Y.cluster_peaks(units(s, d), _clusters(s, d)),
    "share_over": lambda s, d: Y.share_over(alns(s, d), "score"),
    "five_numbers": lambda s, d: Y.five_numbers(alns(s, d), "contig", "score"),
    "score_gain": lambda s, d: Y.score_gain(_scores(s, d), ["contig", "ln"]),
    "spread_means": lambda s, d: Y.spread_means(alns(s, d).withColumn("strand", F.when(F.col("fwd"), "plus").otherwise("minus")), "contig", "strand", ["plus", "minus"], "score"),
    "replicates": lambda s, d: Y.numbered(alns(s, d).select("read_id", "ln", "contig"), ["contig"], ["read_id", "ln"]),
    "sampled_rows": lambda s, d: Y.sample_rows(alns(s, d).select("read_id", "ln"), 0.01, 7, "read_id", "ln"),
    "sampled_groups": lambda s, d: Y.sample_groups(alns(s, d).select("contig", "read_id", "ln"), ["contig"], 30, 3, "read_id", "ln"),
    "set_overlaps": lambda s, d: Y.sets_of(units(s, d).filter("contig = 0 and unit % 10 = 0").select(F.col("unit").alias("name"), F.col("read_id").alias("member"))),
    "overlap_graph": lambda s, d: Y.overlap_graph(_windows(s, d, 0), _windows(s, d, 1), 0.01),
    "pair_sites": lambda s, d: alns(s, d).select(F.col("st").alias("pos")).union(alns(s, d).select("en")).distinct().agg(F.count(F.lit(1)).alias("n_sites")),
    "position_order": lambda s, d: alns(s, d).groupBy("contig").agg(F.min(F.struct("st", "en", (~F.col("fwd")).cast("int").alias("back"), "read_id", "ln")).alias("x")).select("contig", "x.*"),
}

_IN = "contig = {c} AND unit >= {a} AND unit < {b}"
ORACLES = {
    "gap_fill": f"""{_CHUNKS}, w AS (SELECT c.*, p.is_gap AS pg, p.contig AS pc, p.unit AS pu, p.fwd AS pf, n.is_gap AS ng, n.contig AS nc, n.unit AS nu, n.fwd AS nf
      FROM ch c LEFT JOIN ch p ON p.read_id = c.read_id AND p.pos = c.pos - 1 LEFT JOIN ch n ON n.read_id = c.read_id AND n.pos = c.pos + 1),
      f AS (SELECT *, coalesce(is_gap AND NOT pg AND NOT ng AND pf = nf AND pc = nc AND ((pf AND pu + 2 = nu) OR (NOT pf AND pu = nu + 2)) AND n_bases BETWEEN 80 AND 120, false) AS filled FROM w)
      SELECT read_id, pos, CASE WHEN filled THEN pc ELSE contig END AS contig, CASE WHEN NOT filled THEN unit WHEN pf THEN pu + 1 ELSE pu - 1 END AS unit, filled FROM f WHERE filled OR NOT is_gap""",
    "clip_flags": f"{_EDGES} SELECT read_id, hg AND hn > 2000 AS head_clip, tg AND tn > 2000 AS tail_clip FROM e",
    "gap_ends": f"{_EDGES} SELECT count(*) AS n_reads, count(*) FILTER (only_gap) AS n_gap_only, sum(CASE WHEN hg THEN hn ELSE 0 END + CASE WHEN tg THEN tn ELSE 0 END) / count(*) * 2 AS mean_end_gap FROM e",
    "clone_within": f"WITH {UNITS_SQL} SELECT * FROM units WHERE {_IN.format(c=1, a=20, b=60)}",
    "touching_reads": f"WITH {UNITS_SQL} SELECT read_id, count(*) FILTER ({_IN.format(c=2, a=30, b=33)}) > 0 AS touches, count(*) FILTER ({_IN.format(c=2, a=30, b=33)}) AS n_inside, count(*) FILTER (contig = 2) > 0 AS has_contig FROM units GROUP BY 1",
    "selected_within": f"WITH {UNITS_SQL} SELECT read_id, count(*) FILTER (unit < 50) AS n_inside FROM units GROUP BY 1 HAVING count(*) FILTER (unit < 50) > least(60, count(*) // 2)",
    "majority_strand": f"{_CHUNKS}, r AS (SELECT DISTINCT read_id FROM ch), k AS (SELECT unnest([0, 1, 2])::BIGINT AS contig) SELECT r.read_id, k.contig, (SELECT CASE WHEN count(*) = 0 THEN NULL ELSE 2 * count(*) FILTER (c.pos % 3 > 0) > count(*) END FROM ch c WHERE c.read_id = r.read_id AND c.contig = k.contig AND NOT c.is_gap) AS forward FROM r, k",
    "node_edges": f"{_NODES} SELECT ed.read_id, ed.pos, off AS \"offset\", CASE WHEN off > 0 THEN substr(seq, CAST(en + 1 AS INT), CAST(off AS INT)) ELSE '' END AS label FROM ed JOIN reads USING (read_id)",
    "encoded_metrics": f"""{_NODES}, x AS (SELECT read_id, length(seq) AS l, (SELECT sum(en - start) FROM nd WHERE nd.read_id = r.read_id) AS n, (SELECT sum(off) FROM ed WHERE ed.read_id = r.read_id AND off < 0) AS o FROM reads r)
      SELECT read_id, CAST(greatest(coalesce(n, 0) + coalesce(o, 0), 0) AS BIGINT) AS encoded_length, CASE WHEN l = 0 THEN NULL ELSE greatest(coalesce(n, 0) + coalesce(o, 0), 0) / l END AS encoded_rate, n IS NULL AS gappy FROM x""",
    "labels_first": f"WITH {UNITS_SQL}, {_CLUSTERS} SELECT read_id, cluster AS label, cluster IS NULL AS unlabelled FROM (SELECT DISTINCT read_id FROM units) LEFT JOIN cl USING (read_id)",
    "region_predicates": f"""WITH {UNITS_SQL}, {_REGIONS}, x AS (SELECT region, read_id, "start" AS a, "end" AS b, list(unit) AS us FROM units JOIN rg USING (contig) GROUP BY ALL)
      SELECT * FROM (SELECT region, read_id, len(list_filter(us, lambda u: u >= a AND u < b)) > 0 AS "overlaps", list_contains(us, a) AND list_contains(us, b - 1) AS contains, list_min(us) < a AND list_max(us) >= b AS spans FROM x) WHERE "overlaps" OR spans""",
    "position_votes": f"""WITH {VOTES_SQL}, v AS (SELECT win AS position, CASE WHEN read_id % 3 > 0 THEN win % 2 + CASE WHEN read_id % 11 = 0 THEN 1 ELSE 0 END END AS label FROM votes),
      t AS (SELECT position, count(*) AS total FROM v GROUP BY 1), c AS (SELECT position, label, count(*) AS n FROM v WHERE label IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, label DESC) AS k FROM c) SELECT position, label, n, total FROM b JOIN t USING (position) WHERE k = 1 AND total * 3 // 5 < n AND total > 5""",
    "occupied_clusters": f"""WITH {UNITS_SQL}, {_CLUSTERS}, u AS (SELECT read_id, contig, unit // 10 * 10 + read_id % 7 AS unit FROM units), t AS (SELECT contig, unit, count(*) AS total FROM u GROUP BY ALL),
      h AS (SELECT greatest(sum(total) // count(*) - 3 * (sum(total * total) // count(*)), 0) AS thr FROM t)
      SELECT cluster, bool_or(coalesce(ok, false)) AS occupied FROM cl LEFT JOIN (SELECT cluster, n > 8 * total // 10 AND total > thr AS ok FROM (SELECT cluster, contig, unit, count(*) AS n FROM u JOIN cl USING (read_id) GROUP BY ALL) JOIN t USING (contig, unit), h) USING (cluster) GROUP BY 1""",
    "low_coverage": f"""WITH {UNITS_SQL}, c AS (SELECT contig, unit, count(*) AS cov FROM units GROUP BY ALL), p AS (SELECT contig, count(*) AS n, sum(cov) // count(*) AS mean, floor(sqrt(sum(cov * cov) // count(*) - power(sum(cov) // count(*), 2))) AS sd FROM c GROUP BY 1),
      e AS (SELECT sum(cov) // count(*) AS m, floor(sqrt(sum(cov * cov) // count(*) - power(sum(cov) // count(*), 2))) AS s FROM c)
      SELECT contig, n, CAST(mean AS BIGINT) AS mean, CAST(sd AS BIGINT) AS sd, mean >= m - 2 * s AS kept FROM p, e""",
    "window_fractions": f"WITH {VOTES_SQL}, w AS (SELECT DISTINCT win FROM votes), k AS (SELECT DISTINCT cluster FROM votes) SELECT win, cluster, (SELECT count(*) FILTER (v.cluster = k.cluster) / count(*) FROM votes v WHERE v.win = w.win) + 1e-9 AS fraction FROM w, k",
    "cluster_peaks": f"""WITH {UNITS_SQL}, {_CLUSTERS}, n AS (SELECT cluster, contig, unit, count(*) AS n FROM units JOIN cl USING (read_id) GROUP BY ALL)
      SELECT cluster, contig, unit AS peak_unit, n AS peak, CAST(tot AS DOUBLE) / every AS share FROM (SELECT *, sum(n) OVER (PARTITION BY cluster, contig) AS tot, sum(n) OVER (PARTITION BY cluster) AS every, row_number() OVER (PARTITION BY cluster, contig ORDER BY n DESC, unit) AS k FROM n) WHERE k = 1""",
    "share_over": f"WITH {ALNS_SQL}, t AS (SELECT avg(score) + 2.0 * stddev_samp(score) AS threshold FROM alns) SELECT threshold, count(*) FILTER (score > threshold) AS n_over, count(*) AS n, count(*) FILTER (score > threshold) / count(*) * 100 AS percent FROM alns, t GROUP BY 1",
    "five_numbers": f"WITH {ALNS_SQL} SELECT contig, min(score)::DOUBLE AS least, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3, max(score)::DOUBLE AS greatest FROM alns GROUP BY 1",
    "score_gain": f"WITH {ALNS_SQL}, x AS (SELECT contig, ln, score % 97 / 97 AS tpn, st % 89 / 89 AS tnn, en % 83 / 83 AS tpo, st % 79 / 79 AS tno FROM alns) SELECT contig, ln, avg({_GAIN}) AS f_gain FROM x GROUP BY 1, 2",
    "spread_means": f"WITH {ALNS_SQL} SELECT contig, avg(score) FILTER (fwd) AS plus, avg(score) FILTER (NOT fwd) AS minus FROM alns GROUP BY 1",
    "replicates": f"WITH {ALNS_SQL} SELECT read_id, ln, contig, row_number() OVER (PARTITION BY contig ORDER BY read_id, ln) AS replicate FROM alns",
    "sampled_rows": f"WITH {ALNS_SQL} SELECT read_id, ln FROM alns WHERE substr(md5('7:' || read_id || ':' || ln), 1, 8) < '028f5c28'",
    "sampled_groups": f"WITH {ALNS_SQL} SELECT contig, read_id, ln FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY md5('3:' || read_id || ':' || ln), read_id, ln) AS k FROM alns) WHERE k <= 30",
    "set_overlaps": f"""WITH {UNITS_SQL}, m AS (SELECT DISTINCT unit AS name, read_id AS member FROM units WHERE contig = 0 AND unit % 10 = 0), l AS (SELECT name, list(member) AS ms FROM m GROUP BY 1)
      SELECT * FROM (SELECT x.name AS a, y.name AS b, len(list_intersect(x.ms, y.ms)) AS n_both, len(list_distinct(x.ms || y.ms)) AS n_either FROM l x JOIN l y ON x.name < y.name) WHERE n_both > 0""",
    "overlap_graph": f"""WITH {VOTES_SQL}, p AS (SELECT DISTINCT cluster AS a, read_id % 20 AS r FROM votes WHERE win % 2 = 0), q AS (SELECT DISTINCT cluster AS b, read_id % 20 AS r FROM votes WHERE win % 2 = 1),
      x AS (SELECT a, b, count(*) AS n FROM p JOIN q USING (r) GROUP BY ALL) SELECT a, b, n / sqrt((SELECT count(*) FROM p WHERE p.a = x.a AND r IN (SELECT r FROM q)) * (SELECT count(*) FROM q WHERE q.b = x.b AND r IN (SELECT r FROM p))) AS weight FROM x WHERE weight > 0.01""",
    "pair_sites": f"WITH {ALNS_SQL} SELECT count(DISTINCT pos) AS n_sites FROM (SELECT st AS pos FROM alns UNION ALL SELECT en FROM alns)",
    "position_order": f"WITH {ALNS_SQL} SELECT contig, st, en, CASE WHEN fwd THEN 0 ELSE 1 END AS back, read_id, ln FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY st, en, fwd DESC, read_id, ln) AS k FROM alns) WHERE k = 1",
}
