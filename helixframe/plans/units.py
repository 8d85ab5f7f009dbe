"""Queries over the units view: coverage, boundaries, jumps, windows, run lengths, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import coverage as C
from helixframe.operators import graphs as G
from helixframe.plans.adapters import UNITS_SQL, units


def _cov(spark, d):
    return C.unit_coverage(units(spark, d))


def _nodes(spark, d):
    return units(spark, d).select("read_id", "pos", (F.col("contig") * 1000 + F.expr("unit div 10")).alias("node"), (F.col("unit") % 2 == 0).alias("fwd"))


QUERIES = {
    "unit_coverage": _cov,
    "start_stop": lambda s, d: C.start_stop(units(s, d)),
    "edge_direction_counts": lambda s, d: C.end_directions(units(s, d)),
    "jump_edges": lambda s, d: C.jumps(units(s, d)),
    "coverage_islands": lambda s, d: C.islands(_cov(s, d).withColumn("cov", F.col("cov") - F.expr("unit % 7 * 5")), F.col("cov") > 10, ["contig"], "unit"),
    "windows": lambda s, d: C.windows(_cov(s, d)),
    "read_window_join": lambda s, d: C.window_members(units(s, d)),
    "peak_islands": lambda s, d: C.peaks(C.start_stop(units(s, d).withColumn("unit", F.expr("unit * unit div 100"))), least=1, sigmas=0.5),
    "genome_size": lambda s, d: C.genome_size(_cov(s, d)),
    "rare_unit_anti": lambda s, d: C.without_rare_units(units(s, d).withColumn("unit", F.expr("unit * 10 + pos % 2")), 4),
    "rle_units": lambda s, d: C.run_lengths(units(s, d).withColumn("unit", F.expr("unit div 30"))),
    "linear_pos": lambda s, d: C.linear_positions(units(s, d)),
    "peak_ranges": lambda s, d: C.peak_ranges(units(s, d).filter("unit % 9 = 4").select("contig", F.col("unit").alias("start")).distinct(), C.unit_spine(units(s, d)).groupBy("contig").agg((F.max("unit") + 1).alias("length"))),
    "asof_unit": lambda s, d: C.as_of(units(s, d), units(s, d).filter("unit % 9 = 4").select("contig", F.col("unit").alias("start")).distinct(), ["contig"], "unit", "start").select("read_id", "pos", "contig", "unit", F.col("found").alias("start")),
    "canonical_kmers": lambda s, d: G.canonical_kmers(units(s, d)),
    "ditch_nodes_edges": lambda s, d: G.overlap_edges(_nodes(s, d)),
    "degree_histogram": lambda s, d: G.degrees(G.overlap_edges(_nodes(s, d))),
    "tip_removal": lambda s, d: G.without_tips(units(s, d).select(F.expr("contig * 100000 + unit * unit * 3 div (1 + read_id % 5)").alias("node"))),
    "components": lambda s, d: G.components(units(s, d).select(F.expr("contig * 10000 + unit * 10 + read_id % 7").alias("a"), F.expr("contig * 10000 + unit * 10 + (pos * 3) % 7").alias("b")).filter("a <> b")),
}

_COV = f"""WITH {UNITS_SQL},
  spine AS (SELECT contig, CAST(unnest(range(0, mx + 1)) AS BIGINT) AS unit FROM (SELECT contig, max(unit) AS mx FROM units GROUP BY contig)),
  c AS (SELECT contig, unit, count(*) AS n FROM units GROUP BY ALL),
  cov AS (SELECT s.contig, s.unit, coalesce(c.n, 0) AS cov FROM spine s LEFT JOIN c USING (contig, unit))"""
_SS = """ss AS (SELECT contig, unit, count(*) AS n FROM (
    SELECT contig, unit FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY pos) AS k FROM u) WHERE k = 1
    UNION ALL SELECT contig, unit FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY pos DESC) AS k FROM u) WHERE k = 1) GROUP BY ALL)"""
_NODES = f"""WITH {UNITS_SQL}, n AS (SELECT read_id, pos, contig * 1000 + unit // 10 AS node, unit % 2 = 0 AS fwd FROM units),
  e0 AS (SELECT node AS a, fwd AS a_tail, lead(node) OVER w AS b, NOT lead(fwd) OVER w AS b_tail FROM n WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
  e AS (SELECT a, a_tail, b, b_tail, count(*) AS occ FROM (SELECT * FROM e0 WHERE b IS NOT NULL UNION ALL SELECT b, b_tail, a, a_tail FROM e0 WHERE b IS NOT NULL) GROUP BY ALL)"""
_ISLES = """SELECT contig, min(unit) AS start, max(unit) + 1 AS "end" FROM (SELECT *, unit - row_number() OVER (PARTITION BY contig ORDER BY unit) AS g FROM x) GROUP BY contig, g"""

ORACLES = {
    "unit_coverage": f"{_COV} SELECT contig, unit, cov FROM cov",
    "start_stop": f"WITH {UNITS_SQL}, u AS (SELECT * FROM units), {_SS} SELECT * FROM ss",
    "edge_direction_counts": f"""WITH {UNITS_SQL}, s AS (SELECT *, lead(contig) OVER w AS c2, lead(unit) OVER w AS u2, row_number() OVER w AS k, count(*) OVER (PARTITION BY read_id) AS n
      FROM units WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
    r AS (SELECT read_id, arg_min(contig, pos) AS fc, arg_min(unit, pos) AS fu, arg_max(contig, pos) AS lc, arg_max(unit, pos) AS lu,
      count(*) FILTER (k <= 5 AND c2 = contig AND unit < u2) > count(*) FILTER (k <= 5 AND c2 = contig) // 2 AS fd,
      count(*) FILTER (k >= n - 5 AND k < n AND c2 = contig AND unit > u2) > count(*) FILTER (k >= n - 5 AND k < n AND c2 = contig) // 2 AS ld
      FROM s WHERE n > 10 GROUP BY read_id)
    SELECT contig, unit, count(*) FILTER (d) AS down, count(*) FILTER (NOT d) AS up FROM (SELECT fc AS contig, fu AS unit, fd AS d FROM r UNION ALL SELECT lc, lu, ld FROM r) GROUP BY ALL""",
    "jump_edges": f"""WITH {UNITS_SQL}, q AS (SELECT contig AS c0, unit AS u0, lead(contig, 1) OVER w AS c1, lead(unit, 1) OVER w AS u1, lead(contig, 2) OVER w AS c2, lead(unit, 2) OVER w AS u2,
      lead(contig, 3) OVER w AS c3, lead(unit, 3) OVER w AS u3 FROM units WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
    l AS (SELECT contig, max(unit) AS last FROM units GROUP BY 1),
    j AS (SELECT q.* FROM q JOIN l ON l.contig = c1 WHERE c3 IS NOT NULL AND c0 = c1 AND c2 = c3 AND abs(u0 - u1) <= 10 AND abs(u2 - u3) <= 10 AND (c1 <> c2 OR abs(u1 - u2) > 10)
      AND NOT (c1 = c2 AND least(u1, u2) < 5 AND greatest(u1, u2) > last - 5))
    SELECT CASE WHEN u1 < u2 THEN c1 ELSE c2 END AS contig, least(u1, u2) AS unit, CASE WHEN u1 < u2 THEN c2 ELSE c1 END AS to_contig, greatest(u1, u2) AS to_unit,
      CASE WHEN u1 < u2 THEN u0 < u1 ELSE u2 > u3 END AS from_up, CASE WHEN u1 < u2 THEN u2 > u3 ELSE u0 < u1 END AS to_up, count(*) AS n FROM j GROUP BY ALL""",
    "coverage_islands": f"{_COV}, x AS (SELECT contig, unit FROM cov WHERE cov - unit % 7 * 5 > 10) {_ISLES}",
    "windows": f"""{_COV}, m AS (SELECT contig, CAST(sum(cov) AS BIGINT) // count(*) // 4 AS thr FROM cov GROUP BY 1), x AS (SELECT contig, unit FROM cov JOIN m USING (contig) WHERE cov > thr),
    i AS (SELECT * FROM ({_ISLES}) WHERE "end" - start > 6),
    w AS (SELECT *, ("end" - start) // 20 AS n, unnest(range(0, CASE WHEN "end" - start < 20 THEN 1 ELSE ("end" - start) // 20 + 1 END)) AS i FROM i)
    SELECT contig, greatest(start + i * 20, 1) AS start, CASE WHEN "end" - start >= 20 AND i < n - 1 THEN start + i * 20 + 20 ELSE "end" END AS "end" FROM w""",
    "read_window_join": f"WITH {UNITS_SQL} SELECT contig, unit // 20 AS win, read_id, count(*) AS n_units, min(unit) AS first_unit, max(unit) AS last_unit FROM units GROUP BY ALL",
    "peak_islands": f"""WITH {UNITS_SQL}, u AS (SELECT read_id, pos, contig, unit * unit // 100 AS unit FROM units), {_SS},
    t AS (SELECT contig, greatest(CAST(floor(avg(n) + 0.5 * sqrt(greatest(avg(n * n) - avg(n) * avg(n), 0))) AS BIGINT), 1) AS thr FROM ss WHERE n > 0 GROUP BY 1),
    p AS (SELECT contig, unit, thr, CASE WHEN unit - lag(unit) OVER w <= 4 THEN 0 ELSE 1 END AS new FROM ss JOIN t USING (contig) WHERE n >= thr WINDOW w AS (PARTITION BY contig ORDER BY unit)),
    g AS (SELECT contig, thr, min(unit) AS s, max(unit) + 1 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY unit) AS k FROM p) GROUP BY contig, thr, k)
    SELECT g.contig, s AS start, e AS "end", CAST(sum(n) AS BIGINT) AS total FROM g JOIN ss ON ss.contig = g.contig AND unit >= s AND unit < e GROUP BY g.contig, s, e, thr HAVING CAST(sum(n) AS BIGINT) // (e - s + 1) > thr""",
    "genome_size": f"{_COV} SELECT count(*) AS n_units, count(*) * 100 // 1000 AS kb FROM cov WHERE cov > 10",
    "rare_unit_anti": f"""WITH {UNITS_SQL}, u AS (SELECT read_id, contig, unit * 10 + pos % 2 AS unit FROM units), r AS (SELECT contig, unit FROM u GROUP BY ALL HAVING count(*) <= 4)
    SELECT DISTINCT read_id FROM u WHERE read_id NOT IN (SELECT read_id FROM u JOIN r USING (contig, unit))""",
    "rle_units": f"""WITH {UNITS_SQL}, u AS (SELECT read_id, pos, contig, unit // 30 AS unit FROM units),
    n AS (SELECT *, CASE WHEN lag(contig) OVER w = contig AND abs(lag(unit) OVER w - unit) < 2 THEN 0 ELSE 1 END AS new FROM u WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY read_id ORDER BY pos) AS BIGINT) AS run FROM n)
    SELECT read_id, run, contig, arg_min(unit, pos) AS first_unit, arg_max(unit, pos) AS last_unit, count(*) AS n FROM r GROUP BY read_id, run, contig""",
    "linear_pos": f"""WITH {UNITS_SQL}, s AS (SELECT contig, min(unit) AS lo, max(unit) AS hi FROM units GROUP BY 1),
    b AS (SELECT contig, lo, coalesce(sum(hi - lo + 1) OVER (ORDER BY contig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT DISTINCT contig, unit, CAST(before + unit - lo AS BIGINT) AS place FROM units JOIN b USING (contig)""",
    "peak_ranges": f"""WITH {UNITS_SQL}, s AS (SELECT DISTINCT contig, unit AS start FROM units WHERE unit % 9 = 4), l AS (SELECT contig, max(unit) + 1 AS length FROM units GROUP BY 1)
    SELECT contig, start, coalesce(lead(start) OVER (PARTITION BY contig ORDER BY start), length) AS "end" FROM s JOIN l USING (contig)""",
    "asof_unit": f"""WITH {UNITS_SQL}, s AS (SELECT DISTINCT contig, unit AS start FROM units WHERE unit % 9 = 4)
    SELECT read_id, pos, u.contig, unit, s.start FROM units u ASOF LEFT JOIN s ON u.contig = s.contig AND u.unit >= s.start""",
    "canonical_kmers": f"""WITH {UNITS_SQL}, v AS (SELECT contig * 1000 + unit AS a, lead(contig * 1000 + unit, 1) OVER w AS b, lead(contig * 1000 + unit, 2) OVER w AS c FROM units WINDOW w AS (PARTITION BY read_id ORDER BY pos))
    SELECT CASE WHEN a > c THEN c ELSE a END AS k0, b AS k1, CASE WHEN a > c THEN a ELSE c END AS k2, count(*) AS occ FROM v WHERE c IS NOT NULL GROUP BY ALL""",
    "ditch_nodes_edges": f"{_NODES} SELECT a, a_tail, b, b_tail, occ FROM e",
    "degree_histogram": f"{_NODES} SELECT degree, count(*) AS n FROM (SELECT a, count(*) AS degree FROM e GROUP BY a) GROUP BY degree",
    "tip_removal": f"""WITH {UNITS_SQL}, o AS (SELECT contig * 100000 + unit * unit * 3 // (1 + read_id % 5) AS node, count(*) AS occ FROM units GROUP BY 1)
    SELECT node, occ FROM o WHERE occ >= (SELECT CAST(sum(occ) AS BIGINT) // count(*) // 8 FROM o)""",
    "components": f"""WITH RECURSIVE {UNITS_SQL}, e0 AS (SELECT contig * 10000 + unit * 10 + read_id % 7 AS a, contig * 10000 + unit * 10 + (pos * 3) % 7 AS b FROM units),
    e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e0 WHERE a <> b UNION ALL SELECT b, a FROM e0 WHERE a <> b)),
    r(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
    SELECT node, min(seen) AS component FROM r GROUP BY node""",
}
