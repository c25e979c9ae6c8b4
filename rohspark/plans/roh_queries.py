"""Queries of the ROH operators over whole tables, each with its SQL.

The tables hold many panels; every operator works within panel and chr. `P` states the parameters once for
both forms.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rohspark.functions import exprs
from rohspark.operators import density, features, linkage, mixture, record_parse, roh, sites
from rohspark.operators.em_impute import current_calls
from rohspark.session import broadcast_if_small, materialise, table


class P:
    """Parameters of the queries."""

    w = 10
    w_ld = 5
    max_gap = 500_000
    error = 0.001
    cutoff = 0.0
    overlap = 0.25
    m, mu = 7, 1e-9
    bounds = (300_000.0, 1_000_000.0)
    kde_individuals = 8
    seed = 11
    sizes = (4, 6, 8)


LEAST = exprs.overlap_threshold(P.overlap, P.w)
LEAST_LD = exprs.overlap_threshold(P.overlap, P.w_ld)

# SQL: common table expressions by name, with the names of those each needs ------------------------

_CTES: dict[str, tuple[str, str]] = {}


def _cte(name: str, needs: str, sql: str) -> None:
    _CTES[name] = (needs, sql)


def _sql(last: str, needs: str) -> str:
    """`last` behind a WITH clause of `needs` and all that these need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in _CTES[name][0].split():
                add(n)
            order.append(name)

    for n in needs.split():
        add(n)
    return ("WITH " if order else "") + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order) + "\n" + last


_cte("cur", "", """
  SELECT ind_idx, chr, locus_idx, max_by(panel_id, k) AS panel_id, max_by(ppos, k) AS ppos,
    CASE WHEN max_by(coalesce(g, -9), k) IN (0, 1, 2) THEN max_by(coalesce(g, -9), k)::INT END AS g, CASE max_by(coalesce(first_copy::INT, -1), k) WHEN 1 THEN true WHEN 0 THEN false END AS first_copy
  FROM (SELECT *, epoch_us(loaded_at) * 4 + CASE WHEN g IN (0, 1, 2) THEN g + 1 ELSE 0 END AS k FROM genotypes) GROUP BY ind_idx, chr, locus_idx""")
_cte("freqs", "cur", """
  SELECT panel_id, chr, locus_idx, max(ppos) AS ppos, CASE WHEN count(g) > 0 THEN sum(g)::DOUBLE / (2 * count(g)) ELSE 0e0 END AS freq,
    CASE WHEN count(g) > 0 THEN count(*) FILTER (WHERE g <> 1)::DOUBLE / count(g) ELSE 0e0 END AS hom_freq, count(g) AS n_calls
  FROM cur GROUP BY panel_id, chr, locus_idx""")
_cte("numbered", "freqs", "SELECT *, row_number() OVER (PARTITION BY panel_id, chr ORDER BY ppos, locus_idx) - 1 AS idx FROM freqs WHERE freq > 0 AND freq < 1")
_cte("cen", "", "SELECT chr, max(c_start) AS c_start, max(c_end) AS c_end FROM centromeres GROUP BY chr")
_BREAK = f"""coalesce(b - a > {P.max_gap} OR (a BETWEEN cs AND ce) OR (b BETWEEN cs AND ce) OR (cs >= a AND ce <= b), false)::INT"""
_cte("stepped", "numbered cen", """
  SELECT n.*, lag(n.ppos) OVER (PARTITION BY n.panel_id, n.chr ORDER BY n.idx) AS a, n.ppos AS b, coalesce(c.c_start, 0) AS cs, coalesce(c.c_end, 0) AS ce
  FROM numbered n LEFT JOIN cen c ON c.chr = n.chr""")
_cte("broken", "stepped", f"SELECT * EXCLUDE (a, b, cs, ce), {_BREAK} AS brk FROM stepped")


def _lod(g: str = "g", p: str = "freq", e: str = f"{P.error}e0") -> str:
    return f"""CASE WHEN {p} > 0 AND {p} < 1 THEN CASE {g}
      WHEN 0 THEN log10(((1 - {e}) * (1 - {p}) + {e} * (1 - {p}) * (1 - {p})) / ((1 - {p}) * (1 - {p})))
      WHEN 1 THEN log10({e}) WHEN 2 THEN log10(((1 - {e}) * {p} + {e} * {p} * {p}) / ({p} * {p})) ELSE 0e0 END ELSE 0e0 END"""


_GQ = "(10 + (c.locus_idx * 7 + c.ind_idx * 11) % 40)"
_GQ_ERROR = f"least(greatest(pow(10e0, greatest({_GQ} / -10e0, -10e0)), 1e-16), 1e0)"
_cte("scored", "cur broken", f"SELECT c.panel_id, c.chr, c.ind_idx, b.idx, b.ppos, b.brk, {_lod('c.g', 'b.freq')} AS lod FROM cur c JOIN broken b ON b.panel_id = c.panel_id AND b.chr = c.chr AND b.locus_idx = c.locus_idx")
_cte("scored_gl", "cur broken", f"SELECT c.panel_id, c.chr, c.ind_idx, b.idx, b.ppos, b.brk, {_lod('c.g', 'b.freq', _GQ_ERROR)} AS lod FROM cur c JOIN broken b ON b.panel_id = c.panel_id AND b.chr = c.chr AND b.locus_idx = c.locus_idx")


def _windows(source: str, w: int, value: str = "lod", extra: str = "") -> str:
    part = "PARTITION BY panel_id, chr, ind_idx ORDER BY idx"
    return f"""
  SELECT panel_id, chr, ind_idx, idx, ppos, brk{extra}, CASE WHEN count(*) OVER ({part} ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) = {w}
    AND sum(brk) OVER ({part} ROWS BETWEEN 1 FOLLOWING AND {w - 1} FOLLOWING) = 0 THEN sum({value}) OVER ({part} ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) END AS score
  FROM {source}"""


_cte("win", "scored", _windows("scored", P.w))
_cte("win_gl", "scored_gl", _windows("scored_gl", P.w))


def _covered(windows: str, w: int) -> str:
    return f"""
  SELECT *, sum(high) OVER (PARTITION BY panel_id, chr, ind_idx ORDER BY idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)::BIGINT AS cov
  FROM (SELECT *, coalesce(score >= {P.cutoff}e0, false)::INT AS high FROM {windows})"""


def _segments(covered: str, least: float, length: str = "max(ppos) - min(ppos) + 1") -> str:
    part = "OVER (PARTITION BY panel_id, chr, ind_idx ORDER BY idx)"
    return f"""
  SELECT panel_id, chr, ind_idx, min(ppos) AS start, max(ppos) AS stop, count(*) AS n_snps, {length} AS length FROM (
    SELECT *, sum(head) {part} AS island FROM (
      SELECT *, (inside AND (NOT coalesce(lag(inside) {part}, false) OR brk = 1))::INT AS head, lead(idx) {part} IS NULL AS is_last
      FROM (SELECT *, cov >= {least} AS inside FROM {covered})))
  WHERE inside GROUP BY panel_id, chr, ind_idx, island HAVING count(*) >= {least} AND NOT bool_or(is_last AND head = 1)"""


_cte("covered", "win", _covered("win", P.w))
_cte("segments", "covered", _segments("covered", LEAST))
_CLASS = f"CASE WHEN length < {P.bounds[0]} THEN 'A' WHEN length < {P.bounds[1]} THEN 'B' ELSE 'C' END"
_cte("loc", "", "SELECT panel_id, chr, locus_idx, v.ppos AS ppos, v.gpos AS gpos, v.locus_name AS locus_name, v.allele AS allele FROM (SELECT panel_id, chr, locus_idx, max({'ppos': ppos, 'gpos': coalesce(gpos, -1), 'locus_name': locus_name, 'allele': allele}) AS v FROM loci GROUP BY panel_id, chr, locus_idx)")
_cte("gmap", "loc", "SELECT panel_id, chr, ppos, max(gpos) AS gpos FROM loc WHERE gpos >= 0 GROUP BY panel_id, chr, ppos")
_cte("bounds", "gmap", "SELECT panel_id, chr, min(ppos) AS lo, max(ppos) AS hi FROM gmap GROUP BY panel_id, chr")
_cte("inbound", "freqs bounds cen", """
  SELECT f.* FROM freqs f JOIN bounds b ON b.panel_id = f.panel_id AND b.chr = f.chr LEFT JOIN cen c ON c.chr = f.chr
  WHERE f.freq > 0 AND f.freq < 1 AND f.ppos BETWEEN b.lo AND b.hi AND NOT (f.ppos > coalesce(c.c_start, 0) AND f.ppos < coalesce(c.c_end, 0))""")
_MAPPED = """
  SELECT s.*, CASE WHEN e.gpos IS NOT NULL THEN e.gpos WHEN d.ppos IS NOT NULL AND u.ppos IS NOT NULL THEN d.gpos + (u.gpos - d.gpos) * (s.ppos - d.ppos) / (u.ppos - d.ppos) END AS gpos,
    e.gpos IS NULL AND d.ppos IS NOT NULL AND u.ppos IS NOT NULL AS interpolated
  FROM {source} s LEFT JOIN gmap e ON e.panel_id = s.panel_id AND e.chr = s.chr AND e.ppos = s.ppos
  ASOF LEFT JOIN gmap d ON d.panel_id = s.panel_id AND d.chr = s.chr AND d.ppos <= s.ppos
  ASOF LEFT JOIN gmap u ON u.panel_id = s.panel_id AND u.chr = s.chr AND u.ppos >= s.ppos"""
_cte("mapped", "inbound gmap", _MAPPED.format(source="inbound"))
_cte("mnum", "mapped", "SELECT *, row_number() OVER (PARTITION BY panel_id, chr ORDER BY ppos, locus_idx) - 1 AS idx FROM mapped")
_cte("mstep", "mnum cen", """
  SELECT n.*, lag(n.ppos) OVER w AS a, n.ppos AS b, lag(n.gpos) OVER w AS ga, coalesce(c.c_start, 0) AS cs, coalesce(c.c_end, 0) AS ce
  FROM mnum n LEFT JOIN cen c ON c.chr = n.chr WINDOW w AS (PARTITION BY n.panel_id, n.chr ORDER BY n.idx)""")
_WEIGHT = f"exp({-2.0 * P.m * P.mu!r} * (b - coalesce(a, 0))) * exp({-2.0 * P.m!r}e0 * (gpos - coalesce(ga, 0)))"
_cte("mbrk", "mstep", f"SELECT * EXCLUDE (a, b, ga, cs, ce), {_BREAK} AS brk, {_WEIGHT} AS weight FROM mstep")
_cte("mscored", "cur mbrk", f"SELECT c.panel_id, c.chr, c.ind_idx, c.g, c.first_copy, b.idx, b.ppos, b.gpos, b.brk, b.weight, {_lod('c.g', 'b.freq')} AS lod FROM cur c JOIN mbrk b ON b.panel_id = c.panel_id AND b.chr = c.chr AND b.locus_idx = c.locus_idx")
_cte("mwin", "mscored", _windows("mscored", P.w, extra=", gpos"))
_cte("mcovered", "mwin", _covered("mwin", P.w))
_cte("near", "mscored", f"""
  SELECT a.panel_id, a.chr, a.idx AS i, b.idx AS j, a.g AS ga, b.g AS gb, a.first_copy AS fa, b.first_copy AS fb
  FROM mscored a JOIN mscored b ON b.panel_id = a.panel_id AND b.chr = a.chr AND b.ind_idx = a.ind_idx AND b.idx > a.idx AND b.idx < a.idx + {P.w_ld}""")


def _ld(freq: str, joint: str) -> str:
    inside = "f.f1 > 0 AND f.f1 < 1 AND h.f1 > 0 AND h.f1 < 1"
    return f"""
  SELECT x.panel_id, x.chr, x.i, x.j, CASE WHEN {inside} THEN CASE WHEN x.x IS NULL THEN NULL ELSE least(pow(x.x - f.f1 * h.f1, 2) / (f.f1 * (1 - f.f1) * h.f1 * (1 - h.f1)), 1e0) END ELSE 0e0 END AS ld
  FROM (SELECT panel_id, chr, i, j, {joint} AS x FROM near GROUP BY panel_id, chr, i, j) x
  JOIN (SELECT panel_id, chr, idx, {freq} AS f1 FROM mnum) f ON f.panel_id = x.panel_id AND f.chr = x.chr AND f.idx = x.i
  JOIN (SELECT panel_id, chr, idx, {freq} AS f1 FROM mnum) h ON h.panel_id = x.panel_id AND h.chr = x.chr AND h.idx = x.j"""


_BOTH = "ga IS NOT NULL AND gb IS NOT NULL"
_cte("hr2", "near mnum", _ld("hom_freq", f"count(*) FILTER (WHERE {_BOTH} AND ga <> 1 AND gb <> 1)::DOUBLE / nullif(count(*) FILTER (WHERE {_BOTH}), 0)"))
_cte("r2", "near mnum", _ld("freq", f"""sum(CASE WHEN NOT ({_BOTH}) THEN 0 WHEN ga = 2 AND gb = 2 THEN 2 WHEN (ga = 1 AND gb = 2) OR (ga = 2 AND gb = 1) THEN 1
    WHEN ga = 1 AND gb = 1 AND fa = fb THEN 1 ELSE 0 END)::DOUBLE / nullif(2 * count(*) FILTER (WHERE {_BOTH}), 0)"""))
_cte("ldboth", "hr2", "SELECT panel_id, chr, i AS s, j AS o, ld FROM hr2 UNION ALL SELECT panel_id, chr, j, i, ld FROM hr2")
_cte("starts", "mnum", f"""SELECT m.panel_id, m.chr, m.idx AS win_start FROM mnum m JOIN (SELECT panel_id, chr, count(*) AS n FROM mnum GROUP BY panel_id, chr) c ON c.panel_id = m.panel_id AND c.chr = m.chr WHERE m.idx <= c.n - {P.w_ld}""")
_cte("ldw", "starts mnum ldboth", f"""
  SELECT t.panel_id, t.chr, t.win_start, m.idx, CASE WHEN count(l.o) = count(l.ld) THEN 1e0 + coalesce(sum(l.ld), 0) END AS ld_sum FROM starts t
  JOIN mnum m ON m.panel_id = t.panel_id AND m.chr = t.chr AND m.idx BETWEEN t.win_start AND t.win_start + {P.w_ld - 1}
  LEFT JOIN ldboth l ON l.panel_id = t.panel_id AND l.chr = t.chr AND l.s = m.idx AND l.o BETWEEN t.win_start AND t.win_start + {P.w_ld - 1} GROUP BY t.panel_id, t.chr, t.win_start, m.idx""")
_cte("wsum", "mscored ldw", "SELECT s.panel_id, s.chr, s.ind_idx, l.win_start, CASE WHEN count(l.ld_sum) = count(*) THEN sum(s.lod * s.weight / l.ld_sum) END AS v FROM mscored s JOIN ldw l ON l.panel_id = s.panel_id AND l.chr = s.chr AND l.idx = s.idx GROUP BY s.panel_id, s.chr, s.ind_idx, l.win_start")
_cte("wwin", "mscored wsum", f"""
  SELECT s.panel_id, s.chr, s.ind_idx, s.idx, s.ppos, s.brk, CASE WHEN sum(s.brk) OVER (PARTITION BY s.panel_id, s.chr, s.ind_idx ORDER BY s.idx ROWS BETWEEN 1 FOLLOWING AND {P.w_ld - 1} FOLLOWING) = 0 THEN x.v END AS score
  FROM mscored s LEFT JOIN wsum x ON x.panel_id = s.panel_id AND x.chr = s.chr AND x.ind_idx = s.ind_idx AND x.win_start = s.idx""")
_cte("wcovered", "wwin", _covered("wwin", P.w_ld))


def _thinned(windows: str, w: int) -> str:
    return f"SELECT panel_id, ind_idx, chr, idx, score AS x FROM {windows} WHERE idx % {w} = 0 AND score IS NOT NULL"


_cte("thinned", "win", _thinned("win", P.w))


def _kde_ctes(points: str, tag: str) -> str:
    """Adds the density of `points`; gives its name."""
    _cte(f"band{tag}", points, f"""
  SELECT panel_id, count(*) AS n, min(x) AS lowest, max(x) AS highest, 0.9e0 * least(stddev_samp(x), (quantile_cont(x, 0.75e0) - quantile_cont(x, 0.25e0)) / 1.34e0) * pow(count(*), -0.2e0) AS h
  FROM {points} GROUP BY panel_id""")
    _cte(f"kdey{tag}", f"{points} band{tag}", f"""
  SELECT b.panel_id, g.i, b.lowest - 3 * b.h + (g.i + 1) * ((b.highest - b.lowest + 6 * b.h) / 512) AS x, (b.highest - b.lowest + 6 * b.h) / 512 AS step,
    sum(exp(-pow((p.x - (b.lowest - 3 * b.h + (g.i + 1) * ((b.highest - b.lowest + 6 * b.h) / 512))) / b.h, 2))) / any_value(b.n) AS y
  FROM {points} p JOIN band{tag} b ON b.panel_id = p.panel_id AND b.h > 0, (SELECT unnest(range(512)) AS i) g GROUP BY b.panel_id, g.i, b.lowest, b.highest, b.h""")
    _cte(f"kde{tag}", f"kdey{tag}", f"SELECT panel_id, i, x, y / (sum(y) OVER (PARTITION BY panel_id) * step) AS y FROM kdey{tag}")
    _cte(f"wig{tag}", f"kde{tag}", f"""
  SELECT panel_id, sum(rss) / 20 AS wiggle FROM (SELECT panel_id, i, regr_syy(100 * y, x) OVER w - pow(regr_sxy(100 * y, x) OVER w, 2) / regr_sxx(100 * y, x) OVER w AS rss
    FROM kde{tag} WINDOW w AS (PARTITION BY panel_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) WHERE i < 492 GROUP BY panel_id""")
    return f"kde{tag}"


_kde_ctes("thinned", "")
for _n in P.sizes:
    _cte(f"win_w{_n}", "scored", _windows("scored", _n))
    _cte(f"thin_w{_n}", f"win_w{_n}", _thinned(f"win_w{_n}", _n))
    _kde_ctes(f"thin_w{_n}", f"_w{_n}")
_cte("peaks", "kde", "SELECT panel_id, i, max(y) OVER (PARTITION BY panel_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS p FROM kde")
_cte("series", "peaks", """
  SELECT panel_id, s, any_value(p) AS p, count(*) + (CASE WHEN min(i) = 1 THEN 1 ELSE 0 END) AS n FROM (
    SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY panel_id ORDER BY i) AS s FROM (
      SELECT *, coalesce(p <> lag(p) OVER (PARTITION BY panel_id ORDER BY i), true) AS new FROM peaks WHERE i BETWEEN 1 AND 491)) GROUP BY panel_id, s""")
_cte("longest", "series", "SELECT panel_id, p, n FROM series QUALIFY rank() OVER (PARTITION BY panel_id ORDER BY n DESC) = 1 OR n = nth_value(n, 2) OVER (PARTITION BY panel_id ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_cte("modes", "longest", "SELECT panel_id, p FROM longest QUALIFY row_number() OVER (PARTITION BY panel_id ORDER BY p DESC) <= 2")
_cte("ends", "modes kde", "SELECT panel_id, min(i) AS a, max(i) AS b, count(*) AS n FROM (SELECT m.panel_id, m.p, max(k.i) AS i FROM modes m JOIN kde k ON k.panel_id = m.panel_id AND k.y = m.p GROUP BY m.panel_id, m.p) GROUP BY panel_id")
_cte("cutoffs", "ends kde", f"""
  SELECT e.panel_id, CASE WHEN any_value(e.n) < 2 THEN NULL WHEN abs(arg_min(k.x, (k.y, k.i)) / {P.w}) < 1 THEN arg_min(k.x, (k.y, k.i)) ELSE 0e0 END AS cutoff
  FROM ends e JOIN kde k ON k.panel_id = e.panel_id AND k.i BETWEEN e.a AND e.b GROUP BY e.panel_id""")
_cte("lens", "segments", "SELECT length / 1000e0 AS x FROM segments")
_cte("init", "lens", "SELECT k, avg(x) * (k + 1) / 4e0 AS mean, var_samp(x) * (k + 1) / 3e0 AS var, 1e0 / 3 AS weight FROM lens, (SELECT unnest(range(3)) AS k) GROUP BY k")
_TPED_FIELDS = r"""
  SELECT l.file_id, l.line_no, f.n_ind, regexp_full_match(l.raw_line, '(?s)[ \t\r]*("[^"]*"|[^ \t\r"]+)([ \t\r]+("[^"]*"|[^ \t\r"]+))*[ \t\r]*') AS quoted_well,
    list_transform(regexp_extract_all(l.raw_line, '(?s)"[^"]*"|[^ \t\r"]+'), lambda x: CASE WHEN starts_with(x, '"') THEN x[2:-2] ELSE x END) AS v
  FROM tped_lines l JOIN raw_files f ON f.file_id = l.file_id AND f.file_kind = 'tped' WHERE NOT regexp_full_match(l.raw_line, '(?s)[ \t\r]*(#.*)?')"""
_cte("fields", "", _TPED_FIELDS)
_cte("tped", "fields", """
  SELECT file_id, line_no, CASE WHEN starts_with(v[1], 'chr') THEN v[1] ELSE 'chr' || v[1] END AS chr, v[2] AS locus_name, v[4]::BIGINT AS ppos, v[5:] AS alleles FROM fields
  WHERE quoted_well AND len(v) = 4 + 2 * n_ind AND regexp_full_match(v[1], '(chr)?([1-9]|1[0-9]|2[0-2]|X)|chrUn_[0-9]{4}') AND regexp_full_match(v[2], '[A-Za-z][A-Za-z0-9_:.-]{1,23}') AND regexp_matches(v[2], '[0-9]')
    AND regexp_full_match(v[3], '[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') AND regexp_full_match(v[4], '[0-9]{1,10}') AND coalesce(TRY_CAST(v[4] AS BIGINT), 0) BETWEEN 1 AND 2147483647 AND len(list_filter(v[5:], lambda a: a NOT IN ('A', 'C', 'G', 'T', '0'))) = 0""")
_cte("coded", "tped", "SELECT *, list_filter(alleles, lambda a: a <> '0')[1] AS allele FROM tped")
_cte("tfreq", "coded", "SELECT file_id, line_no, chr, locus_name, ppos, allele, CASE WHEN len(list_filter(alleles, lambda a: a <> '0')) > 0 THEN len(list_filter(alleles, lambda a: a = allele))::DOUBLE / len(list_filter(alleles, lambda a: a <> '0')) ELSE 0e0 END AS freq FROM coded")

# Queries ----------------------------------------------------------------------------------------

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None, needs: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _sql(sql, needs)
        return f

    return add


OFF = 1e-9  # added before rounding where halves of the last digit are common, as engines round these differently


def _r(c, digits: int = 6):
    return F.round(c, digits)


def calls_of(spark: SparkSession, d: str) -> DataFrame:
    return current_calls(table(spark, d, "genotypes"))


def loci_of(spark: SparkSession, d: str) -> DataFrame:
    return sites.current_loci(table(spark, d, "loci"))


def broken_sites(spark: SparkSession, d: str) -> DataFrame:
    """Polymorphic sites, numbered and with their breaks."""
    left = sites.number_sites(sites.filter_monomorphic(sites.call_freqs(calls_of(spark, d))))
    return roh.site_breaks(left, table(spark, d, "centromeres"), P.max_gap)


def scored_of(spark: SparkSession, d: str, error=P.error) -> DataFrame:
    return roh.score_calls(calls_of(spark, d), table(spark, d, "centromeres"), P.max_gap, error)


def windows_of(spark: SparkSession, d: str, w: int = P.w, error=P.error) -> DataFrame:
    return roh.window_scores(scored_of(spark, d, error), w)


def segments_of(spark: SparkSession, d: str) -> DataFrame:
    return roh.assemble(windows_of(spark, d), P.cutoff, P.w, P.overlap)


def mapped_sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites within the map, with genetic positions, breaks and step weights."""
    loci = loci_of(spark, d)
    kept = sites.filter_out_of_bounds(sites.call_freqs(calls_of(spark, d)), loci, table(spark, d, "centromeres"))
    numbered = sites.number_sites(sites.interpolate_map(kept, loci))
    return linkage.site_weights(roh.site_breaks(numbered, table(spark, d, "centromeres"), P.max_gap), P.m, P.mu)


def gq(c: str = "") -> F.Column:
    """A genotype quality for each call, made of its key, as the tables hold none."""
    return (10 + (F.col("locus_idx") * 7 + F.col("ind_idx") * 11) % 40).cast("double")


def _tped(spark: SparkSession, d: str) -> DataFrame:
    parsed = record_parse.parse_lines(table(spark, d, "tped_lines"), table(spark, d, "raw_files"), "tped")
    return record_parse.valid_rows(parsed, "tped").drop("gpos")


@_query("SELECT file_id, line_no, chr, locus_name, ppos, allele, round(freq, 6) AS freq FROM tfreq", "tfreq")
def allele_freq(spark, d):
    return sites.allele_freq(_tped(spark, d)).select("file_id", "line_no", "chr", "locus_name", "ppos", "allele", _r("freq").alias("freq"))


@_query("""SELECT file_id, line_no, chr, locus_name, allele, i::INT AS ind, CASE WHEN alleles[2 * i + 1] <> '0' AND alleles[2 * i + 2] <> '0' THEN (alleles[2 * i + 1] = allele)::INT + (alleles[2 * i + 2] = allele)::INT END AS g, alleles[2 * i + 1] = allele AS first_copy
FROM (SELECT *, unnest(range(len(alleles) // 2)) AS i FROM coded)""", "coded")
def coded_genotype(spark, d):
    return sites.code_genotypes(_tped(spark, d)).select("file_id", "line_no", "chr", "locus_name", "allele", "ind", "g", "first_copy")


_DRAWS = f"list_sum(list_transform(range(1, 101), lambda i: (('0x' || substr(md5(file_id || ':' || line_no || ':' || i || ':{P.seed}'), 1, 8))::BIGINT / 4294967296e0 <= freq)::INT)) / 100e0"


@_query(f"SELECT file_id, line_no, chr, locus_name, allele, CASE WHEN freq > 0 THEN {_DRAWS} ELSE freq END AS freq FROM tfreq", "tfreq")
def resample_freq(spark, d):
    return sites.resample_freq(sites.allele_freq(_tped(spark, d)), 100, P.seed, ["file_id", "line_no"]).select("file_id", "line_no", "chr", "locus_name", "allele", "freq")


@_query("SELECT panel_id, chr, locus_idx, ppos, round(freq, 6) AS freq, round(hom_freq, 6) AS hom_freq, n_calls FROM freqs", "freqs")
def hom_freq(spark, d):
    return sites.call_freqs(calls_of(spark, d)).select(*sites.SITE, "ppos", _r("freq").alias("freq"), _r("hom_freq").alias("hom_freq"), "n_calls")


@_query("SELECT panel_id, chr, locus_idx, idx::INT AS idx, ppos FROM numbered", "numbered")
def monomorphic_filter(spark, d):
    return sites.number_sites(sites.filter_monomorphic(sites.call_freqs(calls_of(spark, d)))).select(*sites.SITE, "idx", "ppos")


@_query("SELECT panel_id, chr, locus_idx, ppos FROM inbound", "inbound")
def oob_filter(spark, d):
    return sites.filter_out_of_bounds(sites.call_freqs(calls_of(spark, d)), loci_of(spark, d), table(spark, d, "centromeres")).select(*sites.SITE, "ppos")


_DENSITY = "SELECT s.panel_id, sum(s.n) / sum(s.span - (coalesce(c.c_end, 0) - coalesce(c.c_start, 0)))::DOUBLE AS density FROM (SELECT panel_id, chr, count(*) AS n, max(ppos) - min(ppos) + 1 AS span FROM numbered GROUP BY panel_id, chr) s LEFT JOIN cen c ON c.chr = s.chr GROUP BY s.panel_id"


def _density(spark, d):
    return sites.variant_density(sites.filter_monomorphic(sites.call_freqs(calls_of(spark, d))), table(spark, d, "centromeres"))


@_query(f"SELECT panel_id, round(density * 1e6, 6) AS per_mb FROM ({_DENSITY})", "numbered cen")
def variant_density(spark, d):
    return _density(spark, d).select("panel_id", _r(F.col("density") * 1e6).alias("per_mb"))


@_query(f"SELECT panel_id, greatest(10, trunc(8.3235e0 * ln(density) + 138.0521e0 + 0.5e0))::INT AS w FROM ({_DENSITY})", "numbered cen")
def auto_winsize_weighted(spark, d):
    return _density(spark, d).select("panel_id", exprs.winsize_column("density").alias("w"))


@_query(f"SELECT panel_id, round(CASE WHEN f > 1 THEN 1e0 WHEN f <= 0 THEN 1e0 / {P.w} ELSE f END, 6) AS overlap_frac FROM (SELECT panel_id, (6.375e0 * ln(density) + 63.888e0) / 100 AS f FROM ({_DENSITY}))", "numbered cen")
def auto_overlap_frac(spark, d):
    return _density(spark, d).select("panel_id", _r(exprs.overlap_frac_column("density", P.w)).alias("overlap_frac"))


@_query("SELECT panel_id, chr, ind_idx, idx::INT AS idx, round(lod, 6) AS lod FROM scored", "scored")
def site_lod(spark, d):
    return scored_of(spark, d).select(*roh.ENTITY, "idx", _r("lod").alias("lod"))


@_query("SELECT panel_id, chr, ind_idx, idx::INT AS idx, round(lod, 6) AS lod FROM scored_gl", "scored_gl")
def site_lod_gl(spark, d):
    return scored_of(spark, d, exprs.gl_to_error(gq(), "GQ")).select(*roh.ENTITY, "idx", _r("lod").alias("lod"))


@_query(f"""SELECT c.ind_idx, c.chr, c.locus_idx, round({_GQ_ERROR}, 9) AS gq, round(least(greatest(1 - pow(10e0, greatest({_GQ} / -10000e0, -10e0)), 1e-16), 1e0), 9) AS gl,
round(least(greatest(1 - pow(10e0, greatest({_GQ} / 1000e0 / -10e0, -10e0)), 1e-16), 1e0), 9) AS pl FROM cur c""", "cur")
def gl_to_error(spark, d):
    q = gq()
    return calls_of(spark, d).select("ind_idx", "chr", "locus_idx", _r(exprs.gl_to_error(q, "GQ"), 9).alias("gq"), _r(exprs.gl_to_error(q / -10000.0, "GL"), 9).alias("gl"), _r(exprs.gl_to_error(q / 1000.0, "PL"), 9).alias("pl"))


@_query("SELECT panel_id, chr, locus_idx, idx::INT AS idx, brk FROM broken", "broken")
def gap_breaks(spark, d):
    return broken_sites(spark, d).select(*sites.SITE, "idx", "brk")


@_query("SELECT panel_id, chr, ind_idx, idx::INT AS idx, round(score, 6) AS score FROM win", "win")
def window_lod(spark, d):
    return windows_of(spark, d).select(*roh.ENTITY, "idx", _r("score").alias("score"))


@_query("SELECT panel_id, chr, ind_idx, idx::INT AS idx, round(score, 6) AS score FROM win_gl", "win_gl")
def window_lod_gl(spark, d):
    return windows_of(spark, d, error=exprs.gl_to_error(gq(), "GQ")).select(*roh.ENTITY, "idx", _r("score").alias("score"))


@_query("SELECT panel_id, chr, ind_idx, idx::INT AS idx FROM covered WHERE high = 1", "covered")
def high_windows(spark, d):
    return roh.coverage(windows_of(spark, d), P.cutoff, P.w).where("high = 1").select(*roh.ENTITY, "idx")


@_query("SELECT panel_id, chr, ind_idx, idx::INT AS idx, cov FROM covered", "covered")
def window_coverage(spark, d):
    return roh.coverage(windows_of(spark, d), P.cutoff, P.w).select(*roh.ENTITY, "idx", "cov")


@_query("SELECT * FROM segments", "segments")
def roh_segments(spark, d):
    return segments_of(spark, d)


_cte("cmsegments", "mcovered", _segments("mcovered", LEAST, "round(max(gpos) - min(gpos), 6)"))


@_query("SELECT * FROM cmsegments", "cmsegments")
def roh_segments_cm(spark, d):
    s = mapped_sites(spark, d)
    windows = roh.window_scores(roh.score_sites(calls_of(spark, d), s, P.error), P.w)
    return roh.assemble(windows, P.cutoff, P.w, P.overlap, cm=True).withColumn("length", _r("length"))


@_query(f"SELECT panel_id, chr, ind_idx, start, stop, length, {_CLASS} AS size_class FROM segments", "segments")
def roh_size_class(spark, d):
    return segments_of(spark, d).select(*roh.ENTITY, "start", "stop", "length", exprs.size_class("length", list(P.bounds)).alias("size_class"))


_TRACK = "'track name=\"Ind: ' || i.ind_id || ' Pop:' || coalesce(i.pop, 'NA') || ' ROH\" description=\"Ind: ' || i.ind_id || ' Pop:' || coalesce(i.pop, 'NA') || ' ROH\" visibility=2 itemRgb=\"On\"'"
_cte("inds", "", "SELECT ind_idx, max_by(ind_id, registered_at) AS ind_id, nullif(upper(trim(max_by(coalesce(pop, ''), registered_at), ' ' || chr(9))), '') AS pop FROM individuals GROUP BY ind_idx")


@_query(f"""SELECT i.ind_idx, 0::BIGINT AS start, {_TRACK} AS line FROM inds i
UNION ALL SELECT ind_idx, start, chr || chr(9) || start || chr(9) || stop || chr(9) || {_CLASS} || chr(9) || length || chr(9) || '.' || chr(9) || '0' || chr(9) || '0' || chr(9) || CASE {_CLASS} WHEN 'A' THEN '228,26,28' WHEN 'B' THEN '77,175,74' ELSE '55,126,184' END FROM segments""".replace("chr || chr(9)", "segments.chr || chr(9)"), "inds segments")
def roh_bed_rows(spark, d):
    from rohspark.sources import sinks

    return sinks.bed_rows(segments_of(spark, d), bed_individuals(spark, d), list(P.bounds)).select("ind_idx", "start", "line")


def bed_individuals(spark, d):
    """(ind_idx, ind_id, pop): the latest registrations."""
    t = table(spark, d, "individuals").where("ind_idx IS NOT NULL")
    pop = F.upper(F.trim("v.pop", F.lit(" \t")))
    return t.groupBy("ind_idx").agg(F.max(F.struct("registered_at", "ind_id", "pop")).alias("v")).select("ind_idx", F.col("v.ind_id").alias("ind_id"), F.when(pop != "", pop).alias("pop"))


@_query("SELECT panel_id, chr, locus_idx, ppos, round(gpos, 6) AS gpos, interpolated FROM mapped", "mapped")
def genmap_interpolate(spark, d):
    loci = loci_of(spark, d)
    kept = sites.filter_out_of_bounds(sites.call_freqs(calls_of(spark, d)), loci, table(spark, d, "centromeres"))
    return sites.interpolate_map(kept, loci).select(*sites.SITE, "ppos", _r("gpos").alias("gpos"), "interpolated")


def _numbered_calls(spark, d, s):
    return calls_of(spark, d).join(s.select("panel_id", "chr", "locus_idx", "idx"), sites.SITE)


def _pair_ld(spark, d, phased):
    s = materialise(mapped_sites(spark, d), "sites")
    return linkage.pair_ld(_numbered_calls(spark, d, s), s, P.w_ld, phased), s


@_query("SELECT panel_id, chr, i::INT AS i, j::INT AS j, round(ld + 1e-9, 6) AS ld FROM hr2", "hr2")
def pair_hr2(spark, d):
    return _pair_ld(spark, d, False)[0].withColumn("ld", _r(F.col("ld") + OFF))


@_query("SELECT panel_id, chr, i::INT AS i, j::INT AS j, round(ld + 1e-9, 6) AS ld FROM r2", "r2")
def pair_r2(spark, d):
    return _pair_ld(spark, d, True)[0].withColumn("ld", _r(F.col("ld") + OFF))


@_query("SELECT panel_id, chr, win_start::INT AS win_start, idx::INT AS idx, round(ld_sum + 1e-9, 6) AS ld_sum FROM ldw", "ldw")
def ld_weights(spark, d):
    pairs, s = _pair_ld(spark, d, False)
    return linkage.ld_weights(pairs, s, P.w_ld).withColumn("ld_sum", _r(F.col("ld_sum") + OFF))


@_query("SELECT panel_id, chr, idx::INT AS idx, round(weight, 6) AS weight FROM mbrk", "mbrk")
def site_weight(spark, d):
    return mapped_sites(spark, d).select("panel_id", "chr", "idx", _r("weight").alias("weight"))


def _weighted_windows(spark, d):
    pairs, s = _pair_ld(spark, d, False)
    scored = roh.score_sites(calls_of(spark, d), s, P.error)
    return linkage.weighted_window_scores(scored, linkage.ld_weights(pairs, s, P.w_ld), P.w_ld)


@_query("SELECT panel_id, chr, ind_idx, idx::INT AS idx, round(score, 6) AS score FROM wwin", "wwin")
def window_wlod(spark, d):
    return _weighted_windows(spark, d).select(*roh.ENTITY, "idx", _r("score").alias("score"))


@_query(_segments("wcovered", LEAST_LD), "wcovered")
def roh_segments_weighted(spark, d):
    return roh.assemble(_weighted_windows(spark, d), P.cutoff, P.w_ld, P.overlap)


@_query("SELECT panel_id, chr, ind_idx, idx::INT AS idx, round(x, 6) AS score FROM thinned", "thinned")
def thin_windows(spark, d):
    return roh.thin(windows_of(spark, d), P.w).select(*roh.ENTITY, "idx", _r("score").alias("score"))


def _densities(spark, d):
    points = materialise(roh.thinned_for_sizes(scored_of(spark, d), list(P.sizes)), "points")
    return density.kde(points, by=("panel_id", "w"))


def _points(spark, d, w=P.w):
    return materialise(roh.thin(windows_of(spark, d, w), w).select("panel_id", "score"), "points")


@_query("SELECT panel_id, n, round(lowest, 6) AS lowest, round(highest, 6) AS highest, round(h, 6) AS h FROM band", "band")
def kde_bandwidth(spark, d):
    b = density.bandwidth(_points(spark, d))
    return b.select("panel_id", "n", _r("lowest").alias("lowest"), _r("highest").alias("highest"), _r("h").alias("h"))


@_query("SELECT panel_id, i::INT AS i, round(x, 6) AS x, round(y, 6) AS y FROM kde", "kde")
def kde_density(spark, d):
    return density.kde(_points(spark, d)).select("panel_id", "i", _r("x").alias("x"), _r("y").alias("y"))


@_query("SELECT panel_id, round(wiggle, 6) AS wiggle FROM wig", "wig")
def kde_wiggle(spark, d):
    return density.wiggle(density.kde(_points(spark, d))).withColumn("wiggle", _r("wiggle"))


@_query("SELECT panel_id, round(cutoff, 6) AS cutoff FROM cutoffs", "cutoffs")
def lod_cutoff(spark, d):
    return density.lod_cutoffs(density.kde(_points(spark, d)), P.w).withColumn("cutoff", _r("cutoff"))


_cte("people", "cur", f"SELECT panel_id, ind_idx FROM (SELECT DISTINCT panel_id, ind_idx FROM cur) QUALIFY row_number() OVER (PARTITION BY panel_id ORDER BY md5(ind_idx || ':{P.seed}'), ind_idx) <= {P.kde_individuals}")
_cte("somethin", "thinned people", "SELECT t.* FROM thinned t JOIN people p ON p.panel_id = t.panel_id AND p.ind_idx = t.ind_idx")
_kde_ctes("somethin", "_some")


@_query("SELECT panel_id, i::INT AS i, round(x, 6) AS x, round(y, 6) AS y FROM kde_some", "kde_some")
def kde_subsample(spark, d):
    chosen = materialise(roh.subsample_individuals(calls_of(spark, d).select("panel_id", "ind_idx").distinct(), P.kde_individuals, P.seed), "people")
    points = windows_of(spark, d).join(broadcast_if_small(chosen), ["panel_id", "ind_idx"], "left_semi")
    return density.kde(materialise(roh.thin(points, P.w).select("panel_id", "score"), "points")).select("panel_id", "i", _r("x").alias("x"), _r("y").alias("y"))


@_query(" UNION ALL ".join(f"SELECT panel_id, {n} AS w, i::INT AS i, round(x, 6) AS x, round(y, 6) AS y FROM kde_w{n}" for n in P.sizes), " ".join(f"kde_w{n}" for n in P.sizes))
def explore_winsizes(spark, d):
    return _densities(spark, d).select("panel_id", "w", "i", _r("x").alias("x"), _r("y").alias("y"))


@_query("SELECT panel_id, coalesce(min(CASE WHEN wiggle <= 0.5 THEN w END), max(w))::INT AS w FROM (" + " UNION ALL ".join(f"SELECT panel_id, {n} AS w, wiggle FROM wig_w{n}" for n in P.sizes) + ") GROUP BY panel_id", " ".join(f"wig_w{n}" for n in P.sizes))
def select_winsize(spark, d):
    return density.first_smooth(density.wiggle(_densities(spark, d), ("panel_id", "w")), list(P.sizes))


def _kb(spark, d):
    return segments_of(spark, d).select((F.col("length") / 1000.0).alias("length"))


@_query("SELECT k::INT AS k, round(mean, 6) AS mean, round(var, 6) AS var, round(weight, 6) AS weight FROM init", "init")
def gmm_init(spark, d):
    m = mixture.init_gmm(mixture.length_counts(_kb(spark, d)), 3)
    return spark.createDataFrame([(i, a, b, c) for i, (a, b, c) in enumerate(zip(m.mean, m.var, m.weight))], "k int, mean double, var double, weight double").select("k", *(_r(c).alias(c) for c in ("mean", "var", "weight")))


_STEP = f"""
SELECT k::INT AS k, round(n / total, 6) AS weight, round(sx / n, 4) AS mean, round(sxx / n - pow(sx / n, 2), 2) AS var FROM (
  SELECT k, sum(r) AS n, sum(r * x) AS sx, sum(r * x * x) AS sxx, (SELECT count(*) FROM lens) AS total FROM (
    SELECT k, x, exp(l - m - ln(sum(exp(l - m)) OVER (PARTITION BY id))) AS r FROM (
      SELECT *, max(l) OVER (PARTITION BY id) AS m FROM (
        SELECT p.id, p.x, i.k, ln(i.weight) - 0.5e0 * ln(2 * {math.pi!r} * i.var) - pow(p.x - i.mean, 2) / (2 * i.var) AS l FROM (SELECT row_number() OVER () AS id, x FROM lens) p, init i))) GROUP BY k)"""


@_query(_STEP, "lens init")
def gmm_em_step(spark, d):
    counts = materialise(mixture.length_counts(_kb(spark, d)), "lengths")
    m = mixture.init_gmm(counts, 3)
    m = mixture.em_update(m, mixture.em_sums(counts, m).first())
    return spark.createDataFrame([(i, *v) for i, v in enumerate(zip(m.weight, m.mean, m.var))], "k int, weight double, mean double, var double").select("k", _r("weight").alias("weight"), _r("mean", 4).alias("mean"), _r("var", 2).alias("var"))


STEPS = 5


def _step(model: str) -> str:
    """SQL: the model after one EM step from `model`, and the log-likelihood that `model` had."""
    return f"""
  SELECT k, n / total AS weight, sx / n AS mean, sxx / n - pow(sx / n, 2) AS var, ll AS loglik FROM (
    SELECT k, sum(r) AS n, sum(r * x) AS sx, sum(r * x * x) AS sxx, (SELECT count(*) FROM lens) AS total, any_value(ll) AS ll FROM (
      SELECT k, x, exp(l - lse) AS r, sum(CASE WHEN k = 0 THEN lse ELSE 0e0 END) OVER () AS ll FROM (
        SELECT *, m + ln(sum(exp(l - m)) OVER (PARTITION BY id)) AS lse FROM (
          SELECT *, max(l) OVER (PARTITION BY id) AS m FROM (
            SELECT p.id, p.x, i.k, ln(i.weight) - 0.5e0 * ln(2 * {math.pi!r} * i.var) - pow(p.x - i.mean, 2) / (2 * i.var) AS l FROM numbered_lens p, {model} i)))) GROUP BY k)"""


_cte("numbered_lens", "lens", "SELECT row_number() OVER () AS id, x FROM lens")
for _n in range(STEPS):
    _cte(f"em{_n + 1}", f"lens numbered_lens {'em' + str(_n) if _n else 'init'}", _step(f"em{_n}" if _n else "init"))
_cte("ranked", f"em{STEPS}", f"SELECT *, row_number() OVER (ORDER BY mean) - 1 AS i FROM em{STEPS}")

def _five_steps(spark, d):
    return mixture.fit_gmm(_kb(spark, d), 3, max_iter=STEPS, tol=-1.0)


@_query("SELECT i::INT AS i, round(weight, 5) AS weight, round(mean, 3) AS mean, round(var, 1) AS var, round(loglik, 3) AS loglik, round(-2 * loglik + 8 * ln((SELECT count(*) FROM lens)), 3) AS bic FROM ranked", "ranked lens")
def gmm_em_steps(spark, d):
    m = _five_steps(spark, d)
    rows = spark.createDataFrame([(i, *v, m.loglik, m.bic) for i, v in enumerate(zip(m.weight, m.mean, m.var))], "i int, weight double, mean double, var double, loglik double, bic double")
    return rows.select("i", _r("weight", 5).alias("weight"), _r("mean", 3).alias("mean"), _r("var", 1).alias("var"), _r("loglik", 3).alias("loglik"), _r("bic", 3).alias("bic"))


@_query("SELECT i::INT AS i, true AS densities_meet, true AS between_means FROM (SELECT unnest(range(2)) AS i)")
def size_bounds_meet(spark, d):
    """Whether the bounds of the fitted classes lie where the weighted densities of neighbours are equal."""
    m = mixture.fit_gmm(_kb(spark, d), 3)
    classes = list(zip(m.weight, m.mean, m.var))
    rows = [(i, x, *a, *b) for i, (x, a, b) in enumerate(zip(mixture.size_bounds(m), classes, classes[1:]))]
    found = spark.createDataFrame(rows, "i int, x double, a1 double, m1 double, v1 double, a2 double, m2 double, v2 double")
    log = [F.ln(f"a{k}") - 0.5 * F.ln(f"v{k}") - F.pow(F.col("x") - F.col(f"m{k}"), F.lit(2.0)) / (2 * F.col(f"v{k}")) for k in (1, 2)]
    return found.select("i", (F.abs(log[0] - log[1]) < 1e-6).alias("densities_meet"), F.col("x").between(F.col("m1"), F.col("m2")).alias("between_means"))


@_query()
def gmm_fit(spark, d):
    m = mixture.fit_gmm(_kb(spark, d), 3)
    return spark.createDataFrame([(i, *v, m.loglik, m.bic, m.iterations) for i, v in enumerate(zip(m.weight, m.mean, m.var))], "k int, weight double, mean double, var double, loglik double, bic double, iterations int")


@_query()
def size_bounds(spark, d):
    m = mixture.fit_gmm(_kb(spark, d), 3)
    return spark.createDataFrame([(i, b) for i, b in enumerate(mixture.size_bounds(m))], "i int, bound_kb double")


_FLIP = "CASE WHEN l.locus_idx % 4 = 0 THEN 1 - f.freq ELSE f.freq END"


@_query("SELECT l.panel_id, l.chr, l.locus_name, l.allele, round(f.freq, 6) AS freq FROM loc l JOIN freqs f ON f.panel_id = l.panel_id AND f.chr = l.chr AND f.locus_idx = l.locus_idx", "loc freqs")
def freq_file_flip(spark, d):
    loci = loci_of(spark, d)
    own = loci.join(sites.call_freqs(calls_of(spark, d)).select(*sites.SITE, "freq"), sites.SITE)
    other = F.pmod("locus_idx", F.lit(4)) == 0
    file = own.select("panel_id", "chr", "locus_name", F.when(other, F.lit("-")).otherwise(F.col("allele")).alias("allele"), F.when(other, 1 - F.col("freq")).otherwise(F.col("freq")).alias("freq"))
    return sites.flip_freqs(own.select("panel_id", "chr", "locus_name", "allele"), file).withColumn("freq", _r("freq"))


@_query("SELECT panel_id, chr, ind_idx, string_agg(coalesce(printf('%.6f', score), 'NA'), ' ' ORDER BY idx) AS line FROM win GROUP BY panel_id, chr, ind_idx", "win")
def raw_lod_rows(spark, d):
    return roh.raw_lod_rows(windows_of(spark, d))


EFFECTS = ("benign", "damaging", "neutral")
_cte("feat", "loc", "SELECT panel_id, chr, ppos, allele, ['benign', 'damaging', 'neutral'][(min(locus_idx) % 3) + 1] AS effect FROM loc WHERE locus_idx % 5 = 0 GROUP BY panel_id, chr, ppos, allele")
_cte("placed", "cur loc feat segments", f"""
  SELECT c.panel_id, c.ind_idx, f.effect, coalesce(max({_CLASS.replace("length", "s.length")}) FILTER (WHERE s.start IS NOT NULL), 'NONE') AS size_class FROM cur c
  JOIN loc l ON l.panel_id = c.panel_id AND l.chr = c.chr AND l.locus_idx = c.locus_idx AND c.g = 2 JOIN feat f ON f.panel_id = l.panel_id AND f.chr = l.chr AND f.ppos = l.ppos AND f.allele = l.allele
  LEFT JOIN segments s ON s.panel_id = c.panel_id AND s.chr = c.chr AND s.ind_idx = c.ind_idx AND l.ppos BETWEEN s.start AND s.stop - 1 GROUP BY c.panel_id, c.ind_idx, c.chr, c.locus_idx, f.effect""")


def _placed(spark, d):
    loci = loci_of(spark, d)
    effect = F.element_at(F.array(*map(F.lit, EFFECTS)), F.pmod(F.min("locus_idx"), F.lit(3)) + 1)
    marked = loci.where(F.pmod("locus_idx", F.lit(5)) == 0).groupBy("panel_id", "chr", "ppos", "allele").agg(effect.alias("effect"))  # every fifth site bears an annotation
    points = features.homozygous_features(calls_of(spark, d), loci, marked)
    classed = segments_of(spark, d).withColumn("size_class", exprs.size_class("length", list(P.bounds)))
    return features.inside_segments(points, classed)


@_query("SELECT panel_id, ind_idx, size_class, effect, count(*) AS n FROM placed GROUP BY panel_id, ind_idx, size_class, effect", "placed")
def roh_feature_counts(spark, d):
    return features.feature_counts(_placed(spark, d))


@_query("SELECT c.panel_id, c.ind_idx, " + ", ".join(f"count(*) FILTER (WHERE effect = '{e}' AND size_class = '{c}') AS {e}{c}" for e in EFFECTS for c in ("A", "B", "C", "NONE")) + " FROM (SELECT DISTINCT panel_id, ind_idx FROM cur) c LEFT JOIN placed p ON p.panel_id = c.panel_id AND p.ind_idx = c.ind_idx GROUP BY c.panel_id, c.ind_idx", "cur placed")
def feature_counts_pivot(spark, d):
    return features.pivot_counts(features.feature_counts(_placed(spark, d)), calls_of(spark, d), list(EFFECTS))


@_query("SELECT l.panel_id, l.chr, l.locus_idx, coalesce(c.c_start, 0) AS c_start, coalesce(c.c_end, 0) AS c_end FROM loc l LEFT JOIN cen c ON c.chr = l.chr", "loc cen")
def centromere_lookup(spark, d):
    return sites.with_centromeres(loci_of(spark, d), table(spark, d, "centromeres")).select(*sites.SITE, "c_start", "c_end")


@_query("""SELECT panel_id, count(*) AS rows, count(DISTINCT ind_id) AS ids, count(DISTINCT pop) AS pops, count(*) > count(DISTINCT ind_id) AS repeated, count(DISTINCT pop) > 1 AS mixed
FROM (SELECT panel_id, ind_id, upper(trim(pop, ' ' || chr(9))) AS pop FROM individuals) GROUP BY panel_id""")
def tfam_validate(spark, d):
    from rohspark.sources import readers

    t = table(spark, d, "individuals").select("panel_id", "ind_id", F.upper(F.trim("pop", F.lit(" \t"))).alias("pop"))
    return readers.tfam_report(t)
