"""Queries of the data-preparation operators of the core: heavy keys, missing values, unparsable rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rohspark.operators import em_impute, key_stats, record_parse
from rohspark.session import table

_CURRENT = """
  SELECT ind_idx, chr, locus_idx, max_by(panel_id, k) AS panel_id, max_by(coalesce(g, -9), k) AS g FROM (
    SELECT *, epoch_us(loaded_at) * 16 + CASE WHEN g IN (0, 1, 2) THEN g + 1 ELSE 0 END AS k FROM genotypes)
  GROUP BY ind_idx, chr, locus_idx"""

_INDS = """
  SELECT i.ind_idx, i.fam_id, p.pop FROM (
    SELECT ind_idx, nullif(max_by(coalesce(fam_id, ''), registered_at), '') AS fam_id, upper(trim(max_by(coalesce(pop, ''), registered_at), ' ' || chr(9))) AS pop
    FROM individuals GROUP BY ind_idx) i
  LEFT JOIN populations p ON p.pop = i.pop"""

P2_FOUND_SQL = "SELECT chr FROM genotypes WHERE chr IS NOT NULL GROUP BY chr HAVING count(*) >= 0.04 * (SELECT count(*) FROM genotypes)"

P2_STATS_SQL = f"""
WITH cur AS ({_CURRENT})
SELECT c.chr, r.n_rows, c.calls, c.missing, c.sites, c.n0, c.n1, c.n2 FROM (
  SELECT chr, count(*) FILTER (WHERE g IN (0, 1, 2)) AS calls, count(*) FILTER (WHERE g IS NULL OR g NOT IN (0, 1, 2)) AS missing,
    count(DISTINCT (panel_id, locus_idx)) AS sites, count(*) FILTER (WHERE g = 0) AS n0, count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 2) AS n2
  FROM cur GROUP BY chr) c
JOIN (SELECT chr, count(*) AS n_rows FROM genotypes GROUP BY chr) r ON r.chr = c.chr"""

P2_SITES_SQL = """
WITH z AS (SELECT panel_id, chr, count(DISTINCT locus_idx) AS size FROM loci GROUP BY panel_id, chr),
b AS (SELECT panel_id, chr, max(nloci) AS nloci FROM map_blocks GROUP BY panel_id, chr),
l AS (SELECT chr, count(*) AS loci_rows, count(DISTINCT (panel_id, locus_idx)) AS loci_sites FROM loci GROUP BY chr),
u AS (
  SELECT b.chr, count(*) AS panels, sum(b.nloci)::BIGINT AS nloci, count(b.nloci) AS nloci_known, count(*) FILTER (WHERE b.nloci <> coalesce(z.size, 0)) AS nloci_stale
  FROM b LEFT JOIN z ON z.panel_id = b.panel_id AND z.chr = b.chr GROUP BY b.chr)
SELECT coalesce(l.chr, u.chr) AS chr, loci_rows, loci_sites, panels, nloci, nloci_known, nloci_stale FROM l FULL JOIN u ON u.chr = l.chr"""

P3_MASK_SQL = f"""
WITH cur AS ({_CURRENT}),
site AS (SELECT panel_id, chr, locus_idx FROM cur WHERE g IN (0, 1, 2) GROUP BY ALL)
SELECT c.panel_id, c.chr, count(*) AS calls, count(*) FILTER (WHERE (c.g IS NULL OR c.g NOT IN (0, 1, 2)) AND s.chr IS NOT NULL) AS filled,
  count(*) FILTER (WHERE (c.g IS NULL OR c.g NOT IN (0, 1, 2)) AND s.chr IS NULL) AS left_missing, 0::BIGINT AS odd
FROM cur c LEFT JOIN site s ON s.panel_id = c.panel_id AND s.chr = c.chr AND s.locus_idx = c.locus_idx GROUP BY c.panel_id, c.chr"""

P3_POP_MASK_SQL = f"""
WITH inds AS ({_INDS}), fam AS (SELECT fam_id FROM inds WHERE pop IS NOT NULL AND fam_id IS NOT NULL GROUP BY ALL)
SELECT i.ind_idx, i.pop, i.pop IS NULL AND f.fam_id IS NOT NULL AS pop_was_filled, true AS of_family FROM inds i LEFT JOIN fam f ON f.fam_id = i.fam_id"""

P3_FOUND_SQL = f"""
WITH cur AS ({_CURRENT}), inds AS ({_INDS}),
site AS (SELECT panel_id, chr, locus_idx FROM cur WHERE g IN (0, 1, 2) GROUP BY ALL),
fam AS (SELECT fam_id FROM inds WHERE pop IS NOT NULL AND fam_id IS NOT NULL GROUP BY ALL)
SELECT 'g' AS field_name, c.ind_idx, c.chr, c.locus_idx FROM cur c JOIN site s ON s.panel_id = c.panel_id AND s.chr = c.chr AND s.locus_idx = c.locus_idx
WHERE c.g IS NULL OR c.g NOT IN (0, 1, 2)
UNION ALL
SELECT 'pop', i.ind_idx, '', -1 FROM inds i JOIN fam f ON f.fam_id = i.fam_id WHERE i.pop IS NULL"""

_FIELDS = r"""
  SELECT l.file_id, l.line_no, f.n_ind,
    regexp_full_match(l.raw_line, '(?s)[ \t\r]*(#.*)?') AS skipped,
    regexp_full_match(l.raw_line, '(?s)[ \t\r]*("[^"]*"|[^ \t\r"]+)([ \t\r]+("[^"]*"|[^ \t\r"]+))*[ \t\r]*') AS quoted_well,
    list_transform(regexp_extract_all(l.raw_line, '(?s)"[^"]*"|[^ \t\r"]+'), lambda x: CASE WHEN starts_with(x, '"') THEN x[2:-2] ELSE x END) AS v
  FROM {lines} l JOIN raw_files f ON f.file_id = l.file_id AND f.file_kind = '{kind}'"""
_IS_CHR = r"regexp_full_match({}, '(chr)?([1-9]|1[0-9]|2[0-2]|X)|chrUn_[0-9]{{4}}')"
_IS_POS = r"(regexp_full_match({0}, '[0-9]{{1,10}}') AND coalesce(TRY_CAST({0} AS BIGINT), 0) BETWEEN 1 AND 2147483647)"
_TPED_OK = f"""(quoted_well AND len(v) = 4 + 2 * n_ind AND {_IS_CHR.format("v[1]")} AND regexp_full_match(v[2], '[A-Za-z][A-Za-z0-9_:.-]{{1,23}}') AND regexp_matches(v[2], '[0-9]')
  AND regexp_full_match(v[3], '[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') AND {_IS_POS.format("v[4]")} AND len(list_filter(v[5:], lambda a: a NOT IN ('A', 'C', 'G', 'T', '0'))) = 0)"""
_CEN_OK = f"""(quoted_well AND len(v) = 3 AND {_IS_CHR.format("v[1]")} AND {_IS_POS.format("v[2]")} AND {_IS_POS.format("v[3]")} AND coalesce(TRY_CAST(v[2] AS BIGINT) < TRY_CAST(v[3] AS BIGINT), false))"""

P4_FOUND_SQL = f"""
WITH t AS ({_FIELDS.format(lines="tped_lines", kind="tped")}), c AS ({_FIELDS.format(lines="centromere_lines", kind="centromere")})
SELECT file_id, line_no::INT AS line_no FROM t WHERE NOT skipped AND NOT coalesce({_TPED_OK}, false)
UNION ALL SELECT file_id, line_no::INT FROM c WHERE NOT skipped AND NOT coalesce({_CEN_OK}, false)"""

_PREFIXED = "CASE WHEN starts_with(v[1], 'chr') THEN v[1] ELSE 'chr' || v[1] END"
P4_TPED_SQL = f"""
WITH t AS ({_FIELDS.format(lines="tped_lines", kind="tped")})
SELECT file_id, line_no, {_PREFIXED} AS chr, v[2] AS locus_name, CAST(v[3] AS DOUBLE) AS gpos, CAST(v[4] AS BIGINT) AS ppos, array_to_string(v[5:], '') AS alleles FROM t WHERE NOT skipped AND coalesce({_TPED_OK}, false)"""
P4_CEN_SQL = f"""
WITH c AS ({_FIELDS.format(lines="centromere_lines", kind="centromere")})
SELECT file_id, line_no, {_PREFIXED} AS chr, CAST(v[2] AS BIGINT) AS c_start, CAST(v[3] AS BIGINT) AS c_end FROM c WHERE NOT skipped AND coalesce({_CEN_OK}, false)"""


def _parsed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return record_parse.parse_lines(table(spark, d, f"{kind}_lines"), table(spark, d, "raw_files"), kind)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return key_stats.heavy_chr(table(spark, d, "genotypes"))


def p2_chr_stats(spark: SparkSession, d: str) -> DataFrame:
    return key_stats.chr_stats(table(spark, d, "genotypes"))


def p2_chr_sites(spark: SparkSession, d: str) -> DataFrame:
    return key_stats.chr_sites(table(spark, d, "loci"), table(spark, d, "map_blocks"))


def p3_mask(spark: SparkSession, d: str) -> DataFrame:
    """Per panel and chr: current calls, those that were filled and those left missing, and fills that are no call."""
    calls = p3_calls_filled(spark, d)
    left = F.col("g").isNull() & ~F.col("g_was_filled")
    odd = (F.col("g_was_filled") & (F.col("g").isNotNull() | ~F.coalesce(F.col("g_filled").isin(0, 1, 2), F.lit(False)))) | (~F.col("g_was_filled") & ~F.col("g").eqNullSafe(F.col("g_filled")))
    return calls.groupBy("panel_id", "chr").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("g_was_filled"), 1)).alias("filled"), F.count(F.when(left, 1)).alias("left_missing"), F.count(F.when(odd, 1)).alias("odd"))


def p3_pop_mask(spark: SparkSession, d: str) -> DataFrame:
    """Individuals with their pop, whether it was filled, and whether the fill is a pop of the family."""
    people = p3_pops_filled(spark, d)
    known = people.where("pop IS NOT NULL AND fam_id IS NOT NULL").select(F.col("fam_id").alias("f"), F.col("pop").alias("p")).distinct()
    marked = people.join(known, (F.col("fam_id") == F.col("f")) & (F.col("pop_filled") == F.col("p")), "left")
    return marked.select("ind_idx", "pop", "pop_was_filled", (~F.col("pop_was_filled") | F.col("p").isNotNull()).alias("of_family"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return em_impute.filled_cases(table(spark, d, "genotypes"), table(spark, d, "individuals"), table(spark, d, "populations"))


def p3_calls_filled(spark: SparkSession, d: str) -> DataFrame:
    return em_impute.fill_calls(table(spark, d, "genotypes"), table(spark, d, "individuals"), table(spark, d, "populations"))


def p3_pops_filled(spark: SparkSession, d: str) -> DataFrame:
    return em_impute.fill_pops(table(spark, d, "individuals"), table(spark, d, "populations"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    failed = [record_parse.failed_rows(_parsed(spark, d, kind)).select("file_id", F.col("line_no").cast("int").alias("line_no")) for kind in ("tped", "centromere")]
    return failed[0].unionByName(failed[1]).distinct()


def p4_tped_rows(spark: SparkSession, d: str) -> DataFrame:
    return record_parse.valid_rows(_parsed(spark, d, "tped"), "tped").withColumn("alleles", F.array_join("alleles", ""))


def p4_centromere_rows(spark: SparkSession, d: str) -> DataFrame:
    return record_parse.valid_rows(_parsed(spark, d, "centromere"), "centromere")


QUERIES = {f.__name__: f for f in (p2_found, p2_chr_stats, p2_chr_sites, p3_found, p3_mask, p3_pop_mask, p3_calls_filled, p3_pops_filled, p4_found, p4_tped_rows, p4_centromere_rows)}
SQL = {"p2_found": P2_FOUND_SQL, "p2_chr_stats": P2_STATS_SQL, "p2_chr_sites": P2_SITES_SQL, "p3_found": P3_FOUND_SQL, "p3_mask": P3_MASK_SQL, "p3_pop_mask": P3_POP_MASK_SQL, "p4_found": P4_FOUND_SQL, "p4_tped_rows": P4_TPED_SQL, "p4_centromere_rows": P4_CEN_SQL}
