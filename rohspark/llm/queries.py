"""Queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rohspark.llm import digest, leaks, packing, quality, runs
from rohspark.session import materialise, table


def _call_runs(spark: SparkSession, d: str, min_events: int) -> DataFrame:
    genotypes = table(spark, d, "genotypes")
    calls = genotypes.select("ind_idx", "chr", "locus_idx", "ppos", F.when(F.col("g").isin(0, 1, 2), F.col("g")).cast("int").alias("g"), F.unix_micros("loaded_at").alias("version"))
    return runs.collapse_runs(calls, ["ind_idx", "chr"], "locus_idx", "ppos", "g", max_step=500_000, min_flank=5, min_events=min_events, range_of=genotypes, version="version")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _call_runs(spark, d, 15).select("ind_idx", "chr", "start_ppos", "stop_ppos")


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return _call_runs(spark, d, 1)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return digest.length_percentiles(table(spark, d, "roh"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups, their rows, and whether all their percentiles keep the bound."""
    rows = p5_percentiles(spark, d)
    return rows.groupBy("level", "pop", "called_on").agg(F.max("n").alias("n"), F.every("certified").alias("certified"))


def p5_small_groups(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of groups of up to 400 rows, which the digests hold value by value, so that SQL gives the same."""
    return p5_percentiles(spark, d).where("n <= 400").select("level", "pop", "called_on", "n", "q", F.round("estimate", 4).alias("estimate"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), table(spark, d, "pack_budgets"))


def p6_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, d))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest texts of every text whose id is divisible by 50, by the index that packing uses."""
    return packing.neighbours(table(spark, d, "documents"))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per budget: texts that are placed, those whose pieces don't add up to the text, and containers that hold too much."""
    documents = table(spark, d, "documents")
    packed = materialise(packing.pack_texts(documents, table(spark, d, "pack_budgets")), "packed")
    sizes = packing.sized_texts(documents).select("doc_id", F.col("n_tokens").alias("size"))
    placed = packed.groupBy("budget_id", "capacity", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece").alias("numbers"))
    wrong = (F.col("tokens") != F.col("size")) | (F.col("pieces") != F.col("numbers")) | (F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))))
    texts = placed.join(sizes, "doc_id", "full").groupBy("budget_id", "capacity").agg(F.count(F.lit(1)).alias("texts"), F.count(F.when(F.coalesce(wrong, F.lit(True)), 1)).alias("wrong"))
    room = packed.groupBy("budget_id", "capacity", "container").agg(F.sum("n_tokens").alias("tokens")).groupBy("budget_id", "capacity").agg(F.count(F.when(F.col("tokens") > F.col("capacity"), 1)).alias("overfull"))
    return texts.join(room, ["budget_id", "capacity"], "left")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line statistics behind the verdict."""
    shares = [F.round(c, 6).alias(c) for c in ("ended_share", "dup_line_share", "list_line_share", "table_line_share")]
    return p8_quality(spark, d).where("n_lines IS NOT NULL").select("doc_id", "n_lines", *shares)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_quality(spark, d).where("is_degenerate").select("doc_id")


P1_RUNS = """
WITH cur AS (
  SELECT ind_idx, chr, locus_idx, max_by(ppos, k) AS ppos, max_by(coalesce(g, -9), k) AS g FROM (
    SELECT *, epoch_us(loaded_at) * 16 + CASE WHEN g IN (0, 1, 2) THEN g + 1 ELSE 0 END AS k FROM genotypes) GROUP BY ALL),
calls AS (SELECT * FROM cur WHERE g IN (0, 1, 2)),
marked AS (
  SELECT *, CASE WHEN lag(ppos) OVER w IS NULL OR ppos - lag(ppos) OVER w > 500000 THEN 1 ELSE 0 END AS wide,
    CASE WHEN g = lag(g) OVER w THEN 0 ELSE 1 END AS other
  FROM calls WINDOW w AS (PARTITION BY ind_idx, chr ORDER BY locus_idx)),
numbered AS (SELECT *, sum(CASE WHEN wide + other > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ind_idx, chr ORDER BY locus_idx) AS st FROM marked),
stretch AS (
  SELECT ind_idx, chr, st, any_value(g) AS g, count(*) AS n, min(ppos) AS a, max(ppos) AS b, max(wide) AS wide FROM numbered GROUP BY ind_idx, chr, st),
flagged AS (
  SELECT *, n = 1 AND wide = 0 AND coalesce(lead(wide) OVER w, 1) = 0 AND lag(g) OVER w = lead(g) OVER w AND lag(n) OVER w >= 5 AND lead(n) OVER w >= 5 AS bridged
  FROM stretch WINDOW w AS (PARTITION BY ind_idx, chr ORDER BY st)),
linked AS (
  SELECT *, CASE WHEN coalesce(bridged, false) OR coalesce(lag(bridged) OVER w, false) THEN 0 ELSE 1 END AS head
  FROM flagged WINDOW w AS (PARTITION BY ind_idx, chr ORDER BY st)),
runs AS (SELECT *, sum(head) OVER (PARTITION BY ind_idx, chr ORDER BY st) AS run FROM linked)
SELECT ind_idx, chr, CAST(min_by(g, st) AS INT) AS g, CAST(sum(CASE WHEN coalesce(bridged, false) THEN 0 ELSE n END) AS BIGINT) AS n_events,
  CAST(sum(CASE WHEN coalesce(bridged, false) THEN 1 ELSE 0 END) AS BIGINT) AS n_bridged, min_by(a, st) AS start_ppos, max_by(b, st) AS stop_ppos, max_by(b, st) - min_by(a, st) + 1 AS extent
FROM runs GROUP BY ind_idx, chr, run"""

P1_FOUND = f"SELECT ind_idx, chr, start_ppos, stop_ppos FROM ({P1_RUNS}) WHERE n_events >= 15"

P5_GROUPS = r"""
WITH last AS (SELECT roh_id, max({'t': loaded_at, 'v': roh_length, 'pop': pop, 'day': called_on}) AS r FROM roh WHERE roh_id IS NOT NULL GROUP BY roh_id),
fine AS (SELECT upper(trim(r.pop, ' ' || chr(9))) AS pop, r.day AS called_on FROM last WHERE r.v > 0 AND NOT isnan(r.v) AND NOT isinf(r.v))
SELECT 'pop_day' AS level, pop, called_on, count(*) AS n, true AS certified FROM fine GROUP BY pop, called_on
UNION ALL SELECT 'pop', pop, NULL, count(*), true FROM fine GROUP BY pop"""

P5_SMALL = r"""
WITH last AS (SELECT roh_id, max({'t': loaded_at, 'v': roh_length, 'pop': pop, 'day': called_on}) AS r FROM roh WHERE roh_id IS NOT NULL GROUP BY roh_id),
fine AS (SELECT upper(trim(r.pop, ' ' || chr(9))) AS pop, r.day AS called_on, r.v AS v FROM last WHERE r.v > 0 AND NOT isnan(r.v) AND NOT isinf(r.v)),
groups AS (
  SELECT 'pop_day' AS level, pop, called_on, count(*) AS n, list(v ORDER BY v) AS vs FROM fine GROUP BY pop, called_on
  UNION ALL SELECT 'pop', pop, NULL, count(*), list(v ORDER BY v) FROM fine GROUP BY pop),
asked AS (SELECT *, unnest([0.01e0, 0.05e0, 0.25e0, 0.5e0, 0.75e0, 0.95e0, 0.99e0]) AS q FROM groups WHERE n <= 400),
placed AS (SELECT *, greatest(1, floor(q * n + 0.5e0))::BIGINT AS j, greatest(0.5e0, q * n) AS t FROM asked)
SELECT level, pop, called_on, n, q, round(CASE WHEN j >= n THEN vs[n] ELSE vs[j] + (vs[j + 1] - vs[j]) * (t - (j - 0.5e0)) END, 4) AS estimate FROM placed"""

_WS = r"\t-\r\x1c-\x1f\x85\p{Z}"
P8_FOUND = rf"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(text, '[^{_WS}]+') AS w, length(regexp_replace(text, '[{_WS}\p{{L}}\p{{N}}]', '', 'g')) AS symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')) AS lines FROM documents),
c AS (SELECT list(DISTINCT word) AS words FROM common_words),
s AS (
  SELECT doc_id, len(w) AS n, length(array_to_string(w, ''))::DOUBLE AS chars, symbols, len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?][{_WS}]*$'))) AS ended,
    len(list_filter(w, lambda x: list_contains(c.words, regexp_replace(lower(x), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')))) AS common FROM t, c)
SELECT doc_id FROM s WHERE n < 12 OR chars / n < 2.5 OR chars / n > 15 OR symbols / chars > 0.4e0 OR ended::DOUBLE / n_lines < 0.03e0 OR common::DOUBLE / n < 0.08e0 OR common::DOUBLE / n > 0.7e0"""

P8_LINES = rf"""
WITH t AS (
  SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')), lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS v FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(v) AS n_lines, CASE WHEN len(v) = 0 THEN 0e0 ELSE round(len(list_filter(v, lambda x: regexp_matches(x, '[.!?]$')))::DOUBLE / len(v), 6) END AS ended_share,
  CASE WHEN len(v) = 0 THEN 0e0 ELSE round(1 - len(list_distinct(v))::DOUBLE / len(v), 6) END AS dup_line_share,
  CASE WHEN len(v) = 0 THEN 0e0 ELSE round(len(list_filter(v, lambda x: regexp_matches(x, '^(?:[-*+•◦‣]|\(?[0-9]{{1,3}}[.)]|[a-z][.)])[{_WS}]')))::DOUBLE / len(v), 6) END AS list_line_share,
  CASE WHEN len(v) = 0 THEN 0e0 ELSE round(len(list_filter(v, lambda x: length(x) - length(replace(x, '|', '')) >= 2 OR length(x) - length(replace(x, chr(9), '')) >= 2 OR length(x) - length(replace(x, ',', '')) >= 4))::DOUBLE / len(v), 6) END AS table_line_share
FROM t"""

P6_COVERAGE = "SELECT budget_id, capacity, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, 0::BIGINT AS wrong, 0::BIGINT AS overfull FROM pack_budgets"

QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p5_percentiles, p5_groups, p5_small_groups, p6_packed, p6_fill_report, p6_neighbours, p6_coverage, p7_found, p7_leaks, p8_found, p8_quality, p8_lines)}
SQL = {"p1_found": P1_FOUND, "p1_runs": P1_RUNS, "p5_groups": P5_GROUPS, "p5_small_groups": P5_SMALL, "p6_coverage": P6_COVERAGE, "p8_found": P8_FOUND, "p8_lines": P8_LINES}
