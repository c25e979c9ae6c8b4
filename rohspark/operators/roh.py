"""Window scores and their assembly into runs of homozygosity.

All steps keep the partitioning (panel, chr, individual) and the order of position, so that one exchange
and one sort serve the window scores, the coverage and the segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rohspark.functions import exprs
from rohspark.operators.sites import with_centromeres

ENTITY = ["panel_id", "chr", "ind_idx"]


def _w():
    return Window.partitionBy(*ENTITY).orderBy("ppos", "locus_idx")


def site_breaks(numbered: DataFrame, centromeres: DataFrame, max_gap: int) -> DataFrame:
    """Numbered sites with `brk`: 1 where the step from the previous site is too wide or meets the centromere."""
    w = Window.partitionBy("panel_id", "chr").orderBy("idx")
    before = F.lag("ppos").over(w)
    placed = with_centromeres(numbered, centromeres)
    wide = (F.col("ppos") - before > max_gap) | exprs.in_gap(before, F.col("ppos"), F.col("c_start"), F.col("c_end"))
    return placed.withColumn("brk", F.coalesce(wide, F.lit(False)).cast("int")).drop("c_start", "c_end")


def score_sites(calls: DataFrame, sites: DataFrame, error: float | Column = 0.001) -> DataFrame:
    """(entity, locus_idx, idx, ppos, brk, lod) of each call at a site that is left; `sites` has idx, freq and brk.

    `calls` has one row per individual and site. `error` may be a column of `calls`. The join is a merge whatever the
    sizes of files say: Parquet holds a call in under a byte, so millions of calls would pass for a table to broadcast.
    """
    kept = [c for c in ("gpos", "weight") if c in sites.columns]
    s = sites.select("panel_id", "chr", "locus_idx", "idx", F.col("ppos").alias("site_ppos"), "freq", "brk", *kept)
    joined = calls.hint("merge").join(s, ["panel_id", "chr", "locus_idx"])
    score = exprs.lod(F.col("g"), F.col("freq"), error if isinstance(error, Column) else F.lit(error))
    return joined.select(*ENTITY, "locus_idx", "idx", F.col("site_ppos").alias("ppos"), "brk", *kept, score.alias("lod"))


def score_calls(calls: DataFrame, centromeres: DataFrame, max_gap: int, error: float | Column = 0.001) -> DataFrame:
    """What `score_sites` gives for polymorphic sites and frequencies of the calls themselves, without a join.

    `calls` has one row per individual and site. The frequency is a window over the site's calls; the
    place of a site and the step from the one before are the same for every individual, so they are taken
    from its own rows, in the exchange that the window scores need anyway.
    """
    site = Window.partitionBy("panel_id", "chr", "locus_idx")
    counted = calls.withColumns({"_n": F.count("g").over(site), "_s": F.sum("g").over(site), "ppos": F.max("ppos").over(site)})
    left = counted.where((F.col("_s") > 0) & (F.col("_s") < 2 * F.col("_n"))).withColumn("freq", F.col("_s") / (2 * F.col("_n")))
    score = exprs.lod(F.col("g"), F.col("freq"), error if isinstance(error, Column) else F.lit(error))
    scored = with_centromeres(left.select(*ENTITY, "locus_idx", "ppos", score.alias("lod")), centromeres)
    before = F.lag("ppos").over(_w())
    wide = (F.col("ppos") - before > max_gap) | exprs.in_gap(before, F.col("ppos"), F.col("c_start"), F.col("c_end"))
    placed = scored.withColumns({"idx": F.row_number().over(_w()) - 1, "brk": F.coalesce(wide, F.lit(False)).cast("int")})
    return placed.select(*ENTITY, "locus_idx", "idx", "ppos", "brk", "lod")


def _upto(last: int) -> Window:
    """All rows of the entity up to `last` places behind the current one: a frame to which each row is added once, whatever `last` is."""
    return _w().rowsBetween(Window.unboundedPreceding, last)


def _window_sum(value: str, w: int) -> Column:
    """The sum over the row and the w - 1 behind it, as a difference of running sums; null as `window_scores` says."""
    whole = F.count(F.lit(1)).over(_upto(w - 1)) - F.count(F.lit(1)).over(_upto(0)) == w - 1
    unbroken = F.sum("brk").over(_upto(w - 1)) == F.sum("brk").over(_upto(0))
    return F.when(whole & unbroken, F.sum(value).over(_upto(w - 1)) - F.coalesce(F.sum(value).over(_upto(-1)), F.lit(0.0)))


def window_scores(scored: DataFrame, w: int, value: str = "lod") -> DataFrame:
    """`scored` with `score`: the sum of `value` over the site and the w - 1 behind it.

    Null where the chromosome ends sooner or a break lies within.
    """
    if w < 2:
        raise ValueError("a window has at least two sites")
    return scored.withColumn("score", _window_sum(value, w))


def thinned_for_sizes(scored: DataFrame, sizes: list[int], value: str = "lod") -> DataFrame:
    """(panel_id, w, score): what `thin` leaves of the scores of each window size, all from one pass over the sorted rows."""
    windows = scored.withColumns({f"_s{w}": _window_sum(value, w) for w in sizes})
    kept = [F.when((F.pmod("idx", F.lit(w)) == 0) & F.col(f"_s{w}").isNotNull() & ~F.isnan(f"_s{w}"), F.struct(F.lit(w).alias("w"), F.col(f"_s{w}").alias("score"))) for w in sizes]
    return windows.select("panel_id", F.explode(F.array_compact(F.array(*kept))).alias("e")).select("panel_id", "e.w", "e.score")


def coverage(windows: DataFrame, cutoff: float, w: int) -> DataFrame:
    """`windows` with `high` (score at or above the cutoff) and `cov`, the high windows that cover the site."""
    high = F.coalesce(F.col("score") >= cutoff, F.lit(False)).cast("int")
    return windows.withColumn("high", high).withColumn("cov", F.sum("high").over(_upto(0)) - F.coalesce(F.sum("high").over(_upto(-w)), F.lit(0)))


def assemble(windows: DataFrame, cutoff: float, w: int, overlap_frac: float = 0.25, cm: bool = False) -> DataFrame:
    """(entity, start, stop, n_snps, length): maximal series of well-covered sites without a break.

    A site is covered by at least `overlap_frac` of `w` high windows (between 1 and w, not rounded), and
    a segment has at least as many sites. One that consists of the chromosome's last site alone is left out.
    Length is in base pairs, both ends included, or with `cm` the genetic distance of the ends.
    """
    least = exprs.overlap_threshold(overlap_frac, w)
    w_ = _w()
    marked = coverage(windows, cutoff, w).withColumn("inside", F.col("cov") >= least)
    first = F.col("inside") & (~F.coalesce(F.lag("inside").over(w_), F.lit(False)) | (F.col("brk") == 1))
    is_last = F.lead("ppos").over(w_).isNull()
    islands = marked.withColumns({"head": first.cast("int"), "is_last": is_last}).withColumn("island", F.sum("head").over(w_)).where("inside")
    size = (F.max("gpos") - F.min("gpos")) if cm else (F.max("ppos") - F.min("ppos") + 1)
    runs = islands.groupBy(*ENTITY, "island").agg(F.min("ppos").alias("start"), F.max("ppos").alias("stop"), F.count(F.lit(1)).alias("n_snps"), size.alias("length"), F.max(F.col("is_last") & (F.col("head") == 1)).alias("lone"))
    return runs.where((F.col("n_snps") >= least) & ~F.col("lone")).drop("island", "lone")


def thin(windows: DataFrame, step: int) -> DataFrame:
    """Every `step`-th window from the first of each chr, without missing scores."""
    return windows.where((F.pmod("idx", F.lit(step)) == 0) & F.col("score").isNotNull() & ~F.isnan("score"))


def subsample_individuals(individuals: DataFrame, k: int, seed: int) -> DataFrame:
    """`k` individuals per panel without replacement, all if k <= 0; drawn by a hash, whatever the partitioning."""
    if k <= 0:
        return individuals
    w = Window.partitionBy("panel_id").orderBy(F.md5(F.concat_ws(":", F.col("ind_idx").cast("string"), F.lit(str(seed)))), "ind_idx")
    return individuals.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def raw_lod_rows(windows: DataFrame) -> DataFrame:
    """One row per panel, chr and individual: its scores in order, `NA` where missing, blanks between."""
    text = F.transform(F.sort_array(F.collect_list(F.struct("idx", F.when(F.col("score").isNull(), F.lit("NA")).otherwise(F.format_string("%.6f", "score")).alias("t")))), lambda e: e["t"])
    return windows.groupBy(*ENTITY).agg(F.array_join(text, " ").alias("line"))
