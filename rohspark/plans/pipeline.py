"""From files to segments.

One lazy DataFrame plan with a few scalars taken at the driver: the window size where it is searched
for, the cutoff and the size bounds. Tables that several steps read are written to the shared folder once.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rohspark.config import RohConfig
from rohspark.functions import exprs
from rohspark.operators import density, features, linkage, mixture, roh, sites
from rohspark.session import broadcast_if_small, materialise
from rohspark.sources import readers, sinks

log = logging.getLogger("rohspark")


@dataclass
class Inputs:
    """Tables of one study; `panel_id` is 0 throughout."""

    calls: DataFrame
    freqs: DataFrame
    individuals: DataFrame
    centromeres: DataFrame
    genmap: DataFrame | None = None
    chr_order: DataFrame | None = None


@dataclass
class Result:
    """What a run gives; `segments` is None where it only explored window sizes or frequencies."""

    segments: DataFrame | None = None
    windows: DataFrame | None = None
    density: DataFrame | None = None
    winsize: int | None = None
    cutoff: float | None = None
    bounds: list[float] | None = None
    overlap_frac: float | None = None


def frequencies(spark: SparkSession, cfg: RohConfig) -> DataFrame:
    """Site records with their frequencies, line by line, without making genotypes."""
    records = readers.read_vcf(spark, cfg.vcf) if cfg.vcf else readers.read_tped(spark, cfg.tped)
    return sites.resample_freq(sites.allele_freq(records, cfg.tped_missing), cfg.resample, cfg.seed, ["file", "line_no"])


def load(spark: SparkSession, cfg: RohConfig) -> Inputs:
    """The tables of the run's files."""
    coded = materialise(frequencies(spark, cfg).withColumn("panel_id", F.lit(0)), "records")
    w = Window.partitionBy("chr").orderBy("ppos", "file", "line_no")  # sorts the places of the sites, not their alleles
    places = materialise(coded.select("file", "line_no", "chr", "ppos").withColumn("locus_idx", F.row_number().over(w) - 1).select("file", "line_no", "locus_idx"), "places")
    records = coded.join(places, ["file", "line_no"])
    chr_order = materialise(coded.groupBy("chr").agg(F.min(F.struct("file", "line_no")).alias("at")).select("chr", F.row_number().over(Window.orderBy("at")).cast("bigint").alias("place")), "chrs")  # one row per chr
    if cfg.vcf:
        names = readers.read_vcf_samples(spark, cfg.vcf)
        individuals = spark.createDataFrame([(i, "0", n) for i, n in enumerate(names)], "ind_idx int, pop string, ind_id string")
    else:
        individuals = readers.read_tfam(spark, cfg.tfam)
    individuals = individuals.withColumn("panel_id", F.lit(0))
    n = individuals.count()
    if coded.where(F.size("alleles") != 2 * n).limit(1).count():
        raise ValueError(f"a line holds the genotypes of another number of individuals than the {n} that are listed")
    calls = sites.code_genotypes(records.select("panel_id", "chr", "locus_idx", "ppos", "alleles"), cfg.tped_missing).withColumnRenamed("ind", "ind_idx").drop("allele", "freq")
    if cfg.tgls:
        keys = ["chr", "ppos", "ind_idx"]
        gl = readers.read_tgls(spark, cfg.tgls, n).select("file", "line_no", "chr", "ppos", F.col("ind").alias("ind_idx"), exprs.gl_to_error("value", cfg.gl_type).alias("error"))
        gl = gl.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("file", "line_no"))).select(*keys, "nth", "error", F.lit(True).alias("_there"))
        calls = calls.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("locus_idx"))).join(gl, [*keys, "nth"], "left").drop("nth")
        lacking = F.concat(F.lit("a call has no likelihood: "), "chr", F.lit(" "), F.col("ppos").cast("string"))
        calls = calls.withColumn("error", F.when(F.col("_there").isNull(), F.raise_error(lacking)).otherwise(F.col("error"))).drop("_there")
    calls = materialise(calls, "calls")
    freqs = records.select(*sites.SITE, "ppos", "locus_name", "allele", "freq")
    if cfg.freq_file:
        site = ["panel_id", "chr", "locus_name", "ppos"]  # names such as a dot may repeat, and two sites may share a position
        file = readers.read_freq(spark, cfg.freq_file, numbered=True).withColumn("panel_id", F.lit(0))
        file = file.withColumn("nth", F.row_number().over(Window.partitionBy(*site).orderBy("file", "line_no")))
        own = freqs.withColumn("nth", F.row_number().over(Window.partitionBy(*site).orderBy("locus_idx")))
        freqs = sites.flip_freqs(own, file, on=(*site, "nth"), keep=("locus_idx",)).drop("nth")
    else:
        sinks.write_freq(freqs, cfg.out)
    hom = sites.call_freqs(calls).select(*sites.SITE, "hom_freq")
    centro = readers.centromeres(spark, cfg.build, cfg.centromere)
    genmap = readers.read_genmap(spark, cfg.map).withColumn("panel_id", F.lit(0)) if cfg.map else None
    return Inputs(calls, materialise(freqs.join(hom, sites.SITE), "freqs"), individuals, centro, genmap, chr_order)


def prepared_sites(cfg: RohConfig, inputs: Inputs) -> DataFrame:
    """Sites that are left, numbered, with breaks and, where there is a map, genetic positions and weights."""
    if inputs.genmap is not None and (cfg.weighted or cfg.cm):
        unmapped = inputs.freqs.select("panel_id", "chr").distinct().join(sites.map_range(inputs.genmap), ["panel_id", "chr"], "left_anti").select("chr").distinct().orderBy("chr").limit(20).collect()
        if unmapped:
            raise ValueError(f"the genetic map has no rows for {', '.join(r['chr'] for r in unmapped)}")
        kept = sites.interpolate_map(sites.filter_out_of_bounds(inputs.freqs, inputs.genmap, inputs.centromeres), inputs.genmap)
        numbered = linkage.site_weights(sites.number_sites(kept), cfg.M, cfg.mu)
    else:
        numbered = sites.number_sites(sites.filter_monomorphic(inputs.freqs))
    out = materialise(roh.site_breaks(numbered, inputs.centromeres, cfg.max_gap), "sites")
    if not out.limit(1).count():
        raise ValueError("no polymorphic site is left")
    return out


def score(cfg: RohConfig, calls: DataFrame, all_calls: DataFrame, s: DataFrame, w: int) -> DataFrame:
    """Window scores of `calls`; LD comes from `all_calls`."""
    error = F.col("error") if cfg.tgls else cfg.error
    scored = roh.score_sites(calls, s, error)
    if not cfg.weighted:
        return roh.window_scores(scored, w)
    people = all_calls.select("panel_id", "ind_idx").distinct()
    chosen = all_calls.join(broadcast_if_small(roh.subsample_individuals(people, cfg.ld_subsample, cfg.seed)), ["panel_id", "ind_idx"], "left_semi") if cfg.ld_subsample > 0 else all_calls
    pairs = linkage.pair_ld(chosen.join(s.select(*sites.SITE, "idx"), sites.SITE), s, w, cfg.phased)
    return linkage.weighted_window_scores(scored, linkage.ld_weights(pairs, s, w), w)


def run(spark: SparkSession, cfg: RohConfig) -> Result:
    """The run that `cfg` describes; files go to `cfg.out`."""
    for warning in cfg.check():
        log.warning(warning)
    if cfg.freq_only:
        sinks.write_freq(frequencies(spark, cfg), cfg.out)
        return Result()
    inputs = load(spark, cfg)
    s = prepared_sites(cfg, inputs)
    dens = sites.variant_density(s, inputs.centromeres).first()["density"]

    def points(w: int) -> DataFrame:
        people = roh.subsample_individuals(inputs.individuals.select("panel_id", "ind_idx"), cfg.kde_subsample, cfg.seed)
        some = inputs.calls.join(broadcast_if_small(people), ["panel_id", "ind_idx"], "left_semi")
        windows = score(cfg, some, inputs.calls, s, w)
        return materialise(roh.thin(windows, 1 if cfg.no_kde_thinning else w).select("panel_id", "score"), "points")

    def explored() -> DataFrame:
        """Densities of the listed window sizes; unweighted scores of all sizes come from one pass."""
        if cfg.weighted or cfg.no_kde_thinning:
            return materialise(density.explore_winsizes(points, cfg.winsize_multi), "densities")
        people = roh.subsample_individuals(inputs.individuals.select("panel_id", "ind_idx"), cfg.kde_subsample, cfg.seed)
        some = inputs.calls.join(broadcast_if_small(people), ["panel_id", "ind_idx"], "left_semi")
        scored = roh.score_sites(some, s, F.col("error") if cfg.tgls else cfg.error)
        found = materialise(roh.thinned_for_sizes(scored, cfg.winsize_multi), "points")
        return materialise(density.kde(found, by=("panel_id", "w")), "densities")

    d: DataFrame | None = None
    if cfg.winsize_multi and cfg.auto_winsize and not cfg.weighted:
        densities = explored()
        w = density.first_smooth(density.wiggle(densities, ("panel_id", "w")), cfg.winsize_multi).first()["w"]
        d = densities.where(F.col("w") == w).drop("w")
    elif cfg.winsize_multi:
        densities = explored()
        for w in cfg.winsize_multi:
            sinks.write_kde(densities.where(F.col("w") == w), cfg.out, w)
        return Result(density=densities)
    elif cfg.auto_winsize and cfg.weighted:
        w = exprs.winsize_for_density(dens)
    elif cfg.auto_winsize:
        w, d = density.select_winsize(points, cfg.winsize, cfg.auto_winsize_step, cfg.max_winsize)
    else:
        w = cfg.winsize
    frac = exprs.overlap_frac_for_density(dens, w) if cfg.auto_overlap_frac else cfg.overlap_frac
    windows = materialise(score(cfg, inputs.calls, inputs.calls, s, w), "windows")
    if cfg.raw_lod:
        sinks.write_raw_lod(roh.raw_lod_rows(windows), cfg.out)
    cutoff = cfg.lod_cutoff
    if cutoff is None:
        d = d if d is not None else materialise(density.kde(points(w)), "density")
        sinks.write_kde(d, cfg.out, w)
        grid = d.orderBy("i").toPandas()  # 512 rows
        cutoff = density.cutoff_of(grid["x"].to_numpy(np.float64), grid["y"].to_numpy(np.float64), w)
    segments = materialise(roh.assemble(windows, cutoff, w, frac, cfg.cm), "segments")
    bounds = cfg.size_bounds or mixture.size_bounds(mixture.fit_gmm(segments, cfg.nclust))
    sinks.write_bed(segments, inputs.individuals, bounds, cfg.out, cfg.cm, inputs.chr_order)
    log.info("window size %d, cutoff %g, bounds %s, density %g", w, cutoff, bounds, dens if dens is not None else math.nan)
    n_sites, n_interpolated = s.agg(F.count(F.lit(1)), F.count(F.when(F.col("interpolated"), 1)) if "interpolated" in s.columns else F.lit(0)).first()
    facts = {"loci": inputs.freqs.count(), "loci_used": n_sites, "loci_interpolated": n_interpolated, "individuals": inputs.individuals.count(), "winsize_used": w, "overlap_used": frac, "cutoff_used": cutoff, "bounds_used": bounds, "segments": segments.count()}
    sinks.write_lines(spark, [f"{k} = {v}" for k, v in [*vars(cfg).items(), *facts.items()]], f"{cfg.out}.log")
    return Result(segments.withColumn("size_class", exprs.size_class("length", bounds)), windows, d, w, cutoff, bounds, frac)


def count_features(spark: SparkSession, feature_file: str, roh: str, out: str, vcf: str | None = None, tped: str | None = None, tfam: str | None = None, missing: str = "0") -> DataFrame:
    """Annotated homozygotes per individual, size class and effect, from files to `out`; gives the table written.

    `roh` is a bed of segments. Individuals without segments or features have a line of zeros. Needs `vcf`, or `tped` and `tfam`.
    """
    if not vcf and not (tped and tfam):
        raise ValueError("vcf is needed, or tped and tfam")
    feats = materialise(readers.read_features(spark, feature_file), "features")
    if vcf:
        records = readers.read_vcf(spark, vcf)
        people = spark.createDataFrame(list(enumerate(readers.read_vcf_samples(spark, vcf))), "ind_idx int, ind_id string")
    else:
        records, people = readers.read_tped(spark, tped), readers.read_tfam(spark, tfam).select("ind_idx", "ind_id")
    zero = F.lit(0).alias("panel_id")
    points = features.homozygotes_of_records(records, feats.drop("ref"), missing).select(zero, "*")
    segments = readers.read_bed(spark, roh).join(people, "ind_id").select(zero, "chr", "ind_idx", "start", "stop", "size_class")
    counts = features.feature_counts(features.inside_segments(points, segments))
    effects = [r["effect"] for r in feats.select("effect").distinct().orderBy("effect").collect()]  # columns of the result
    wide = materialise(features.pivot_counts(counts, people.select(zero, "ind_idx"), effects).join(people, "ind_idx"), "counts")
    sinks.write_feature_counts(wide, out)
    return wide
