"""Counts of annotated homozygotes inside and outside of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def homozygous_features(calls: DataFrame, sites: DataFrame, features: DataFrame) -> DataFrame:
    """(panel_id, chr, ind_idx, ppos, effect) where both alleles are the feature's.

    `sites` tells the coded allele and, where known, the `other` one; features are keyed by (panel_id, chr, ppos, allele).
    Missing calls, heterozygotes and alleles without a feature are skipped.
    """
    s = sites.select("panel_id", "chr", "locus_idx", F.col("ppos").alias("site_ppos"), "allele", F.col("other") if "other" in sites.columns else F.lit(None).cast("string").alias("other"))
    hom = calls.where(F.col("g").isin(0, 2)).join(s, ["panel_id", "chr", "locus_idx"])
    hom = hom.select("panel_id", "chr", "ind_idx", F.col("site_ppos").alias("ppos"), F.when(F.col("g") == 2, F.col("allele")).otherwise(F.col("other")).alias("allele"))
    return hom.join(features, ["panel_id", "chr", "ppos", "allele"]).select("panel_id", "chr", "ind_idx", "ppos", "effect")


def homozygotes_of_records(records: DataFrame, features: DataFrame, missing: str = "0") -> DataFrame:
    """(chr, ind_idx, ppos, effect) straight from site records (chr, ppos, alleles), two alleles per individual.

    Both alleles must be a feature's (features are keyed by chr, ppos and allele). Where the records tell `ref`, as those of a
    VCF do, a feature of REF goes before one of ALT: only the first of the two is looked for.
    """
    r = records.join(features.select("chr", "ppos").distinct(), ["chr", "ppos"], "left_semi")
    if "ref" in records.columns:
        of_ref = features.select("chr", "ppos", F.col("allele").alias("ref"), F.lit(True).alias("_ref")).distinct()
        r = r.join(of_ref, ["chr", "ppos", "ref"], "left").withColumn("_only", F.when(F.col("_ref"), F.col("ref")))
    else:
        r = r.withColumn("_only", F.lit(None).cast("string"))
    halves = F.sequence(F.lit(0), F.floor(F.size("alleles") / 2).cast("int") - 1)
    pairs = F.transform(halves, lambda i: F.struct(F.get("alleles", (2 * i).cast("int")).alias("a"), F.get("alleles", (2 * i + 1).cast("int")).alias("b")))
    each = r.where(F.size("alleles") >= 2).select("chr", "ppos", "_only", F.posexplode(pairs).alias("ind_idx", "p"))
    hom = each.where((F.col("p.a") == F.col("p.b")) & (F.col("p.a") != missing) & (F.col("_only").isNull() | (F.col("_only") == F.col("p.a"))))
    return hom.select("chr", "ind_idx", "ppos", F.col("p.a").alias("allele")).join(features, ["chr", "ppos", "allele"]).select("chr", "ind_idx", "ppos", "effect")


def inside_segments(points: DataFrame, segments: DataFrame, bin_size: int = 1_000_000) -> DataFrame:
    """`points` with the `size_class` of the segment of the individual that holds them, `NONE` where there is none.

    Segments include their start and end one before their stop. Both sides are keyed by bins of
    `bin_size`, a segment by each bin that it meets, so the join is an equi-join however many
    segments an individual has. Segments of an individual don't overlap.
    """
    key = ["panel_id", "chr", "ind_idx"]
    last = F.col("stop") - 1
    spread = segments.where(F.col("start") <= last).select(*key, "start", last.alias("last"), "size_class", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(last / bin_size))).alias("bin"))
    p = points.withColumn("bin", F.floor(F.col("ppos") / bin_size)).alias("p")
    on = F.lit(True)
    for c in (*key, "bin"):
        on = on & (F.col(f"p.{c}") == F.col(f"s.{c}"))
    on = on & F.col("p.ppos").between(F.col("s.start"), F.col("s.last"))
    joined = p.join(spread.alias("s"), on, "left")
    return joined.select(*(F.col(f"p.{c}") for c in points.columns), F.coalesce(F.col("s.size_class"), F.lit("NONE")).alias("size_class"))


def feature_counts(placed: DataFrame) -> DataFrame:
    """Features per panel, individual, class and effect."""
    return placed.groupBy("panel_id", "ind_idx", "size_class", "effect").agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(counts: DataFrame, individuals: DataFrame, effects: list[str], classes: tuple[str, ...] = ("A", "B", "C", "NONE")) -> DataFrame:
    """One row per individual, a column `<effect><class>` for each combination, 0 where there is none."""
    names = [f"{e}{c}" for e in sorted(effects) for c in classes]
    wide = counts.select("panel_id", "ind_idx", F.concat("effect", "size_class").alias("_k"), "n").groupBy("panel_id", "ind_idx").pivot("_k", names).agg(F.sum("n"))
    return individuals.select("panel_id", "ind_idx").distinct().join(wide, ["panel_id", "ind_idx"], "left").na.fill(0, names)
