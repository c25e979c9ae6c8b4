"""Genotype coding, frequencies and site filters.

Tables carry a `panel_id`: one study, with its own individuals and sites. Everything is done within
panel and chr, so one run covers any number of panels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rohspark.functions import exprs
from rohspark.session import broadcast_if_small

SITE = ["panel_id", "chr", "locus_idx"]


def _allele_counts(alleles: Column, coded: Column, missing: str) -> tuple[Column, Column]:
    return F.size(F.filter(alleles, lambda a: a == coded)), F.size(F.filter(alleles, lambda a: a != missing))


def allele_freq(records: DataFrame, missing: str = "0") -> DataFrame:
    """`records` (with `alleles`, two per individual) and their `allele` and `freq`; rows stay as they are.

    The coded allele is the first that isn't missing; its frequency is its share of all alleles that
    aren't missing, those of half-missing genotypes included, and 0 where all are missing. One row
    is one site, so no shuffle is needed.
    """
    coded = F.try_element_at(F.filter("alleles", lambda a: a != missing), F.lit(1))
    rows = records.withColumn("allele", coded)
    n1, n = _allele_counts(F.col("alleles"), F.col("allele"), missing)
    return rows.withColumn("freq", F.when(n > 0, n1 / n).otherwise(F.lit(0.0)))


def resample_freq(freqs: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """`freq` replaced by Binomial(n, freq) / n, for frequencies above 0.

    Draws are hashes of the row's key, the draw's number and the seed, so that they don't depend on partitioning.
    """
    if n <= 0:
        return freqs

    def draw(i: Column) -> Column:
        name = F.concat_ws(":", *(F.col(k).cast("string") for k in key), i.cast("string"), F.lit(str(seed)))
        u = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
        return (u <= F.col("freq")).cast("int")

    hits = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, i: a + draw(i))
    return freqs.withColumn("freq", F.when(F.col("freq") > 0, hits / float(n)).otherwise(F.col("freq")))


def code_genotypes(records: DataFrame, missing: str = "0") -> DataFrame:
    """One row per record and individual: `ind`, `g` (coded alleles, null if either is missing) and `first_copy`."""
    coded = allele_freq(records, missing)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("alleles") / 2).cast("int") - 1), lambda i: F.struct(F.get("alleles", (2 * i).cast("int")).alias("a"), F.get("alleles", (2 * i + 1).cast("int")).alias("b")))
    rows = coded.where(F.size("alleles") >= 2).select(*[c for c in coded.columns if c != "alleles"], F.posexplode(pairs).alias("ind", "pair"))
    a, b, allele = F.col("pair.a"), F.col("pair.b"), F.col("allele")
    g = F.when((a != missing) & (b != missing), (a == allele).cast("int") + (b == allele).cast("int"))
    return rows.withColumns({"g": g, "first_copy": a == allele}).drop("pair")


def call_freqs(calls: DataFrame) -> DataFrame:
    """Per site of coded calls: `ppos`, `freq` of the coded allele (0 where all are missing), `hom_freq`, `n_calls`."""
    n = F.count("g")
    return calls.groupBy(*SITE).agg(
        F.max("ppos").alias("ppos"),
        F.when(n > 0, F.sum("g") / (2 * n)).otherwise(F.lit(0.0)).alias("freq"),
        F.when(n > 0, F.count(F.when(F.col("g") != 1, 1)) / n).otherwise(F.lit(0.0)).alias("hom_freq"),
        n.alias("n_calls"),
    )


def current_loci(loci: DataFrame) -> DataFrame:
    """One row per (panel, chr, locus); of several the one with most values, then the largest, counts."""
    rest = F.struct("ppos", "gpos", "locus_name", "allele")
    return loci.where("panel_id IS NOT NULL AND chr IS NOT NULL AND locus_idx IS NOT NULL").groupBy(*SITE).agg(F.max(rest).alias("v")).select(*SITE, "v.*")


def filter_monomorphic(sites: DataFrame) -> DataFrame:
    """Sites with 0 < freq < 1, the frequency being the one in use."""
    return sites.where((F.col("freq") > 0) & (F.col("freq") < 1))


def with_centromeres(df: DataFrame, centromeres: DataFrame) -> DataFrame:
    """`df` with `c_start` and `c_end` of its chr, 0 where it is unknown."""
    known = centromeres.groupBy(F.col("chr").alias("_c")).agg(F.max("c_start").alias("c_start"), F.max("c_end").alias("c_end"))
    joined = df.join(broadcast_if_small(known, 10_000), F.col("chr") == F.col("_c"), "left").drop("_c")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("c_start", "c_end")})


def map_range(genmap: DataFrame) -> DataFrame:
    """First and last position of each panel and chr of a genetic map."""
    return genmap.where(F.col("gpos").isNotNull()).groupBy("panel_id", "chr").agg(F.min("ppos").alias("map_first"), F.max("ppos").alias("map_last"))


def filter_out_of_bounds(sites: DataFrame, genmap: DataFrame, centromeres: DataFrame) -> DataFrame:
    """Polymorphic sites within the range of the genetic map and not inside the centromere."""
    ranged = filter_monomorphic(sites).join(map_range(genmap), ["panel_id", "chr"])
    placed = with_centromeres(ranged, centromeres)
    inside = (F.col("ppos") > F.col("c_start")) & (F.col("ppos") < F.col("c_end"))
    return placed.where((F.col("ppos") >= F.col("map_first")) & (F.col("ppos") <= F.col("map_last")) & ~inside).drop("map_first", "map_last", "c_start", "c_end")


def number_sites(sites: DataFrame) -> DataFrame:
    """`idx`: the site's place, from 0, among those of its panel and chr that are left, by position."""
    w = Window.partitionBy("panel_id", "chr").orderBy("ppos", "locus_idx")
    return sites.withColumn("idx", F.row_number().over(w) - 1)


def variant_density(sites: DataFrame, centromeres: DataFrame) -> DataFrame:
    """Per panel: sites per base pair of the spans from first to last site without centromeres."""
    by_chr = sites.groupBy("panel_id", "chr").agg(F.count(F.lit(1)).alias("n"), (F.max("ppos") - F.min("ppos") + 1).alias("span"))
    placed = with_centromeres(by_chr, centromeres)
    length = F.sum(F.col("span") - (F.col("c_end") - F.col("c_start")))
    return placed.groupBy("panel_id").agg((F.sum("n") / F.nullif(length, F.lit(0))).alias("density"))


def interpolate_map(sites: DataFrame, genmap: DataFrame) -> DataFrame:
    """`sites` with `gpos` from the map: exact where it has the position, else between its neighbours.

    An as-of join by one sort per panel and chr: map and sites are laid together by position, and each
    site looks to the last map position before it and the first behind. `interpolated` marks the
    latter kind; sites outside the map get null. Of several map rows at one position the largest counts.
    """
    known = genmap.where(F.col("gpos").isNotNull()).groupBy("panel_id", "chr", "ppos").agg(F.max("gpos").alias("m_gpos"))
    there = known.select("panel_id", "chr", "ppos", F.struct(F.col("ppos").alias("x"), F.col("m_gpos").alias("y")).alias("_m"), F.lit(None).cast("struct<_:int>").alias("_s"))
    kept = [c for c in sites.columns if c not in ("panel_id", "chr", "ppos", "gpos")]
    asked = sites.select("panel_id", "chr", "ppos", F.lit(None).cast(there.schema["_m"].dataType).alias("_m"), F.struct(*kept).alias("_s"))
    both = there.withColumn("_s", F.lit(None).cast(asked.schema["_s"].dataType)).unionByName(asked)
    w = Window.partitionBy("panel_id", "chr").orderBy("ppos")  # equal positions are peers and see each other
    before = F.last("_m", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.first("_m", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    placed = both.withColumns({"_a": before, "_b": behind}).where(F.col("_s").isNotNull())
    exact = F.col("_a.x") == F.col("ppos")
    between = exprs.interpolate("_a.x", "_a.y", "_b.x", "_b.y", "ppos")
    return placed.select("panel_id", "chr", "ppos", "_s.*", F.when(exact, F.col("_a.y")).otherwise(between).alias("gpos"), (~F.coalesce(exact, F.lit(False)) & between.isNotNull()).alias("interpolated"))


def flip_freqs(sites: DataFrame, freq_file: DataFrame, on: tuple[str, ...] = ("panel_id", "chr", "locus_name"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Frequencies of a file for `sites` (locus_name, allele): 1 - freq where the file counts the other allele.

    `on` names a site in both tables; `keep` are further columns of `sites` to give. Raises if a site isn't in the file, or is there
    more than once.
    """
    own = sites.select(*on, *keep, F.col("allele").alias("_a"))
    counted = freq_file.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(F.col("allele").alias("a"), F.col("freq").alias("f"))).alias("_v"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.lit("a site is in the frequency file more than once"))).otherwise(F.col("_v.f"))
    joined = own.join(counted.select(*on, F.col("_v.a").alias("_f"), once.alias("freq")), list(on), "left")
    freq = F.when(F.col("freq").isNull(), F.raise_error(F.lit("a site is not in the frequency file"))).when(F.col("_a") == F.col("_f"), F.col("freq")).otherwise(1 - F.col("freq"))
    return joined.select(*on, *keep, F.col("_a").alias("allele"), freq.alias("freq"))
