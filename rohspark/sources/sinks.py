"""Writers of the text formats.

Each writes a folder of text files. Rows are range-partitioned by their place in the file, so the parts
in order of name are the whole in order, and no single task has to write it all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rohspark.functions import exprs

# Colours of the size classes.
COLOURS = ["228,26,28", "77,175,74", "55,126,184", "152,78,163", "255,127,0", "255,255,51", "166,86,40", "247,129,191", "153,153,153"]


def _chr_place(name) -> F.Column:
    """Where a chr stands by itself: numbers in order, then names."""
    n = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.regexp_extract(n, r"^(?:chr)?(\d{1,9})$", 1).try_cast("bigint"), F.lit(1 << 40))


def bed_rows(segments: DataFrame, individuals: DataFrame, bounds: list[float], cm: bool = False) -> DataFrame:
    """(ind_idx, chr, start, line): a track line for every individual (start 0), then its segments.

    Starts and stops are the positions as they are; sizes are whole numbers unless genetic. `segments`
    has ind_idx, chr, start, stop and length; `individuals` ind_idx, ind_id and pop.
    """
    name = F.concat(F.lit("Ind: "), F.col("ind_id"), F.lit(" Pop:"), F.coalesce(F.col("pop"), F.lit("NA")), F.lit(" ROH"))
    track = F.concat(F.lit('track name="'), name, F.lit('" description="'), name, F.lit('" visibility=2 itemRgb="On"'))
    heads = individuals.select("ind_idx", F.lit("").alias("chr"), F.lit(0).cast("bigint").alias("start"), track.alias("line"))
    rank = sum(((F.col("length") >= b).cast("int") for b in bounds), F.lit(0))
    colour = F.element_at(F.array(*map(F.lit, COLOURS)), F.least(rank, F.lit(len(COLOURS) - 1)) + 1)
    chrom = F.when(F.lower(F.substring("chr", 1, 1)) == "c", F.col("chr")).otherwise(F.concat(F.lit("chr"), F.col("chr")))
    size = F.col("length").cast("string") if cm else F.col("length").cast("bigint").cast("string")
    line = F.concat_ws("\t", chrom, F.col("start").cast("string"), F.col("stop").cast("string"), exprs.size_class("length", bounds), size, F.lit("."), F.lit("0"), F.lit("0"), colour)
    return heads.unionByName(segments.select("ind_idx", "chr", "start", line.alias("line")))


def _write(lines: DataFrame, order: list, path: str, gzip: bool = False) -> None:
    """`lines` (column `line` and those of `order`) as text, in order across the parts."""
    writer = lines.orderBy(*order).select(F.col("line").alias("value")).write.mode("overwrite")
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def write_bed(segments: DataFrame, individuals: DataFrame, bounds: list[float], path: str, cm: bool = False, chr_order: DataFrame | None = None) -> None:
    """Track and segment lines by individual, chr and start, in `<path>.roh.bed`.

    `chr_order` (chr, place) tells the order of the chr, as in the input; without it numbers come in order, then names.
    """
    rows = bed_rows(segments, individuals, bounds, cm)
    rows = rows.join(chr_order.select("chr", "place"), "chr", "left") if chr_order is not None else rows.withColumn("place", _chr_place("chr"))
    first = F.when(F.col("chr") == "", F.lit(-1)).otherwise(F.coalesce("place", F.lit((1 << 62))))
    _write(rows.withColumn("place", first), ["ind_idx", "place", "chr", "start"], f"{path}.roh.bed")


def freq_rows(freqs: DataFrame) -> DataFrame:
    """(chr, ppos, line) with a header in front."""
    line = F.concat_ws("\t", "chr", "locus_name", F.col("ppos").cast("string"), "allele", F.col("freq").cast("string"))
    head = freqs.sparkSession.createDataFrame([("", -1, "CHR\tSNP\tPOS\tALLELE\tFREQ")], "chr string, ppos bigint, line string")
    return head.unionByName(freqs.select("chr", "ppos", line.alias("line")))


def write_freq(freqs: DataFrame, path: str) -> None:
    """Frequencies in `<path>.freq.gz`."""
    first = F.when(F.col("chr") == "", F.lit(-1)).otherwise(_chr_place("chr"))
    _write(freq_rows(freqs).withColumn("place", first), ["place", "chr", "ppos"], f"{path}.freq.gz", gzip=True)


def write_raw_lod(rows: DataFrame, path: str) -> None:
    """Window scores, a line per individual, in a folder per panel and chr."""
    out = rows.repartitionByRange("panel_id", "chr", "ind_idx").sortWithinPartitions("panel_id", "chr", "ind_idx").select("panel_id", "chr", F.col("line").alias("value"))
    out.write.mode("overwrite").option("compression", "gzip").partitionBy("panel_id", "chr").text(f"{path}.raw.lod.windows")


def write_kde(density: DataFrame, path: str, w: int, scale: float = 1.0) -> None:
    """Lines `x y` in `<path>.<w>SNPs.kde`; `scale` multiplies y."""
    line = F.concat_ws(" ", F.col("x").cast("string"), (F.col("y") * scale).cast("string"))
    _write(density.select("i", line.alias("line")), ["i"], f"{path}.{w}SNPs.kde")


def write_tped(records: DataFrame, path: str) -> None:
    """Records (chr, locus_name, gpos, ppos, alleles) as tab-separated lines in order of (file, line_no)."""
    gpos = F.when(F.col("gpos") == 0, F.lit("0")).otherwise(F.col("gpos").cast("string"))
    line = F.concat_ws("\t", "chr", "locus_name", gpos, F.col("ppos").cast("string"), F.array_join("alleles", "\t"))
    _write(records.select("file", "line_no", line.alias("line")), ["file", "line_no"], f"{path}.tped")


def write_tfam(spark, ids: list[str], path: str, pop: str = "0") -> None:
    """A line per individual, in order."""
    rows = spark.createDataFrame([(i, f"{pop}\t{n}\t0\t0\t0\t0") for i, n in enumerate(ids)], "i int, line string")
    _write(rows, ["i"], f"{path}.tfam")


def vcf_to_tped(spark, source: str, path: str) -> None:
    """A VCF as `<path>.tped` and `<path>.tfam`."""
    from rohspark.sources import readers

    write_tped(readers.read_vcf(spark, source), path)
    write_tfam(spark, readers.read_vcf_samples(spark, source), path)


def write_feature_counts(wide: DataFrame, path: str) -> None:
    """The pivoted counts: a header of the combinations, then a line per individual, by its `ind_id` where there is one."""
    names = [c for c in wide.columns if c not in ("panel_id", "ind_idx", "ind_id")]
    head = wide.sparkSession.createDataFrame([(-1, " ".join(names))], "ind_idx int, line string")
    who = F.col("ind_id" if "ind_id" in wide.columns else "ind_idx").cast("string")
    lines = wide.select("ind_idx", F.concat_ws(" ", who, *(F.col(c).cast("string") for c in names)).alias("line"))
    _write(head.unionByName(lines), ["ind_idx"], path)


def write_lines(spark, lines: list[str], path: str) -> None:
    """A short text, such as the log of a run."""
    _write(spark.createDataFrame(list(enumerate(lines)), "i int, line string"), ["i"], path)
