"""Readers of the text formats; all take plain or gzip files and any number of them by a glob.

A gzip file is read by one task, so rows are spread again behind it. Columns are separated by blanks and
tabs. Rows keep the order of their lines in `line_no`, counted within a file.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rohspark.functions.exprs import chr_name
from rohspark.sources.builds import build_centromeres

log = logging.getLogger("rohspark")


def tokens(line) -> Column:
    """The tokens of a line, separated by white space."""
    return F.split(F.trim(F.regexp_replace(line, r"[\s]+", " ")), " ")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): non-blank lines, numbered within their file in order.

    The numbers come from each line's place in its split and from the splits' order, so that a file
    need not be read by one task.
    """
    raw = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = raw.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))  # a row per split of the input
    w = Window.partitionBy("file").orderBy("_block")
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = raw.join(F.broadcast(before.select("file", "_block", "first", "before")), ["file", "_block"])
    return numbered.select("file", (F.col("_id") - F.col("first") + F.col("before") + 1).alias("line_no"), "value").where(F.trim(F.regexp_replace("value", r"\s", "")) != "")


def _checked(df: DataFrame, ok: Column, what: str) -> DataFrame:
    """`df`, of which a row that isn't ok raises an error when it is read."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.substring("value", 1, 60))).cast("boolean")))


def read_tped(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, chr, locus_name, gpos, ppos, alleles): a site per line, two alleles per individual.

    Of an allele of several characters the first counts. Lines without pairs of alleles raise an error.
    """
    rows = read_lines(spark, path).withColumn("t", tokens(F.col("value")))
    rows = _checked(rows, (F.size("t") >= 6) & (F.size("t") % 2 == 0), "a line lacks columns")
    alleles = F.transform(F.slice("t", F.lit(5), F.size("t") - 4), lambda a: F.substring(a, 1, 1))
    return rows.select("file", "line_no", chr_name(F.col("t")[0]).alias("chr"), F.col("t")[1].alias("locus_name"), F.col("t")[2].cast("double").alias("gpos"), F.col("t")[3].cast("double").cast("bigint").alias("ppos"), alleles.alias("alleles"))


def read_tfam(spark: SparkSession, path: str) -> DataFrame:
    """(ind_idx, pop, ind_id) in order of lines; raises for repeated ids or several populations."""
    rows = _checked(read_lines(spark, path).withColumn("t", tokens(F.col("value"))), F.size("t") >= 2, "a line lacks columns")
    w = Window.partitionBy("file").orderBy("line_no")
    out = rows.select((F.row_number().over(w) - 1).alias("ind_idx"), F.col("t")[0].alias("pop"), F.col("t")[1].alias("ind_id"))
    bad = tfam_report(out.withColumn("panel_id", F.lit(0))).where("repeated OR mixed").first()
    if bad:
        raise ValueError("individuals are repeated" if bad["repeated"] else "more than one population")
    return out


def tfam_report(individuals: DataFrame) -> DataFrame:
    """Per panel: rows, distinct ids and pops, whether an id is repeated and whether pops are mixed."""
    return individuals.groupBy("panel_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("ind_id").alias("ids"), F.countDistinct("pop").alias("pops"),
        (F.count(F.lit(1)) > F.countDistinct("ind_id")).alias("repeated"), (F.countDistinct("pop") > 1).alias("mixed"),
    )


def read_tgls(spark: SparkSession, path: str, n_ind: int) -> DataFrame:
    """(file, line_no, chr, ppos, ind, value): four leading columns, then a likelihood per individual."""
    rows = _checked(read_lines(spark, path).withColumn("t", tokens(F.col("value"))), F.size("t") == n_ind + 4, "a line has the wrong number of columns")
    return rows.select("file", "line_no", chr_name(F.col("t")[0]).alias("chr"), F.col("t")[3].cast("double").cast("bigint").alias("ppos"), F.posexplode(F.slice("t", 5, n_ind)).alias("ind", "v")).withColumn("value", F.col("v").cast("double")).drop("v")


def read_genmap(spark: SparkSession, path: str) -> DataFrame:
    """(chr, snp_id, gpos, ppos), exactly four columns; of several rows at a position the last counts."""
    rows = _checked(read_lines(spark, path).withColumn("t", tokens(F.col("value"))), F.size("t") == 4, "a map line hasn't four columns")
    flat = rows.select("file", "line_no", chr_name(F.col("t")[0]).alias("chr"), F.col("t")[1].alias("snp_id"), F.col("t")[2].cast("double").alias("gpos"), F.col("t")[3].cast("double").cast("bigint").alias("ppos"))
    last = F.max(F.struct("file", "line_no", "snp_id", "gpos")).alias("v")
    return flat.groupBy("chr", "ppos").agg(last).select("chr", "v.snp_id", "v.gpos", "ppos")


def read_freq(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """(chr, locus_name, ppos, allele, freq) of lines of at least five columns; with `numbered` also `file` and `line_no`.

    A file's first line is a header where its position is no number, so that a table in several parts, only the first
    of which has a header, is read whole.
    """
    rows = read_lines(spark, path).withColumn("t", tokens(F.col("value")))
    ppos, freq = F.get("t", F.lit(2)).try_cast("bigint"), F.get("t", F.lit(4)).try_cast("double")
    head = (F.col("line_no") == 1) & ppos.isNull()
    rows = _checked(rows, (F.size("t") >= 5) & (head | (ppos.isNotNull() & freq.isNotNull())), "a frequency line lacks columns or numbers").where(~head)
    return rows.select(*(["file", "line_no"] if numbered else []), chr_name(F.col("t")[0]).alias("chr"), F.col("t")[1].alias("locus_name"), ppos.alias("ppos"), F.col("t")[3].alias("allele"), freq.alias("freq"))


def read_centromeres(spark: SparkSession, path: str) -> DataFrame:
    """(build_name, chr, c_start, c_end) from three columns; lines of another width are left out."""
    rows = read_lines(spark, path).withColumn("t", tokens(F.col("value"))).where(F.size("t") == 3)
    return rows.select(F.lit("file").alias("build_name"), chr_name(F.col("t")[0]).alias("chr"), F.col("t")[1].cast("bigint").alias("c_start"), F.col("t")[2].cast("bigint").alias("c_end"))


def centromeres(spark: SparkSession, build: str | None = None, path: str | None = None) -> DataFrame:
    """Those of the build if one is given, else those of the file, else none."""
    if build not in (None, "none"):
        return build_centromeres(spark, build)
    return read_centromeres(spark, path) if path else build_centromeres(spark, None)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, chr, locus_name, gpos, ppos, ref, alt, alleles); like `read_tped`.

    The genotype stands first in a sample's value, separated by `/` or `|`; 0 is REF and 1 ALT. Any
    other number, a dot or an unreadable value is a missing allele, `0`.
    """
    rows = read_lines(spark, path).where(~F.col("value").startswith("#")).withColumn("t", tokens(F.col("value")))
    rows = _checked(rows, F.size("t") >= 9, "a VCF line lacks columns")
    ref, alt = F.col("t")[3], F.col("t")[4]

    def allele(sample: Column, group: int) -> Column:
        n = F.regexp_extract(sample, r"^(\d+|\.)[/|](\d+|\.)(?::|$)", group)
        return F.when(n == "0", ref).when(n == "1", alt).otherwise(F.lit("0"))

    samples = F.slice("t", F.lit(10), F.size("t") - 9)
    alleles = F.flatten(F.transform(samples, lambda s: F.array(allele(s, 1), allele(s, 2))))
    return rows.select("file", "line_no", chr_name(F.col("t")[0]).alias("chr"), F.col("t")[2].alias("locus_name"), F.lit(0.0).alias("gpos"), F.col("t")[1].cast("bigint").alias("ppos"), ref.alias("ref"), alt.alias("alt"), alleles.alias("alleles"))


def read_vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the `#CHROM` line."""
    row = spark.read.text(path).where(F.col("value").startswith("#CHROM")).select(tokens(F.col("value")).alias("t")).first()
    return list(row["t"][9:]) if row else []


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(chr, ppos, ref, allele, effect) from lines `chr:pos ref alt effect`; of several for an allele the last counts."""
    rows = _checked(read_lines(spark, path).withColumn("t", tokens(F.col("value"))), F.size("t") >= 4, "a feature line lacks columns")
    place = F.split(F.col("t")[0], ":")
    flat = rows.select("file", "line_no", chr_name(place[0]).alias("chr"), place[1].cast("bigint").alias("ppos"), F.col("t")[1].alias("ref"), F.col("t")[2].alias("allele"), F.col("t")[3].alias("effect"))
    return flat.groupBy("chr", "ppos", "allele").agg(F.max(F.struct("file", "line_no", "ref", "effect")).alias("v")).select("chr", "ppos", "v.ref", "allele", "v.effect")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(ind_id, pop, chr, start, stop, size_class, length): segments, each of the individual of the last `track` line before it.

    Files in order of name count as one, so a table in several parts is read whole. Lines are looked through in stretches of
    100,000; what the last track line before a stretch says is handed on to it, one row per stretch.
    """
    name = r'name="Ind: (.*?) Pop:([^"]*) ROH"'
    rows = read_lines(spark, path).withColumns({"part": F.floor(F.col("line_no") / 100_000), "track": F.col("value").startswith("track")})
    about = F.when(F.col("track"), F.struct(F.regexp_extract("value", name, 1).alias("ind_id"), F.regexp_extract("value", name, 2).alias("pop")))
    marked = rows.withColumn("about", about)
    last = marked.groupBy("file", "part").agg(F.max_by("about", F.when(F.col("track"), F.col("line_no"))).alias("last"))
    before = Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per stretch
    handed = last.withColumn("handed", F.last("last", ignorenulls=True).over(before)).select("file", "part", "handed")
    w = Window.partitionBy("file", "part").orderBy("line_no")
    known = marked.join(handed, ["file", "part"]).withColumn("of", F.coalesce(F.last("about", ignorenulls=True).over(w), F.col("handed")))
    t = known.where(~F.col("track")).select(F.col("of.ind_id").alias("ind_id"), F.col("of.pop").alias("pop"), tokens(F.col("value")).alias("t"))
    return t.select("ind_id", "pop", F.col("t")[0].alias("chr"), F.col("t")[1].cast("bigint").alias("start"), F.col("t")[2].cast("bigint").alias("stop"), F.col("t")[3].alias("size_class"), F.col("t")[4].cast("double").alias("length"))


def read_kde(spark: SparkSession, path: str) -> DataFrame:
    """(i, x, y) of a density file."""
    rows = read_lines(spark, path).withColumn("t", tokens(F.col("value")))
    return rows.select((F.col("line_no") - 1).cast("int").alias("i"), F.col("t")[0].cast("double").alias("x"), F.col("t")[1].cast("double").alias("y"))
