"""Allele frequencies and record parsing on streams of files.

A site is one line and its frequency needs no other, so the batch operators run unchanged on a stream;
there is no state, and late files are handled like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rohspark.functions.exprs import chr_name
from rohspark.operators import sites
from rohspark.sources.readers import tokens


def stream_tped(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(chr, locus_name, gpos, ppos, alleles) of the lines of all files in `folder`, as they arrive.

    Blank lines and lines without pairs of alleles are left out.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    t = lines.select(tokens(F.col("value")).alias("t")).where((F.size("t") >= 6) & (F.size("t") % 2 == 0))
    alleles = F.transform(F.slice("t", F.lit(5), F.size("t") - 4), lambda a: F.substring(a, 1, 1))
    return t.select(chr_name(F.col("t")[0]).alias("chr"), F.col("t")[1].alias("locus_name"), F.col("t")[2].cast("double").alias("gpos"), F.col("t")[3].cast("double").cast("bigint").alias("ppos"), alleles.alias("alleles"))


def stream_freqs(spark: SparkSession, folder: str, out: str, checkpoint: str, missing: str = "0") -> StreamingQuery:
    """Writes the frequency of each arriving site to `out` as Parquet; handles what is there and ends."""
    freqs = sites.allele_freq(stream_tped(spark, folder), missing).drop("alleles")
    return freqs.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
