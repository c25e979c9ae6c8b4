"""Centromeres of human genome builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Start and end of each centromere, chr1 to chr22 and chrX.
CENTROMERES = {
    "hg18": [
        (121236957, 123476957), (91689898, 94689898), (90587544, 93487544), (49354874, 52354874), (46441398, 49441398), (58938125, 61938125),
        (58058273, 61058273), (43958052, 46958052), (47107499, 50107499), (39244941, 41624941), (51450781, 54450781), (34747961, 36142961),
        (16000000, 17868000), (15070000, 18070000), (15260000, 18260000), (35143302, 36943302), (22187133, 22287133), (15400898, 16764896),
        (26923622, 29923622), (26267569, 28033230), (10260000, 13260000), (11330000, 14330000), (58598737, 61598737),
    ],
    "hg19": [
        (121535434, 124535434), (92326171, 95326171), (90504854, 93504854), (49660117, 52660117), (46405641, 49405641), (58830166, 61830166),
        (58054331, 61054331), (43838887, 46838887), (47367679, 50367679), (39254935, 42254935), (51644205, 54644205), (34856694, 37856694),
        (16000000, 19000000), (16000000, 19000000), (17000000, 20000000), (35335801, 38335801), (22263006, 25263006), (15460898, 18460898),
        (24681782, 27681782), (26369569, 29369569), (11288129, 14288129), (13000000, 16000000), (58632012, 61632012),
    ],
    "hg38": [
        (122026459, 124932724), (92188145, 94090557), (90772458, 93655574), (49712061, 51743951), (46485900, 50059807), (58553888, 59829934),
        (58169653, 61528020), (44033744, 45877265), (43389635, 45518558), (39686682, 41593521), (51078348, 54425074), (34769407, 37185252),
        (16000000, 18051248), (16000000, 18173523), (17083673, 19725254), (36311158, 38265669), (22813679, 26616164), (15460899, 20861206),
        (24498980, 27190874), (26436232, 30038348), (10864560, 12915808), (12954788, 15054318), (58605579, 62412542),
    ],
}


def build_centromeres(spark: SparkSession, build: str | None) -> DataFrame:
    """(build_name, chr, c_start, c_end) of a build; none for `none` or None."""
    if build not in (None, "none", *CENTROMERES):
        raise ValueError(f"unknown build {build!r}; one of {', '.join(CENTROMERES)}, none")
    names = [f"chr{i}" for i in (*range(1, 23), "X")]
    rows = [(build, n, a, b) for n, (a, b) in zip(names, CENTROMERES.get(build or "none", []))]
    return spark.createDataFrame(rows, "build_name string, chr string, c_start bigint, c_end bigint")
