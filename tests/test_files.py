"""Readers, writers, checks of settings, whole runs and the stream, on small files."""

import gzip
import random

import pytest

from rohspark.cli import main, parser
from rohspark.config import RohConfig
from rohspark.functions import exprs
from rohspark.plans import pipeline
from rohspark.sources import builds, readers, sinks
from rohspark.streaming import freqs as stream


def lines_of(folder):
    out = []
    for p in sorted(folder.iterdir()):
        if p.name.startswith("part-"):
            out += (gzip.open(p, "rt") if p.suffix == ".gz" else p.open()).read().splitlines()
    return out


def test_tped_plain_and_gzip(spark, tmp_path):
    text = "1 rs1 0.1 100 0 G A G\n\nchr1\trs2\t0\t2e2\tTA C C 0\n2 rs3 0 5 0 0 0 0\n"
    (tmp_path / "a.tped").write_text(text)
    with gzip.open(tmp_path / "b.tped.gz", "wt") as f:
        f.write(text)
    for name in ("a.tped", "b.tped.gz"):
        rows = readers.read_tped(spark, str(tmp_path / name)).orderBy("line_no").collect()
        assert [(r["line_no"], r["chr"], r["ppos"], r["alleles"]) for r in rows] == [(1, "chr1", 100, list("0GAG")), (3, "chr1", 200, list("TCC0")), (4, "chr2", 5, list("0000"))]
    from rohspark.operators import sites

    coded = sites.allele_freq(readers.read_tped(spark, str(tmp_path / "a.tped"))).orderBy("line_no").collect()
    assert [(r["allele"], r["freq"]) for r in coded] == [("G", 2 / 3), ("T", 1 / 3), (None, 0.0)]
    g = sites.code_genotypes(readers.read_tped(spark, str(tmp_path / "a.tped"))).orderBy("line_no", "ind").collect()
    assert [r["g"] for r in g] == [None, 1, 1, None, None, None]
    (tmp_path / "c.tped").write_text("1 rs1 0.1 100 A\n")
    with pytest.raises(Exception, match="lacks columns"):
        readers.read_tped(spark, str(tmp_path / "c.tped")).collect()


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_lines(spark, str(tmp_path / "x.txt"))
        assert rows.rdd.getNumPartitions() > 3
        assert all(r["value"] == f"line{r['line_no'] - 1}" for r in rows.collect()) and rows.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_other_readers(spark, tmp_path):
    (tmp_path / "a.tfam").write_text("P i1 0 0 0 0\nP i2\n")
    assert [tuple(r) for r in readers.read_tfam(spark, str(tmp_path / "a.tfam")).orderBy("ind_idx").collect()] == [(0, "P", "i1"), (1, "P", "i2")]
    for bad, why in (("P i1\nP i1\n", "repeated"), ("P i1\nQ i2\n", "population")):
        (tmp_path / "b.tfam").write_text(bad)
        with pytest.raises(ValueError, match=why):
            readers.read_tfam(spark, str(tmp_path / "b.tfam"))
    (tmp_path / "a.map").write_text("1 a 0.1 10\n1 b 0.2 20\n1 c 0.3 20\n")
    assert {(r["ppos"], r["gpos"]) for r in readers.read_genmap(spark, str(tmp_path / "a.map")).collect()} == {(10, 0.1), (20, 0.3)}
    (tmp_path / "a.freq").write_text("CHR SNP POS ALLELE FREQ\n1 rs1 5 A 0.25\n")
    assert [tuple(r) for r in readers.read_freq(spark, str(tmp_path / "a.freq")).collect()] == [("chr1", "rs1", 5, "A", 0.25)]
    (tmp_path / "a.cen").write_text("1 5 9\nbad\nchrX 1 2\n")
    assert {tuple(r) for r in readers.read_centromeres(spark, str(tmp_path / "a.cen")).collect()} == {("file", "chr1", 5, 9), ("file", "chrX", 1, 2)}
    assert readers.centromeres(spark, "hg19", str(tmp_path / "a.cen")).count() == 23 and readers.centromeres(spark, "none").count() == 0
    assert all(len(v) == 23 and all(a < b for a, b in v) for v in builds.CENTROMERES.values())
    (tmp_path / "a.tgls").write_text("1 rs1 0 5 30 20\n")
    assert [(r["ind"], r["value"]) for r in readers.read_tgls(spark, str(tmp_path / "a.tgls"), 2).orderBy("ind").collect()] == [(0, 30.0), (1, 20.0)]
    (tmp_path / "a.feat").write_text("1:5 A G benign\n1:5 A G damaging\n2:7 C T neutral\n")
    assert {tuple(r) for r in readers.read_features(spark, str(tmp_path / "a.feat")).collect()} == {("chr1", 5, "A", "G", "damaging"), ("chr2", 7, "C", "T", "neutral")}


def test_vcf_to_tped(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT s1 s2\n1 100 rs1 A G . . . GT:DP 0/1:3 1|1\n1 200 rs2 C T . . . GT ./. 0/2\n")
    sinks.vcf_to_tped(spark, str(tmp_path / "a.vcf"), str(tmp_path / "o"))
    assert lines_of(tmp_path / "o.tped") == ["chr1\trs1\t0\t100\tA\tG\tG\tG", "chr1\trs2\t0\t200\t0\t0\tC\t0"]
    assert lines_of(tmp_path / "o.tfam") == ["0\ts1\t0\t0\t0\t0", "0\ts2\t0\t0\t0\t0"]


def test_bed_round_trip(spark, tmp_path):
    inds = spark.createDataFrame([(0, "i0", "P"), (1, "i1", "P")], "ind_idx int, ind_id string, pop string")
    segs = spark.createDataFrame([(1, "chr2", 10, 500, 491), (1, "chr1", 7, 9, 3), (1, "chr1", 100, 1200, 1101)], "ind_idx int, chr string, start bigint, stop bigint, length bigint")
    sinks.write_bed(segs, inds, [100.0, 1000.0], str(tmp_path / "x"))
    lines = lines_of(tmp_path / "x.roh.bed")
    assert lines[0].startswith('track name="Ind: i0 Pop:P ROH"') and lines[1].startswith('track name="Ind: i1')
    assert lines[2:] == ["chr1\t7\t9\tA\t3\t.\t0\t0\t228,26,28", "chr1\t100\t1200\tC\t1101\t.\t0\t0\t55,126,184", "chr2\t10\t500\tB\t491\t.\t0\t0\t77,175,74"]
    back = readers.read_bed(spark, str(tmp_path / "x.roh.bed" / "*"))
    (tmp_path / "one.bed").write_text("\n".join(lines) + "\n")
    back = readers.read_bed(spark, str(tmp_path / "one.bed"))
    assert {(r["ind_id"], r["chr"], r["start"], r["size_class"]) for r in back.collect()} == {("i1", "chr1", 7, "A"), ("i1", "chr1", 100, "C"), ("i1", "chr2", 10, "B")}


def test_settings():
    ok = dict(tped="a", tfam="b", build="hg38", error=0.001, winsize=10)
    assert RohConfig(**ok).check() == []
    assert RohConfig(**ok, max_gap=10).check()
    bad = [dict(tped=None), dict(cm=True), dict(weighted=True), dict(nclust=0), dict(M=0), dict(mu=1.0), dict(build="x"), dict(build=None), dict(winsize=1), dict(winsize=0, winsize_multi=[1, 5]), dict(freq_file="f", freq_only=True), dict(auto_winsize_step=0), dict(size_bounds=[2.0, 1.0]), dict(error=0.0), dict(tgls="x"), dict(max_gap=-1), dict(overlap_frac=1.5)]
    for b in bad:
        with pytest.raises(ValueError):
            RohConfig(**{**ok, **b}).check()
    args = parser().parse_args("--tped a --tfam b --build hg19 --error 1e-3 --winsize-multi 10 20 --auto-winsize".split())
    assert args.winsize_multi == [10, 20] and args.auto_winsize and args.error == 0.001
    with pytest.raises(SystemExit):
        main(["--tped", "a"])


def simulate(folder, n=300, m=12):
    r = random.Random(9)
    tped, gmap = [], []
    for c in ("1", "2"):
        for j in range(n):
            p = r.uniform(0.2, 0.8)
            alleles = []
            for i in range(m):
                block = (j // 50 + i) % 5 == 0  # long stretches of equal copies
                a = "A" if r.random() < p else "G"
                b = a if block else "A" if r.random() < p else "G"
                alleles += ["0", b] if r.random() < 0.01 else [a, b]
            pos = 1000 + j * 1000 + r.randrange(300)
            tped.append(f"{c} rs{c}_{j} 0 {pos} " + " ".join(alleles))
            if j % 5 == 0 or j == n - 1:
                gmap.append(f"{c} rs{c}_{j} {pos * 1e-6:.6f} {pos}")
    (folder / "s.tped").write_text("\n".join(tped) + "\n")
    (folder / "s.map").write_text("\n".join(gmap) + "\n")
    (folder / "s.tfam").write_text("".join(f"P i{i}\n" for i in range(m)))
    (folder / "s.cen").write_text("chr1 150000 152000\n")


def test_runs_from_files(spark, tmp_path):
    simulate(tmp_path)
    base = dict(tped=str(tmp_path / "s.tped"), tfam=str(tmp_path / "s.tfam"), centromere=str(tmp_path / "s.cen"), error=0.01, winsize=20, max_gap=20_000)
    r = pipeline.run(spark, RohConfig(**base, out=str(tmp_path / "a"), raw_lod=True, kde_subsample=0, size_bounds=[40_000.0, 60_000.0], no_kde_thinning=True))
    assert r.segments.count() > 20 and r.winsize == 20 and r.bounds == [40_000.0, 60_000.0]
    assert {x["size_class"] for x in r.segments.collect()} <= set("ABC")
    lines = lines_of(tmp_path / "a.roh.bed")
    assert sum(x.startswith("track") for x in lines) == 12 and len(lines) == 12 + r.segments.count()
    assert len(lines_of(tmp_path / "a.20SNPs.kde")) == 512 and lines_of(tmp_path / "a.freq.gz")[0].startswith("CHR")
    w = pipeline.run(spark, RohConfig(**{**base, "winsize": 8}, map=str(tmp_path / "s.map"), weighted=True, cm=True, out=str(tmp_path / "b"), lod_cutoff=1.0, size_bounds=[0.04]))
    assert w.segments.count() > 5 and w.segments.agg({"length": "max"}).first()[0] < 1.0
    e = pipeline.run(spark, RohConfig(**{**base, "winsize": 0}, winsize_multi=[10, 20], out=str(tmp_path / "c")))
    assert e.segments is None and len(lines_of(tmp_path / "c.10SNPs.kde")) == 512
    pipeline.run(spark, RohConfig(**base, freq_only=True, resample=10, out=str(tmp_path / "d")))
    assert len(lines_of(tmp_path / "d.freq.gz")) == 601
    (tmp_path / "few.tfam").write_text("P i0\n")
    with pytest.raises(ValueError, match="another number"):
        pipeline.run(spark, RohConfig(**{**base, "tfam": str(tmp_path / "few.tfam")}, out=str(tmp_path / "e")))


def test_a_chr_without_map_raises(spark, tmp_path):
    simulate(tmp_path, 40, 4)
    gmap = [x for x in (tmp_path / "s.map").read_text().splitlines() if not x.startswith("2 ")]
    (tmp_path / "s.map").write_text("\n".join(gmap) + "\n")
    cfg = RohConfig(tped=str(tmp_path / "s.tped"), tfam=str(tmp_path / "s.tfam"), centromere=str(tmp_path / "s.cen"), error=0.01, winsize=5, map=str(tmp_path / "s.map"), cm=True, out=str(tmp_path / "a"))
    with pytest.raises(ValueError, match="no rows for chr2"):
        pipeline.prepared_sites(cfg, pipeline.load(spark, cfg))


def test_likelihoods_keep_to_their_lines(spark, tmp_path):
    (tmp_path / "a.tped").write_text("1 rs1 0 5 A G A A\n1 rs2 0 5 A A G G\n1 rs3 0 9 A G G G\n")
    (tmp_path / "a.tfam").write_text("P i0\nP i1\n")
    gl = ["1 rs1 0 5 11 12\n", "1 rs2 0 5 13 14\n", "1 rs3 0 9 15 16\n"]
    cfg = RohConfig(tped=str(tmp_path / "a.tped"), tfam=str(tmp_path / "a.tfam"), tgls=str(tmp_path / "a.tgls"), gl_type="GQ", build="hg19", winsize=2, out=str(tmp_path / "o"))
    (tmp_path / "a.tgls").write_text("".join(gl))
    calls = pipeline.load(spark, cfg).calls
    each = {(r["locus_idx"], r["ind_idx"]): r["error"] for r in calls.collect()}
    want = {(int(k), int(i)): e for k, i, e in [(r["line_no"] - 1, r["ind"], r["error"]) for r in readers.read_tgls(spark, cfg.tgls, 2).withColumn("error", exprs.gl_to_error("value", "GQ")).collect()]}
    assert each == want and len(set(each.values())) == 6
    (tmp_path / "a.tgls").write_text("".join(gl[:2]))
    with pytest.raises(Exception, match="no likelihood"):
        pipeline.load(spark, cfg)


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("1 rs1 0 5 A G A A\n\nshort\n")
    where = [str(tmp_path / x) for x in ("in", "out", "chk")]
    stream.stream_freqs(spark, *where).awaitTermination()
    (tmp_path / "in" / "b").write_text("1 rs2 0 9 C 0 T C\n")
    stream.stream_freqs(spark, *where).awaitTermination()
    got = {r["locus_name"]: (r["allele"], r["freq"]) for r in spark.read.parquet(where[1]).collect()}
    assert got == {"rs1": ("A", 0.75), "rs2": ("C", 2 / 3)}


def test_parts_read_back_whole(spark, tmp_path):
    """What the writers spread over many parts comes back row by row, with its individual."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        freqs = spark.createDataFrame([(0, f"chr{1 + i % 11}", ".", 10 * i, "A", i / 400) for i in range(400)], "panel_id int, chr string, locus_name string, ppos bigint, allele string, freq double")
        sinks.write_freq(freqs.repartition(7), str(tmp_path / "x"))
        inds = spark.createDataFrame([(i, f"i {i}", "P") for i in range(40)], "ind_idx int, ind_id string, pop string")
        segs = spark.createDataFrame([(i % 40, f"chr{1 + i % 11}", 1000 * i, 1000 * i + 50, 51) for i in range(400)], "ind_idx int, chr string, start bigint, stop bigint, length bigint")
        sinks.write_bed(segs.repartition(7), inds, [100.0], str(tmp_path / "x"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "x.roh.bed").glob("part-*"))) > 6 and len(list((tmp_path / "x.freq.gz").glob("part-*"))) > 6
    back = readers.read_freq(spark, str(tmp_path / "x.freq.gz" / "part-*")).collect()
    assert {(r["chr"], r["ppos"], r["freq"]) for r in back} == {(f"chr{1 + i % 11}", 10 * i, i / 400) for i in range(400)} and len(back) == 400
    bed = readers.read_bed(spark, str(tmp_path / "x.roh.bed" / "part-*")).collect()
    assert {(r["ind_id"], r["pop"], r["chr"], r["start"]) for r in bed} == {(f"i {i % 40}", "P", f"chr{1 + i % 11}", 1000 * i) for i in range(400)} and len(bed) == 400
    order = [x.split("\t")[0] for x in lines_of(tmp_path / "x.freq.gz")[1:]]
    assert order == sorted(order, key=lambda c: int(c[3:]))  # chr10 behind chr9
    given = spark.createDataFrame([("chr2", 0), ("chr1", 1)], "chr string, place bigint")
    sinks.write_bed(segs, inds, [100.0], str(tmp_path / "y"), chr_order=given)
    mine = [x.split("\t")[0] for x in lines_of(tmp_path / "y.roh.bed") if x.startswith("chr")]
    assert mine.index("chr1") > mine.index("chr2") or mine[0] != "chr1"


def test_repeated_names_keep_their_frequencies(spark, tmp_path):
    (tmp_path / "a.tped").write_text("".join(f"1 . 0 {p} A G A A\n" for p in (5, 5, 9, 12, 15)))
    (tmp_path / "a.tfam").write_text("P i0\nP i1\n")
    (tmp_path / "f").write_text("CHR SNP POS ALLELE FREQ\n1 . 5 A 0.1\n1 . 5 G 0.8\n1 . 9 A 0.3\n1 . 12 A 0.4\n1 . 15 A 0.5\n")
    cfg = RohConfig(tped=str(tmp_path / "a.tped"), tfam=str(tmp_path / "a.tfam"), freq_file=str(tmp_path / "f"), error=0.1, build="hg19", winsize=2, out=str(tmp_path / "o"))
    got = sorted((r["locus_idx"], round(r["freq"], 6)) for r in pipeline.load(spark, cfg).freqs.collect())
    assert got == [(0, 0.1), (1, 0.2), (2, 0.3), (3, 0.4), (4, 0.5)]
    from rohspark.operators import sites

    twice = spark.createDataFrame([(0, "chr1", "x", "A", 0.5)] * 2, "panel_id int, chr string, locus_name string, allele string, freq double")
    with pytest.raises(Exception, match="more than once"):
        sites.flip_freqs(twice.limit(1), twice).collect()
    (tmp_path / "f").write_text("CHR SNP POS ALLELE FREQ\n1 . 5 A 0.1\n")
    with pytest.raises(Exception, match="not in the frequency file"):
        pipeline.load(spark, cfg)


def test_feature_counts_from_files(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(
        "##x\n#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT s1 s2\n"
        "1 100 . A G . . . GT 1/1 0/0\n1 200 . C T . . . GT 0/0 1/1\n1 300 . C T . . . GT 1/1 0/1\n1 400 . G A . . . GT ./. 1/1\n"
    )
    (tmp_path / "f").write_text("1:100 A G bad\n1:200 C C mild\n1:200 C T bad\n1:300 C T bad\n1:400 G A mild\n1:999 G A mild\n")
    (tmp_path / "r.bed").write_text('track name="Ind: s1 Pop:P ROH" description="Ind: s1 Pop:P ROH" visibility=2 itemRgb="On"\nchr1\t100\t300\tB\t201\t.\t0\t0\t77,175,74\n')
    main(["features", "--features", str(tmp_path / "f"), "--roh", str(tmp_path / "r.bed"), "--vcf", str(tmp_path / "a.vcf"), "--out", str(tmp_path / "n")])
    lines = [x.split() for x in lines_of(tmp_path / "n")]
    assert lines[0] == ["badA", "badB", "badC", "badNONE", "mildA", "mildB", "mildC", "mildNONE"]
    # at 200 the feature of REF goes first, so the homozygote of ALT doesn't count; 300 lies behind the segment
    assert lines[1] == ["s1", "0", "1", "0", "1", "0", "1", "0", "0"] and lines[2] == ["s2", "0", "0", "0", "0", "0", "0", "0", "1"]
    main(["vcf2tped", "--vcf", str(tmp_path / "a.vcf"), "--out", str(tmp_path / "t")])
    tped = pipeline.count_features(spark, str(tmp_path / "f"), str(tmp_path / "r.bed"), str(tmp_path / "m"), tped=str(tmp_path / "t.tped"), tfam=str(tmp_path / "t.tfam"))
    assert {r["ind_id"]: r["badNONE"] for r in tped.collect()} == {"s1": 1, "s2": 1}  # a tped knows no REF
    for bad in (["features", "--out", "x"], ["--tped", "a", "--tped", "b"]):
        with pytest.raises(SystemExit):
            main(bad)
    with pytest.raises(ValueError):
        pipeline.count_features(spark, "f", "r", "o")


def test_log_and_error_files(spark, tmp_path):
    simulate(tmp_path, 60, 4)
    base = ["--tped", str(tmp_path / "s.tped"), "--tfam", str(tmp_path / "s.tfam"), "--centromere", str(tmp_path / "s.cen"), "--error", "0.01", "--winsize", "5", "--lod-cutoff", "0.5", "--max-gap", "20000"]
    main([*base, "--size-bounds", "10000", "--out", str(tmp_path / "a")])
    log = lines_of(tmp_path / "a.log")
    assert "winsize = 5" in log and "individuals = 4" in log and any(x.startswith("loci_used = ") for x in log)
    (tmp_path / "s.tfam").write_text("P i0\n")
    with pytest.raises(SystemExit):
        main([*base, "--out", str(tmp_path / "b")])
    assert "another number" in lines_of(tmp_path / "b.error")[0]
