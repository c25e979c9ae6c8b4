"""Window scores, assembly, linkage and densities against literal loops."""

import math
import random

import numpy as np
import pytest

from rohspark.functions import exprs
from rohspark.operators import density, features, linkage, mixture, roh, sites

W, GAP, ERR = 4, 300, 0.01


def study(seed=1, n=40, m=5):
    r = random.Random(seed)
    pos, at = [], 0
    for _ in range(n):
        at += r.choice([50, 80, 120, 120, 90, 500 if r.random() < 0.3 else 70])
        pos.append(at)
    p = [r.uniform(0.1, 0.9) for _ in range(n)]
    g = [[None if r.random() < 0.05 else (0 if r.random() < 0.7 else r.randrange(3)) if i % 2 else int((r.random() < p[j]) + (r.random() < p[j])) for j in range(n)] for i in range(m)]
    first = [[r.random() < 0.5 for _ in range(n)] for _ in range(m)]
    return pos, p, g, first, (pos[12] + 10, pos[12] + 20)


def tables(spark, pos, p, g, first, cen):
    calls = spark.createDataFrame([(1, "chr1", j, pos[j], i, g[i][j], first[i][j]) for i in range(len(g)) for j in range(len(pos))], "panel_id int, chr string, locus_idx int, ppos bigint, ind_idx int, g int, first_copy boolean")
    freqs = sites.call_freqs(calls)
    s = roh.site_breaks(sites.number_sites(sites.filter_monomorphic(freqs)), spark.createDataFrame([("chr1", *cen)], "chr string, c_start bigint, c_end bigint"), GAP)
    return calls, s


def lod(g, p, e=ERR):
    if g is None or not 0 < p < 1:
        return 0.0
    q = 1 - p
    f = {0: q, 2: p}.get(g)
    return math.log10(e) if g == 1 else math.log10(((1 - e) * f + e * f * f) / f**2)


def loops(pos, g, cen):
    """Kept sites, breaks and window scores by loops."""
    n = len(pos)
    freq = []
    for j in range(n):
        seen = [row[j] for row in g if row[j] is not None]
        freq.append(sum(seen) / (2 * len(seen)) if seen else 0.0)
    kept = [j for j in range(n) if 0 < freq[j] < 1]
    brk = [0]
    for a, b in zip(kept, kept[1:]):
        x, y = pos[a], pos[b]
        brk.append(int(y - x > GAP or cen[0] <= x <= cen[1] or cen[0] <= y <= cen[1] or (x <= cen[0] and cen[1] <= y)))
    scores = []
    for row in g:
        s = [lod(row[j], freq[j]) for j in kept]
        scores.append([sum(s[k : k + W]) if k + W <= len(kept) and not any(brk[k + 1 : k + W]) else None for k in range(len(kept))])
    return kept, freq, brk, scores


def test_windows_and_segments(spark):
    for seed in (1, 2, 3):
        pos, p, g, first, cen = study(seed)
        calls, s = tables(spark, pos, p, g, first, cen)
        kept, freq, brk, scores = loops(pos, g, cen)
        direct = roh.score_calls(calls, spark.createDataFrame([("chr1", *cen)], "chr string, c_start bigint, c_end bigint"), GAP, ERR)
        assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, roh.score_sites(calls, s, ERR).collect()))
        windows = roh.window_scores(direct, W)
        got = {(r["ind_idx"], r["idx"]): r["score"] for r in windows.collect()}
        assert len(got) == len(g) * len(kept)
        for i, row in enumerate(scores):
            for k, v in enumerate(row):
                assert (got[(i, k)] is None) == (v is None) and (v is None or abs(got[(i, k)] - v) < 1e-9)
        for cutoff, frac in ((0.0, 0.25), (-0.5, 0.6), (0.4, 0.0)):
            least = min(max(frac * W, 1), W)
            want = set()
            for i, row in enumerate(scores):
                cov = [sum(1 for a in range(max(0, k - W + 1), k + 1) if row[a] is not None and row[a] >= cutoff) for k in range(len(kept))]
                k = 0
                while k < len(kept):
                    if cov[k] < least:
                        k += 1
                        continue
                    e = k
                    while e + 1 < len(kept) and cov[e + 1] >= least and not brk[e + 1]:
                        e += 1
                    if e - k + 1 >= least and not (k == e == len(kept) - 1):
                        want.add((i, pos[kept[k]], pos[kept[e]], e - k + 1, pos[kept[e]] - pos[kept[k]] + 1))
                    k = e + 1
            out = roh.assemble(windows, cutoff, W, frac)
            assert {(r["ind_idx"], r["start"], r["stop"], r["n_snps"], r["length"]) for r in out.collect()} == want


def test_calls_are_never_broadcast(spark, tmp_path):
    """Small files may hold more calls than the driver has room for."""
    calls, s = tables(spark, *study(5))
    calls.write.parquet(f"{tmp_path}/calls")
    scored = roh.score_sites(spark.read.parquet(f"{tmp_path}/calls"), s, ERR)
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, roh.score_sites(calls, s, ERR).collect()))
    joins = [x for x in scored._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "locus_idx" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_other_coding_gives_the_same_scores(spark):
    pos, p, g, first, cen = study(4)
    calls, s = tables(spark, pos, p, g, first, cen)
    other = [[None if v is None else 2 - v for v in row] for row in g]
    calls2, s2 = tables(spark, pos, p, other, first, cen)
    a = {(r["ind_idx"], r["idx"]): r["lod"] for r in roh.score_sites(calls, s, ERR).collect()}
    b = {(r["ind_idx"], r["idx"]): r["lod"] for r in roh.score_sites(calls2, s2, ERR).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def pair(g, first, hom, freq, i, j, phased):
    both = [(row[i], row[j], f[i], f[j]) for row, f in zip(g, first) if row[i] is not None and row[j] is not None]
    f = freq if phased else hom
    if not (0 < f[i] < 1 and 0 < f[j] < 1):
        return 0.0
    if not both:
        return None
    if phased:
        x = sum({(2, 2): 2, (1, 2): 1, (2, 1): 1}.get((a, b), 1 if a == b == 1 and c == d else 0) for a, b, c, d in both) / (2 * len(both))
    else:
        x = sum(a != 1 and b != 1 for a, b, _, _ in both) / len(both)
    return min(1.0, (x - f[i] * f[j]) ** 2 / (f[i] * (1 - f[i]) * f[j] * (1 - f[j])))


def test_linkage_and_weighted_windows(spark):
    pos, p, g, first, cen = study(5, 25, 6)
    calls, s = tables(spark, pos, p, g, first, cen)
    s = s.withColumn("gpos", s.ppos * 0.001)
    s = linkage.site_weights(s, 7, 1e-6)
    kept, freq, brk, _ = loops(pos, g, cen)
    hom = {}
    for j in kept:
        seen = [row[j] for row in g if row[j] is not None]
        hom[j] = sum(v != 1 for v in seen) / len(seen)
    numbered = calls.join(s.select("panel_id", "chr", "locus_idx", "idx"), ["panel_id", "chr", "locus_idx"])
    for phased in (False, True):
        ld = {(r["i"], r["j"]): r["ld"] for r in linkage.pair_ld(numbered, s, W, phased).collect()}
        assert len(ld) == sum(min(W - 1, len(kept) - 1 - k) for k in range(len(kept)))
        for (a, b), v in ld.items():
            want = pair(g, first, hom, freq, kept[a], kept[b], phased)
            assert (v is None) == (want is None) and (v is None or abs(v - want) < 1e-9)
    ld = {(r["i"], r["j"]): r["ld"] for r in linkage.pair_ld(numbered, s, W).collect()}
    weights = linkage.ld_weights(linkage.pair_ld(numbered, s, W), s, W)
    for r in weights.collect():
        inside = [k for k in range(r["win_start"], r["win_start"] + W) if k != r["idx"]]
        want = 1 + sum(ld[tuple(sorted((k, r["idx"])))] for k in inside)
        assert abs(r["ld_sum"] - want) < 1e-9
    lw = {(r["win_start"], r["idx"]): r["ld_sum"] for r in weights.collect()}
    got = linkage.weighted_window_scores(roh.score_sites(calls, s, ERR), weights, W).collect()
    step = [pos[kept[0]]] + [pos[b] - pos[a] for a, b in zip(kept, kept[1:])]
    wt = [math.exp(-2 * 7 * 1e-6 * d) * math.exp(-2 * 7 * d * 0.001) for d in step]
    for r in got:
        k = r["idx"]
        if k + W > len(kept) or any(brk[k + 1 : k + W]):
            assert r["score"] is None
        else:
            want = sum(lod(g[r["ind_idx"]][kept[x]], freq[kept[x]]) * wt[x] / lw[(k, x)] for x in range(k, k + W))
            assert abs(r["score"] - want) < 1e-9


def test_interpolation(spark):
    r = random.Random(3)
    xs = sorted(r.sample(range(100, 1000), 20))
    ys = sorted(r.uniform(0, 5) for _ in xs)
    asked = [*range(50, 1050, 7), *xs[:3]]
    s = spark.createDataFrame([(1, "chr1", i, x) for i, x in enumerate(asked)], "panel_id int, chr string, locus_idx int, ppos bigint")
    m = spark.createDataFrame([(1, "chr1", x, y) for x, y in zip(xs, ys)] + [(1, "chr1", 5, None)], "panel_id int, chr string, ppos bigint, gpos double")
    out = sites.interpolate_map(s, m).collect()
    assert len(out) == len(asked)
    for q in out:
        x = q["ppos"]
        if xs[0] <= x <= xs[-1]:
            assert abs(q["gpos"] - np.interp(x, xs, ys)) < 1e-9 and q["interpolated"] == (x not in xs)
        else:
            assert q["gpos"] is None and not q["interpolated"]


def test_density_and_cutoff(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(-10, 2, 700), r.normal(6, 2, 300)])
    pts = spark.createDataFrame([(1, float(v)) for v in x] + [(1, None), (1, float("nan")), (2, 1.0)], "panel_id int, score double")
    d = density.kde(pts).where("panel_id = 1").orderBy("i").toPandas()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    h = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    t = x.min() - 3 * h + np.arange(1, 513) / 512 * (x.max() - x.min() + 6 * h)
    y = np.exp(-(((x[:, None] - t) / h) ** 2)).mean(axis=0)
    y /= y.sum() * (t[1] - t[0])
    assert np.allclose(d["x"], t) and np.allclose(d["y"], y)
    c = density.cutoff_of(t, y, 60)
    assert -6 < c < 4 and density.cutoff_of(t, y, 1) == 0.0
    with pytest.raises(ValueError):
        density.cutoff_of(t, np.zeros(512), 60)
    fits = [np.polyfit(t[k : k + 20], 100 * y[k : k + 20], 1) for k in range(492)]
    want = sum(((100 * y[k : k + 20] - np.polyval(f, t[k : k + 20])) ** 2).sum() for k, f in enumerate(fits)) / 20
    got = {r["panel_id"]: r["wiggle"] for r in density.wiggle(density.kde(pts)).collect()}
    assert abs(got[1] / want - 1) < 1e-6 and 2 not in got


def test_bounds_of_a_known_mixture():
    m = mixture.GmmModel([0.684111, 0.265049, 0.05084], [287592, 711574, 5.95414e6], [1.44797e10, 1.13318e11, 4.30965e13])
    a, b = mixture.size_bounds(m)
    assert abs(a / 535045 - 1) < 1e-4 and abs(b / 1.7574e6 - 1) < 1e-4


def test_mixture_at_driver_and_distributed(spark):
    r = np.random.default_rng(1)
    x = [float(round(v, 1)) for v in np.concatenate([r.normal(100, 10, 300), r.normal(300, 30, 150), r.normal(900, 80, 50)])]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "length double")
    a = mixture.fit_gmm(df, 3, max_iter=15)
    b = mixture.fit_gmm(df, 3, max_iter=15, at_driver=0)
    assert np.allclose(a.mean, b.mean) and np.allclose(a.var, b.var) and np.allclose(a.weight, b.weight) and abs(a.loglik - b.loglik) < 1e-6
    full = mixture.fit_gmm(df, 3)
    assert np.allclose(full.mean, [100, 300, 900], rtol=0.1) and full.n == 500


def test_scalar_functions(spark):
    assert exprs.winsize_for_density(1e-20) == 10 and exprs.overlap_frac_for_density(1e-20, 8) == 1 / 8 and exprs.overlap_frac_for_density(1e9, 8) == 1.0
    df = spark.createDataFrame([(30.0, -0.000434511774018, 0.00434511774018)], "gq double, gl double, pl double")
    row = df.select(*(exprs.gl_to_error(c, c.upper()).alias(c) for c in df.columns)).first()
    assert all(abs(v - 0.001) < 1e-9 for v in row)
    with pytest.raises(ValueError):
        exprs.gl_to_error("x", "XX")
    with pytest.raises(ValueError):
        roh.window_scores(df, 1)
    names = spark.createDataFrame([("1",), ("chr1",), ("Chr1",), ("X",)], "n string").select(exprs.chr_name("n").alias("n")).collect()
    assert [r["n"] for r in names] == ["chr1", "chr1", "chrChr1", "chrX"]


def test_features(spark):
    points = spark.createDataFrame([(1, "chr1", 1, x, "e") for x in (5, 10, 19, 20, 2_500_000, 3_999_998)], "panel_id int, chr string, ind_idx int, ppos bigint, effect string")
    segs = spark.createDataFrame([(1, "chr1", 1, 10, 20, "A"), (1, "chr1", 1, 2_000_000, 3_999_999, "B"), (1, "chr1", 2, 1, 50, "C"), (1, "chr1", 1, 30, 30, "A")], "panel_id int, chr string, ind_idx int, start bigint, stop bigint, size_class string")
    out = features.inside_segments(points, segs)
    assert {r["ppos"]: r["size_class"] for r in out.collect()} == {5: "NONE", 10: "A", 19: "A", 20: "NONE", 2_500_000: "B", 3_999_998: "B"}
    wide = features.pivot_counts(features.feature_counts(out), points, ["e", "f"]).first()
    assert (wide["eA"], wide["eB"], wide["eNONE"], wide["fA"]) == (2, 2, 2, 0)


def test_resampling_is_repeatable(spark):
    df = spark.createDataFrame([(i, 0.3) for i in range(200)] + [(999, 0.0)], "k int, freq double")
    a = {r["k"]: r["freq"] for r in sites.resample_freq(df, 50, 7, ["k"]).collect()}
    b = {r["k"]: r["freq"] for r in sites.resample_freq(df.repartition(5), 50, 7, ["k"]).collect()}
    assert a == b and a[999] == 0.0 and abs(np.mean([v for k, v in a.items() if k < 200]) - 0.3) < 0.03
