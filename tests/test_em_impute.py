import random

import numpy as np
from tests.conftest import T0

from rohspark.operators import em_impute

G = "ind_idx int, chr string, locus_idx int, panel_id int, ppos bigint, g smallint, first_copy boolean, loaded_at timestamp, pop string"
I = "ind_idx int, fam_id string, pop string, registered_at timestamp, g string"
P = "pop string, pop_area string"


def test_mixture_recovers_two_classes_and_fills_held_out_values(spark):
    r = np.random.default_rng(3)
    rows, truth = [], []
    for i in range(2000):
        k = int(r.random() < 0.4)
        x, c = float(r.normal([0, 6][k], 1)), "ab"[k] if r.random() < 0.9 else "ba"[k]
        hide = r.random()
        truth.append((i, x, c, k, hide))
        rows.append((i, None if hide < 0.2 else x, None if hide > 0.8 else c, "kept"))
    df = spark.createDataFrame(rows, "id int, x double, c string, chr string")
    out = {q["id"]: q for q in em_impute.em_impute(df, ["x"], {"c": ["a", "b"]}, k=2).collect()}
    right = [out[i]["c_filled"] == "ab"[k] for i, _, _, k, h in truth if h > 0.8]
    err = [abs(out[i]["x_filled"] - x) for i, x, _, _, h in truth if h < 0.2]
    assert sum(right) / len(right) > 0.95 and np.median(err) < 1.2
    assert all(out[i]["x_was_filled"] == (h < 0.2) and out[i]["c_was_filled"] == (h > 0.8) and out[i]["chr"] == "kept" for i, _, _, _, h in truth)


def test_likelihood_never_falls(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(r.gauss(0, 1) if r.random() < 0.5 else r.gauss(4, 0.5), r.choice("abc")) for _ in range(500)], "x double, c string")
    m = em_impute.fit_mixture(em_impute.weigh(df, ["x", "c"]), ["x"], {"c": ["a", "b", "c"]}, 3, tol=-1, max_iter=12)
    assert all(b > a - 1e-3 for a, b in zip(m.history, m.history[1:]))


def test_em_edge_cases(spark):
    s = "x double, c string"
    assert em_impute.em_impute(spark.createDataFrame([], s), ["x"], {"c": ["a"]}).count() == 0
    rows = [(None, None), (float("nan"), None), (1.0, None), (float("inf"), "a"), (1.0, "a"), (1.0, "a"), (2.0, "unknown")]
    out = em_impute.em_impute(spark.createDataFrame(rows, s), ["x"], {"c": ["a"]}, k=2).collect()
    assert [(r["x_was_filled"], r["c_was_filled"]) for r in out] == [(False, False), (False, False), (False, True), (True, False), (False, False), (False, False), (False, True)]
    assert out[0]["x_filled"] is None or np.isnan(out[0]["x_filled"])
    assert out[0]["c_filled"] is None and out[3]["x_filled"] is not None


def tables(spark):
    g, t1 = [], T0.replace(year=2025)
    for ind in range(6):
        for locus in range(8):
            v = None if (ind, locus) in ((0, 0), (1, 3)) else 7 if (ind, locus) == (2, 4) else (2 if locus % 2 else 0)
            g.append((ind, "chr1", locus, 1, 100 * locus, v, None, T0, "clash"))
    g += [(5, "chr1", 2, 1, 200, None, None, t1, "clash")]  # a later version that is missing
    g += [(i, "chr2", 0, 1, 9, None, None, T0, "") for i in range(6)]  # nothing known at the site
    g += [(None, "chr1", 0, 1, 0, 1, None, T0, ""), (1, None, 0, 1, 0, None, None, T0, ""), (1, "chr1", None, 1, 0, None, None, T0, "")]
    g += g[:5]
    inds = [(0, "f1", " aa\t", T0, "x"), (1, "f1", "n/a", T0, "x"), (2, "f2", None, T0, "x"), (3, None, "?", T0, "x"), (4, None, "BB", T0, "x"), (5, "f1", "BB", T0, "x"), (5, "f1", "aa", t1, "x"), (6, "f2", "", None, "x")]
    return spark.createDataFrame(g, G), spark.createDataFrame(inds + inds[:1], I), spark.createDataFrame([("AA", "x"), ("BB", "x"), (None, "x"), ("AA", "y")], P)


def test_calls_and_pops(spark):
    g, inds, pops = tables(spark)
    calls = em_impute.fill_calls(g, inds, pops).collect()
    assert len(calls) == 6 * 8 + 6
    filled = {(r["ind_idx"], r["chr"], r["locus_idx"]): r["g_filled"] for r in calls if r["g_was_filled"]}
    assert filled == {(0, "chr1", 0): 0, (1, "chr1", 3): 2, (2, "chr1", 4): 0, (5, "chr1", 2): 0}
    assert all(r["g_filled"] is None for r in calls if r["chr"] == "chr2")
    out = {r["ind_idx"]: (r["pop"], r["pop_filled"], r["pop_was_filled"]) for r in em_impute.fill_pops(inds, pops).collect()}
    assert out == {0: ("AA", "AA", False), 1: (None, "AA", True), 2: (None, None, False), 3: (None, None, False), 4: ("BB", "BB", False), 5: ("AA", "AA", False), 6: (None, None, False)}


def test_empty_tables(spark):
    g, i, p = (spark.createDataFrame([], s) for s in (G, I, P))
    assert em_impute.filled_cases(g, i, p).count() == 0
    full, _, _ = tables(spark)
    assert em_impute.filled_cases(full, i, p).count() == 4


def test_filled_calls_agree_with_hidden_ones(spark):
    """Held-out accuracy: calls follow their site's frequency, and half of the sites are nearly fixed."""
    r = random.Random(4)
    rows, hidden = [], {}
    for locus in range(60):
        p = r.choice([0.02, 0.98, 0.1])
        for ind in range(25):
            v = (r.random() < p) + (r.random() < p)
            if r.random() < 0.1:
                hidden[(ind, locus)] = v
            rows.append((ind, "chr1", locus, 1, locus, None if (ind, locus) in hidden else int(v), None, T0, ""))
    inds = spark.createDataFrame([(i, None, "AA", T0, "") for i in range(25)], I)
    out = em_impute.fill_calls(spark.createDataFrame(rows, G), inds, spark.createDataFrame([("AA", "")], P)).where("g_was_filled").collect()
    assert len(out) == len(hidden)
    assert sum(hidden[(q["ind_idx"], q["locus_idx"])] == q["g_filled"] for q in out) / len(out) > 0.85


def test_both_ways_of_adding_up(spark):
    df = spark.range(100, numPartitions=5)

    def step(pdf):
        return np.array([len(pdf), pdf["id"].sum()], dtype=float)

    for most in (0, 1000):
        assert list(em_impute._summed(df, step, 2, at_driver=most)) == [100.0, 4950.0]
        assert list(em_impute._summed(df.where("id < 0"), step, 2, at_driver=most)) == [0.0, 0.0]
