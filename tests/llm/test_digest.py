import datetime as dt
import math
import random

import numpy as np
import pytest

from rohspark.llm import digest

S = "roh_id bigint, ind_idx int, pop string, called_on date, loaded_at timestamp, roh_length double, n bigint, q double"
T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
D = dt.date(2024, 1, 1)


def table(seed=1, n=20_000):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        pop = r.choice(["AA", " aa", "AA\t", "Aa", "BB", None]) if r.random() < 0.3 else "AA"
        v = r.choice([None, float("nan"), -1.0, 0.0, float("inf")]) if r.random() < 0.02 else r.choice([50.0, 60.0]) if r.random() < 0.2 else round(r.lognormvariate(11, 1.5), 1)
        rows.append((i, 1, pop, D + dt.timedelta(days=r.randrange(3)) if r.random() < 0.9 else None, T, v, 5, 0.5))
    rows += rows[:500]
    rows += [(i, 1, "AA", D, T + dt.timedelta(days=1), 77.0, 5, 0.5) for i in range(10)]  # later versions
    rows += [(i, 1, "BB", D, None, 1.0, 5, 0.5) for i in range(10)] + [(None, 1, "AA", D, T, 5.0, 5, 0.5)]
    return rows


def groups(rows):
    last = {}
    for i, _, pop, day, t, v, *_ in rows:
        if i is not None:
            t = t or T - dt.timedelta(days=9999)
            if i not in last or t > last[i][0]:
                last[i] = (t, pop, day, v)
    out = {}
    for _, pop, day, v in last.values():
        if v is not None and math.isfinite(v) and v > 0:
            p = pop.strip(" \t").upper() if pop is not None else None
            out.setdefault(("pop", p, None), []).append(v)
            out.setdefault(("pop_day", p, day), []).append(v)
    return {k: np.sort(v) for k, v in out.items()}


def test_certified_against_sorted_values(spark):
    rows = table()
    want = groups(rows)
    got = digest.length_percentiles(spark.createDataFrame(rows, S).repartition(7)).collect()
    assert len(got) == len(want) * len(digest.QUANTILES)
    for r in got:
        v = want[(r["level"], r["pop"], r["called_on"])]
        assert r["n"] == len(v)
        lo, hi = np.searchsorted(v, r["estimate"], "left"), np.searchsorted(v, r["estimate"], "right")
        error = max(0.0, lo - r["q"] * len(v), r["q"] * len(v) - hi) / len(v)
        assert abs(error - r["rank_error"]) < 1e-12 and r["certified"] and error <= r["bound"]
        assert r["bound"] < min(0.01, 0.3 * min(r["q"], 1 - r["q"])) + 1 / len(v)


def test_heavy_group_is_small_and_merging_keeps_weights(spark):
    df = spark.range(300_000).selectExpr("'x' AS k", "CAST(id * id % 99991 AS DOUBLE) AS v").repartition(6)
    local = digest.local_digests(df, ["k"], "v")
    assert local.count() == 6 and local.selectExpr("max(size(means))").first()[0] <= digest.DELTA + 2
    merged = digest.merge_digests(local, ["k"]).collect()
    assert len(merged) == 1 and merged[0]["n"] == 300_000 and abs(sum(merged[0]["weights"]) - 300_000) < 1e-6
    assert merged[0]["low"] == 0.0 and merged[0]["means"] == sorted(merged[0]["means"])


def test_days_made_apart_combine(spark):
    r = np.random.default_rng(5)
    days = [r.exponential(size=5000), r.exponential(size=3000) * 4]
    parts = [digest.local_digests(spark.createDataFrame([("k", float(x)) for x in d], "k string, v double"), ["k"], "v") for d in days]
    xs = digest.digest_quantiles(digest.merge_digests(parts[0].unionByName(parts[1]), ["k"]), ["k"]).first()["xs"]
    v = np.sort(np.concatenate(days))
    for q, x in zip(digest.QUANTILES, xs):
        assert abs(np.searchsorted(v, x) / len(v) - q) < digest.rank_bound(q)


def test_many_groups_pass_through_a_small_buffer(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id % 700 AS k", "CAST(id AS DOUBLE) AS v").coalesce(1)
    monkeypatch.setattr(digest, "_FLUSH", 50)
    flushed = list(digest.local_digests(df, ["k"], "v").groupBy("k").count().collect())
    assert len(flushed) == 700
    merged = digest.merge_digests(digest.local_digests(df, ["k"], "v"), ["k"])
    assert merged.count() == 700 and merged.selectExpr("sum(n)").first()[0] == 5000


def test_small_and_empty(spark):
    assert digest.length_percentiles(spark.createDataFrame([], S)).count() == 0
    rows = [(1, 1, "x", D, T, 5.0, 0, 0.0), (2, 1, None, None, T, 5.0, 0, 0.0), (3, 1, "", D, T, 9.0, 0, 0.0)]
    got = digest.length_percentiles(spark.createDataFrame(rows, S)).collect()
    assert {(r["level"], r["pop"], r["called_on"], r["estimate"]) for r in got} == {(lv, p, d if lv == "pop_day" else None, v) for p, d, v in (("X", D, 5.0), (None, None, 5.0), ("", D, 9.0)) for lv in ("pop", "pop_day")}


def test_clusters():
    g, m, w = digest.cluster(np.zeros(1000, dtype=int), np.arange(1000.0), np.ones(1000), 50.0)
    assert w.sum() == 1000 and w[0] <= 4 and w.max() <= 1000 * math.pi / 50 + 2 and (np.diff(m) > 0).all()
    assert len(digest.cluster(np.zeros(0, dtype=int), np.zeros(0), np.zeros(0), 50.0)[0]) == 0
    assert digest.rank_bound(0.5) == pytest.approx(4 * math.pi / digest.DELTA, rel=1e-6) and digest.rank_bound(0.5) < 0.01
    assert digest.rank_bound(0.01) < 0.002 and digest.rank_bound(0.01) == pytest.approx(digest.rank_bound(0.99))


@pytest.mark.parametrize("depth", [1, 2, 5, 9])
def test_bound_holds_for_any_number_of_clusterings(depth):
    """Values dealt to many digests by size or at random, and clustered `depth` times, stay within the bound."""
    r = np.random.default_rng(depth)
    delta, values = 100.0, r.lognormal(size=20_000)
    for deal in (np.sort(values), values):
        parts = [(np.zeros(len(p), dtype=int), np.sort(p), np.ones(len(p))) for p in np.array_split(deal, 64)]
        for level in range(depth):
            parts = [digest.cluster(*p, delta) for p in parts]
            if level + 1 < depth:
                step = max(1, round(len(parts) ** (1 / (depth - level - 1))))
                parts = [tuple(np.concatenate(x) for x in zip(*parts[i : i + step])) for i in range(0, len(parts), step)]
        group, mean, weight = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(mean, kind="stable")
        qs = (0.001, 0.01, 0.1, 0.5, 0.9, 0.999)
        for q, x in zip(qs, digest._quantiles(mean[by], weight[by], values.min(), values.max(), qs)):
            rank = [np.searchsorted(np.sort(values), x, side) for side in ("left", "right")]
            assert max(rank[0] - q * 20_000, q * 20_000 - rank[1], 0) <= digest.rank_bound(q, delta, depth) * 20_000 + 1
        cells = np.arcsin(np.clip(2 * np.cumsum(weight[by]) / 20_000 - 1, -1, 1)) * delta / (2 * math.pi)
        if len(parts) == 1:
            assert (np.diff(cells)[weight[by][1:] > 1] <= 1 + 1e-9).all()


def test_depth_is_counted(spark, monkeypatch):
    df = spark.range(5000).selectExpr("'x' AS k", "CAST(id AS DOUBLE) AS v").coalesce(1)
    local = digest.local_digests(df, ["k"], "v", 20.0)
    assert [r["depth"] for r in local.collect()] == [1]
    assert digest.merge_digests(local, ["k"], 20.0).first()["depth"] == 2
    monkeypatch.setattr(digest, "_FLUSH", 15)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        many = digest.merge_digests(local.unionByName(local).unionByName(local), ["k"], 20.0).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert many["depth"] > 2 and many["n"] == 15_000
