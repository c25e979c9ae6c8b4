"""Gaussian mixture of segment lengths and the bounds between its classes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rohspark.functions import exprs


@dataclass
class GmmModel:
    """Classes by rising mean; `var` are variances."""

    weight: list[float]
    mean: list[float]
    var: list[float]
    loglik: float = float("nan")
    iterations: int = 0
    n: int = 0

    @property
    def bic(self) -> float:
        return -2 * self.loglik + (3 * len(self.weight) - 1) * math.log(self.n)

    def sorted(self) -> "GmmModel":
        by = sorted(range(len(self.mean)), key=lambda i: self.mean[i])
        return GmmModel(*([v[i] for i in by] for v in (self.weight, self.mean, self.var)), self.loglik, self.iterations, self.n)


def length_counts(lengths: DataFrame, value: str = "length") -> DataFrame:
    """(x, w): distinct finite lengths with their counts."""
    return lengths.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("w"))


def init_gmm(counts: DataFrame, k: int) -> GmmModel:
    """Equal weights, means and variances spread over the overall mean and sample variance."""
    n, sx = F.sum("w"), F.sum(F.col("w") * F.col("x"))
    row = counts.agg(n.alias("n"), (sx / n).alias("mean")).first()
    if not row["n"]:
        raise ValueError("no lengths to fit")
    mean, total = row["mean"], row["n"]
    ss = counts.agg(F.sum(F.col("w") * F.pow(F.col("x") - mean, F.lit(2.0)))).first()[0]
    var = ss / max(total - 1, 1)
    return GmmModel([1 / k] * k, [mean * (i + 1) / (k + 1) for i in range(k)], [max(var, 1e-12) * (i + 1) / k for i in range(k)], n=int(total))


def em_sums(counts: DataFrame, m: GmmModel) -> DataFrame:
    """One row: log-likelihood and per class the responsibilities' sums over 1, x and x^2, by a single aggregation."""
    logs = [math.log(a) + exprs.normal_log("x", mu, v) for a, mu, v in zip(m.weight, m.mean, m.var)]
    df = counts.withColumns({f"l{i}": e for i, e in enumerate(logs)})
    top = F.greatest(*(f"l{i}" for i in range(len(logs)))) if len(logs) > 1 else F.col("l0")
    df = df.withColumn("top", top)
    df = df.withColumn("lse", F.col("top") + F.ln(sum((F.exp(F.col(f"l{i}") - F.col("top")) for i in range(len(logs))), F.lit(0.0))))
    r = [F.col("w") * F.exp(F.col(f"l{i}") - F.col("lse")) for i in range(len(logs))]
    aggs = [F.sum(F.col("w") * F.col("lse")).alias("loglik")]
    for i, ri in enumerate(r):
        aggs += [F.sum(ri).alias(f"n{i}"), F.sum(ri * F.col("x")).alias(f"sx{i}"), F.sum(ri * F.col("x") * F.col("x")).alias(f"sxx{i}")]
    return df.agg(*aggs)


def em_update(m: GmmModel, s) -> GmmModel:
    """The model after one step from a row of `em_sums`; a class without weight keeps its place."""
    n = m.n
    weight, mean, var = [], [], []
    for i in range(len(m.weight)):
        w = s[f"n{i}"]
        weight.append(max(w / n, 1e-300))
        mean.append(s[f"sx{i}"] / w if w > 1e-12 else m.mean[i])
        var.append(max(s[f"sxx{i}"] / w - mean[-1] ** 2, 1e-12) if w > 1e-12 else m.var[i])
    return GmmModel(weight, mean, var, s["loglik"], m.iterations + 1, n)


def fit_gmm(lengths: DataFrame, k: int = 3, max_iter: int = 1000, tol: float = 1e-5, value: str = "length", at_driver: int = 2_000_000) -> GmmModel:
    """EM to a change of log-likelihood of at most `tol`; classes come out by rising mean.

    Equal lengths are counted first. Where at most `at_driver` distinct ones are left the steps run in
    NumPy on those; beyond, each step is one distributed aggregation. Both are the same computation.
    """
    counts = length_counts(lengths, value).persist()
    try:
        m = init_gmm(counts, k)
        few = counts.limit(at_driver + 1).count() <= at_driver
        if few:
            pdf = counts.toPandas()
            x, w = pdf["x"].to_numpy(), pdf["w"].to_numpy("float64")
        for _ in range(max_iter):
            s = _numpy_sums(x, w, m) if few else em_sums(counts, m).first()
            before, m = m.loglik, em_update(m, s)
            if abs(m.loglik - before) <= tol:
                break
        return m.sorted()
    finally:
        counts.unpersist()


def _numpy_sums(x: np.ndarray, w: np.ndarray, m: GmmModel) -> dict[str, float]:
    mean, var = np.array(m.mean), np.array(m.var)
    logs = np.log(np.array(m.weight)) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
    top = logs.max(axis=1)
    lse = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
    r = w[:, None] * np.exp(logs - lse[:, None])
    s = {"loglik": float(w @ lse)}
    for i in range(len(mean)):
        s |= {f"n{i}": float(r[:, i].sum()), f"sx{i}": float(r[:, i] @ x), f"sxx{i}": float(r[:, i] @ x**2)}
    return s


def boundary(a1: float, m1: float, v1: float, a2: float, m2: float, v2: float) -> float:
    """Where two weighted normal densities are equal, between their means: a root of a quadratic."""
    qa = 1 / v2 - 1 / v1
    qb = 2 * (m1 / v1 - m2 / v2)
    qc = m2 * m2 / v2 - m1 * m1 / v1 + 2 * math.log(a1 / a2) - math.log(v1 / v2)
    if abs(qa) < 1e-300:
        roots = [-qc / qb] if qb else []
    else:
        d = qb * qb - 4 * qa * qc
        s = math.sqrt(d) if d >= 0 else float("nan")
        roots = [(-qb + s) / (2 * qa), (-qb - s) / (2 * qa)]
    between = [r for r in roots if min(m1, m2) <= r <= max(m1, m2)]
    if not between:
        raise ValueError("the classes' densities don't meet between their means")
    return between[0]


def size_bounds(m: GmmModel) -> list[float]:
    """Bounds between neighbouring classes."""
    m = m.sorted()
    p = list(zip(m.weight, m.mean, m.var))
    return [boundary(*a, *b) for a, b in zip(p, p[1:])]
