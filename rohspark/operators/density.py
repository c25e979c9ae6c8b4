"""Kernel density of the scores, the cutoff between its modes, and the search for a window size.

Densities are made per panel. The kernel sum over 512 targets is added up within each partition in
NumPy and only 512 partial sums per panel leave it: points aren't multiplied by targets in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rohspark.session import broadcast_if_small, materialise

TARGETS = 512
EDGE = 3.0  # bandwidths by which the targets reach beyond the points
SPAN = 20  # targets of a stretch in which modes and lines are sought


def bandwidth(points: DataFrame, value: str = "score", by: tuple[str, ...] = ("panel_id",)) -> DataFrame:
    """Per group `n`, `lowest`, `highest` and `h` = 0.9 min(sd, IQR / 1.34) n^-0.2 with exact quartiles."""
    # counts of equal values first: the exact quartiles are then those of a weighted list
    counts = points.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    quarter = F.percentile("_x", F.array(F.lit(0.25), F.lit(0.75)), F.col("_n")).alias("quarters")
    n, sx = F.sum("_n"), F.sum(F.col("_x") * F.col("_n"))
    stats = materialise(counts.groupBy(*by).agg(n.alias("n"), (sx / n).alias("mean"), F.min("_x").alias("lowest"), F.max("_x").alias("highest"), quarter), "stats")
    spread = counts.join(broadcast_if_small(stats.select(*by, "mean")), list(by)).groupBy(*by).agg(F.sum(F.col("_n") * F.pow(F.col("_x") - F.col("mean"), F.lit(2.0))).alias("ss"))
    both = stats.join(spread, list(by))
    sd = F.sqrt(F.col("ss") / F.nullif(F.col("n") - 1, F.lit(0).cast("bigint")))
    h = 0.9 * F.least(sd, (F.col("quarters")[1] - F.col("quarters")[0]) / 1.34) * F.pow(F.col("n"), F.lit(-0.2))
    return both.select(*by, "n", "lowest", "highest", h.alias("h"))


def kde(points: DataFrame, value: str = "score", by: tuple[str, ...] = ("panel_id",), bands: DataFrame | None = None) -> DataFrame:
    """(by, i, x, y): per group the density at 512 targets, scaled to an area of 1 over them.

    The kernel is exp(-(d / h)^2). Target i lies (i + 1) / 512 of the way over the points' range, widened by
    three bandwidths either side. Groups with a bandwidth of 0 or without one are left out.
    """
    bands = materialise(bandwidth(points, value, by) if bands is None else bands, "bands")
    b = bands.where(F.col("h") > 0).select(*by, "n", (F.col("lowest") - EDGE * F.col("h")).alias("lo"), (F.col("highest") + EDGE * F.col("h")).alias("hi"), "h")
    used = points.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("v")).join(broadcast_if_small(b), list(by))
    names = list(by)
    at = np.arange(1, TARGETS + 1) / TARGETS

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(names, dropna=False):
                lo, hi, h = (float(part[c].iloc[0]) for c in ("lo", "hi", "h"))
                targets = lo + at * (hi - lo)
                total = sums.setdefault(key, np.zeros(TARGETS))
                v = part["v"].to_numpy()
                for k in range(0, len(v), 4096):
                    total += np.exp(-(((v[k : k + 4096, None] - targets) / h) ** 2)).sum(axis=0)
        for key, total in sums.items():
            yield pd.DataFrame({**dict(zip(names, key)), "i": np.arange(TARGETS, dtype="int32"), "s": total})[[*names, "i", "s"]]

    head = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in names)
    sums = used.mapInPandas(partial, f"{head}, i int, s double").groupBy(*names, "i").agg(F.sum("s").alias("s"))
    step = (F.col("hi") - F.col("lo")) / TARGETS
    area = Window.partitionBy(*names)
    joined = sums.join(b, names).withColumn("y", F.col("s") / F.col("n"))
    return joined.select(*names, "i", (F.col("lo") + (F.col("i") + 1) * step).alias("x"), (F.col("y") / (F.sum("y").over(area) * step)).alias("y"))


def wiggle(density: DataFrame, by: tuple[str, ...] = ("panel_id",), span: int = SPAN) -> DataFrame:
    """Per group the roughness of a density: the squared errors of a line through each `span` neighbouring points of 100 y, over `span`."""
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(0, span - 1)
    y = density.withColumn("y", F.col("y") * 100)
    sy, sx, sxy = F.regr_syy("y", "x").over(w), F.regr_sxx("y", "x").over(w), F.regr_sxy("y", "x").over(w)
    rss = y.withColumn("rss", sy - sxy * sxy / F.nullif(sx, F.lit(0.0))).where(F.col("i") < TARGETS - span)
    return rss.groupBy(*by).agg((F.sum("rss") / span).alias("wiggle"))


def cutoff_of(x: np.ndarray, y: np.ndarray, w: int, span: int = SPAN) -> float:
    """The score of least density between the two main modes; 0 if it is `w` or more away from 0.

    Modes are values that stay the maximum of `span` neighbouring targets for longest: of the longest and
    second longest series of equal maxima, the two highest. The first maximum counts with the
    second's series. Raises where the density has no two modes.
    """
    peaks = np.array([y[i : i + span].max() for i in range(len(y) - span)])
    if not len(peaks) or not (peaks > 0).any():
        raise ValueError("the density is zero everywhere")
    series: list[list[float]] = []
    for p in peaks[1:]:
        if series and series[-1][0] == p:
            series[-1][1] += 1
        else:
            series.append([p, 1])
    if series and peaks[0] > 0:
        series[0][1] += 1
    lengths = sorted((n for _, n in series), reverse=True)
    top = sorted((p for p, n in series if n in lengths[:2]), reverse=True)[:2]
    if len(top) < 2:
        raise ValueError("the density has one mode only")
    first, second = (int(np.flatnonzero(y == p)[-1]) for p in top)
    a, b = min(first, second), max(first, second)
    best = float(x[a + int(np.argmin(y[a : b + 1]))])
    return best if abs(best / w) < 1 else 0.0


def lod_cutoffs(density: DataFrame, w: int, by: tuple[str, ...] = ("panel_id",)) -> DataFrame:
    """Per group `cutoff`, null where the density has no two modes. A group is 512 rows."""
    names = list(by)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        try:
            c = cutoff_of(pdf["x"].to_numpy(), pdf["y"].to_numpy(), w)
        except ValueError:
            c = None
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in names}, "cutoff": pd.Series([c], dtype="float64")})

    head = ", ".join(f"{c} {density.schema[c].dataType.simpleString()}" for c in names)
    return density.groupBy(*names).applyInPandas(find, f"{head}, cutoff double")


def explore_winsizes(points_of: Callable[[int], DataFrame], sizes: list[int], by: tuple[str, ...] = ("panel_id",)) -> DataFrame:
    """(by, w, i, x, y): the densities for several window sizes; `points_of(w)` gives the thinned scores."""
    out = None
    for w in sizes:
        d = kde(points_of(w), by=by).withColumn("w", F.lit(w))
        out = d if out is None else out.unionByName(d)
    return out


def first_smooth(wiggles: DataFrame, sizes: list[int], most: float = 0.5, by: tuple[str, ...] = ("panel_id",)) -> DataFrame:
    """Per group the first of `sizes`, in the order given, whose density's wiggle is at most `most`, else the last."""
    order = {w: i for i, w in enumerate(sizes)}
    rank = F.create_map(*(F.lit(v) for pair in order.items() for v in pair))[F.col("w")]
    best = F.min(F.when(F.col("wiggle") <= most, rank))
    return wiggles.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, sizes)), F.coalesce(best, F.lit(len(sizes) - 1)) + 1).alias("w"))


def select_winsize(points_of: Callable[[int], DataFrame], start: int, step: int, largest: int, most: float = 0.5) -> tuple[int, DataFrame]:
    """The first window size from `start` on whose density is smooth, and that density; raises beyond `largest`."""
    for w in range(start, largest + 1, step):
        d = kde(points_of(w))
        worst = wiggle(d).agg(F.max("wiggle")).first()[0]
        if worst is not None and worst <= most:
            return w, d
    raise ValueError(f"no window size up to {largest} gives a smooth density")
