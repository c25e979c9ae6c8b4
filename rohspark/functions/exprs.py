"""Scalar expressions of the ROH model, as columns that stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def lod(g, p, err) -> Column:
    """log10 odds of autozygosity for `g` coded alleles of frequency `p` and genotyping error `err`.

    0 where the genotype is missing or the site is monomorphic.
    """
    g, p, e = _col(g), _col(p), _col(err)
    q = 1 - p

    def hom(f: Column) -> Column:
        return F.log10(((1 - e) * f + e * f * f) / (f * f))

    score = F.when(g == 0, hom(q)).when(g == 1, F.log10(e)).when(g == 2, hom(p)).otherwise(F.lit(0.0))
    return F.when((p > 0) & (p < 1), score).otherwise(F.lit(0.0))


def gl_to_error(value, gl_type: str) -> Column:
    """Genotyping error from a quality (GQ) or a likelihood (GL, PL), kept within [1e-16, 1]."""
    v = _col(value)
    ten = F.lit(10.0)
    if gl_type == "GQ":
        e = F.pow(ten, F.greatest(v / -10.0, F.lit(-10.0)))
    elif gl_type == "GL":
        e = 1 - F.pow(ten, F.greatest(v, F.lit(-10.0)))
    elif gl_type == "PL":
        e = 1 - F.pow(ten, F.greatest(v / -10.0, F.lit(-10.0)))
    else:
        raise ValueError(f"unknown likelihood type {gl_type!r}; one of GQ, GL, PL")
    return F.when(e <= 0, F.lit(1e-16)).when(e > 1, F.lit(1.0)).otherwise(e)


def nomut(m: int, mu: float, d) -> Column:
    """Probability of no mutation over `d` base pairs since `m` generations."""
    return F.exp(F.lit(-2.0 * m * mu) * _col(d))


def norec(m: int, d) -> Column:
    """Probability of no recombination over the genetic distance `d`, in the map's own unit."""
    return F.exp(F.lit(-2.0 * m) * _col(d))


def in_gap(a, b, start, stop) -> Column:
    """Whether the step from `a` to `b` touches or spans [start, stop]."""
    a, b, s, t = map(_col, (a, b, start, stop))
    return ((a >= s) & (a <= t)) | ((b >= s) & (b <= t)) | ((s >= a) & (t <= b))


def interpolate(x0, y0, x1, y1, x) -> Column:
    """Linear interpolation at `x`; y0 where both ends coincide."""
    x0, y0, x1, y1, x = map(_col, (x0, y0, x1, y1, x))
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / F.nullif((x1 - x0).cast("double"), F.lit(0.0)))


def chr_name(name) -> Column:
    """With the prefix `chr`, unless it begins with a lower-case c."""
    n = _col(name)
    return F.when(F.substring(n, 1, 1) == "c", n).otherwise(F.concat(F.lit("chr"), n))


def size_class(length, bounds: list[float]) -> Column:
    """A below the first bound, B below the second and so on."""
    at = _col(length)
    steps = sum(((at >= b).cast("int") for b in bounds), F.lit(0))
    return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), steps + 1, F.lit(1))


def normal_log(x, mean: float, var: float) -> Column:
    """Logarithm of the normal density."""
    return F.lit(-0.5 * math.log(2 * math.pi * var)) - F.pow(_col(x) - mean, F.lit(2.0)) / (2 * var)


def overlap_threshold(overlap_frac: float, w: int) -> float:
    """Windows that must cover a site: a fraction of `w`, between 1 and `w`, not rounded."""
    return min(max(overlap_frac * w, 1.0), float(w))


# The two lines through log density by which window size and overlap are chosen.
_WINSIZE_LINE = (8.3235, 138.0521)
_OVERLAP_LINE = (6.375, 63.888)


def winsize_column(density) -> Column:
    """Window size of the weighted score for a density of variants, at least 10."""
    a, b = _WINSIZE_LINE
    return F.greatest(F.lit(10), (a * F.ln(_col(density)) + b + 0.5).cast("int"))


def overlap_frac_column(density, w: int) -> Column:
    """Overlap fraction for a density of variants."""
    a, b = _OVERLAP_LINE
    f = (a * F.ln(_col(density)) + b) / 100
    return F.when(f > 1, F.lit(1.0)).when(f <= 0, F.lit(1.0 / w)).otherwise(f)


def winsize_for_density(density: float) -> int:
    """`winsize_column` of a number."""
    a, b = _WINSIZE_LINE
    return max(10, int(a * math.log(density) + b + 0.5))


def overlap_frac_for_density(density: float, w: int) -> float:
    """`overlap_frac_column` of a number."""
    a, b = _OVERLAP_LINE
    f = (a * math.log(density) + b) / 100
    return 1.0 if f > 1 else 1.0 / w if f <= 0 else f
