"""Filling missing values with a mixture of Gaussian and categorical fields, fitted by EM.

A record has numeric and categorical fields, any of which may be missing. Given its latent class the
fields are independent, so a missing field simply drops out of the record's likelihood and what is
known of the others gives its conditional expectation (numeric) or mode (categorical).

Every iteration is one pass over weighted records: each partition adds up its expected sufficient
statistics in NumPy and returns one vector, whose length depends on the model alone; the driver
receives only the sum. Equal records are counted first, so the pass runs over distinct records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rohspark.session import materialise

_LEAST_VAR = 1e-6
_PRIOR = 0.5  # pseudo-count of each categorical level, shared by the levels


@dataclass
class Mixture:
    """Parameters of `k` classes; `levels[c]` lists the values of categorical field c."""

    numeric: list[str]
    levels: dict[str, list]
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    probs: dict[str, np.ndarray]
    loglik: float = -math.inf
    iterations: int = 0
    history: list[float] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.weight)

    def codes(self, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        """Index of each value among its field's levels, -1 where missing or unknown."""
        return {c: pd.Index(lv).get_indexer(pdf[c]) if len(lv) else np.full(len(pdf), -1) for c, lv in self.levels.items()}

    def log_joint(self, x: np.ndarray, codes: dict[str, np.ndarray]) -> np.ndarray:
        """log p(class, observed fields) per record and class."""
        out = np.tile(np.log(self.weight), (len(x), 1))
        for j in range(x.shape[1]):
            v = x[:, [j]]
            term = -0.5 * (np.log(2 * np.pi * self.var[:, j]) + (v - self.mean[:, j]) ** 2 / self.var[:, j])
            out += np.where(np.isnan(v), 0.0, term)
        for c, idx in codes.items():
            if len(self.levels[c]):
                table = np.vstack([np.log(self.probs[c]).T, np.zeros(self.k)])  # the last row serves -1
                out += table[idx]
        return out

    def responsibilities(self, x: np.ndarray, codes: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        joint = self.log_joint(x, codes)
        top = joint.max(axis=1, keepdims=True)
        e = np.exp(joint - top)
        s = e.sum(axis=1, keepdims=True)
        return e / s, (top + np.log(s))[:, 0]

    def expectation(self, resp: np.ndarray, name: str) -> np.ndarray:
        """Conditional expectation of a numeric field."""
        return resp @ self.mean[:, self.numeric.index(name)]

    def distribution(self, resp: np.ndarray, name: str) -> np.ndarray:
        """Conditional probabilities of a categorical field's levels."""
        return resp @ self.probs[name]


def _numeric(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    x = np.empty((len(pdf), len(names)))
    for j, c in enumerate(names):
        x[:, j] = pd.to_numeric(pdf[c], errors="coerce").astype("float64")
    x[~np.isfinite(x)] = np.nan
    return x


def weigh(df: DataFrame, fields: list[str], weight: str | None = None) -> DataFrame:
    """Distinct records of `fields` with the sum of their weights as `_w`."""
    return df.groupBy(*fields).agg(F.sum(F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))


def _summed(df: DataFrame, step, width: int, parts: int | None = None, at_driver: int = 1000) -> np.ndarray:
    """Sum over all partitions of the vectors that `step` makes of pandas batches.

    Each of the `parts` partitions gives one vector of `width`. Those of up to `at_driver` partitions are added up at the
    driver, which spares a shuffle per iteration; more are added up by place first.
    """

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for pdf in batches:
            if len(pdf):
                total += step(pdf)
        yield pd.DataFrame({"v": [total]})

    vectors = df.mapInPandas(partials, "v array<double>")
    if (df.rdd.getNumPartitions() if parts is None else parts) <= at_driver:
        return np.sum([r["v"] for r in vectors.collect()] or [np.zeros(width)], axis=0)
    rows = vectors.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # `width` rows
    out = np.zeros(width)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def fit_mixture(records: DataFrame, numeric: list[str], levels: dict[str, list], k: int = 3, max_iter: int = 25, tol: float = 1e-5) -> Mixture:
    """Fits `k` classes to weighted records (column `_w`, see `weigh`).

    `levels` gives the values of each categorical field; anything else counts as missing. Null, NaN
    and infinite numbers are missing. Stops when the mean log-likelihood gains less than `tol`. An
    empty table gives equal classes with zero means.
    """
    d, sizes = len(numeric), {c: len(lv) for c, lv in levels.items()}
    parts = records.rdd.getNumPartitions()

    def moments(pdf: pd.DataFrame) -> np.ndarray:
        x, w = _numeric(pdf, numeric), pdf["_w"].to_numpy("float64")
        seen, x0 = ~np.isnan(x), np.nan_to_num(x)
        sums = [[w.sum()], w @ seen, w @ x0, w @ x0**2]
        for c, lv in levels.items():
            idx = pd.Index(lv).get_indexer(pdf[c]) if lv else np.full(len(pdf), -1)
            sums.append(np.bincount(idx[idx >= 0], w[idx >= 0], minlength=len(lv)) if lv else np.zeros(0))
        return np.concatenate(sums)

    total = _summed(records, moments, 1 + 3 * d + sum(sizes.values()), parts)
    n, seen, sx, sxx = total[0], total[1 : 1 + d], total[1 + d : 1 + 2 * d], total[1 + 2 * d : 1 + 3 * d]
    mean = np.divide(sx, seen, out=np.zeros(d), where=seen > 0)
    var = np.maximum(np.divide(sxx, seen, out=np.ones(d), where=seen > 0) - mean**2, _LEAST_VAR)
    # Classes start along the fields' common spread; each leans to other levels of the categorical fields.
    offsets = np.linspace(-1.2, 1.2, k) if k > 1 else np.zeros(1)
    probs, at = {}, 1 + 3 * d
    for c, size in sizes.items():
        share = (total[at : at + size] + _PRIOR) / (total[at : at + size].sum() + _PRIOR * max(size, 1))
        lean = np.array([[2.0 if level % k == cls else 1.0 for level in range(size)] for cls in range(k)]).reshape(k, size)
        table = share * lean
        probs[c] = table / table.sum(axis=1, keepdims=True) if size else np.zeros((k, 0))
        at += size
    model = Mixture(list(numeric), {c: list(lv) for c, lv in levels.items()}, np.full(k, 1 / k), mean + offsets[:, None] * np.sqrt(var), np.tile(var, (k, 1)), probs)
    if n == 0:
        return model

    def statistics(pdf: pd.DataFrame, model: Mixture) -> np.ndarray:
        x, codes, w = _numeric(pdf, numeric), model.codes(pdf), pdf["_w"].to_numpy("float64")
        resp, ll = model.responsibilities(x, codes)
        r = resp * w[:, None]
        seen, x0 = (~np.isnan(x)).astype(float), np.nan_to_num(x)
        sums = [[w @ ll], r.sum(axis=0), (r.T @ seen).ravel(), (r.T @ x0).ravel(), (r.T @ x0**2).ravel()]
        for c, size in sizes.items():
            idx = codes[c]
            sums.append(np.array([np.bincount(idx[idx >= 0], r[idx >= 0, j], minlength=size) for j in range(k)]).reshape(-1))
        return np.concatenate(sums)

    width = 1 + k + 3 * k * d + k * sum(sizes.values())
    for i in range(max_iter):
        s = _summed(records, lambda pdf, m=model: statistics(pdf, m), width, parts)
        ll, at = s[0] / n, 1
        nk, at = s[at : at + k], at + k
        seen_k, at = s[at : at + k * d].reshape(k, d), at + k * d
        sx, at = s[at : at + k * d].reshape(k, d), at + k * d
        sxx, at = s[at : at + k * d].reshape(k, d), at + k * d
        mean = np.where(seen_k > 1e-9, sx / np.maximum(seen_k, 1e-9), model.mean)
        var = np.maximum(np.where(seen_k > 1e-9, sxx / np.maximum(seen_k, 1e-9) - mean**2, model.var), _LEAST_VAR)
        probs = {}
        for c, size in sizes.items():
            t = s[at : at + k * size].reshape(k, size) + _PRIOR / max(size, 1)
            probs[c], at = t / t.sum(axis=1, keepdims=True) if size else t, at + k * size
        gain = ll - model.loglik
        weight = np.maximum(nk / n, 1e-12)
        model = Mixture(model.numeric, model.levels, weight / weight.sum(), mean, var, probs, ll, i + 1, [*model.history, ll])
        if gain < tol:
            break
    return model


def em_impute(df: DataFrame, numeric: list[str], categorical: dict[str, list], k: int = 3, max_iter: int = 25) -> DataFrame:
    """`df` with `<field>_filled` and `<field>_was_filled` for each numeric and categorical field.

    A record all of whose fields are missing has nothing to be filled from and stays missing. Other
    columns pass through, whatever they are called, but the names added must be free.
    """
    fields = [*numeric, *categorical]
    model = fit_mixture(materialise(weigh(df, fields), "em"), numeric, categorical, k, max_iter)
    added = [T.StructField(f"{c}_filled", T.DoubleType() if c in numeric else df.schema[c].dataType) for c in fields]
    added += [T.StructField(f"{c}_was_filled", T.BooleanType()) for c in fields]
    clash = {f.name for f in added} & set(df.columns)
    if clash:
        raise ValueError(f"columns to be added exist already: {sorted(clash)}")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, codes = _numeric(pdf, numeric), model.codes(pdf)
            resp, _ = model.responsibilities(x, codes)
            known = (~np.isnan(x)).any(axis=1)
            for idx in codes.values():
                known |= idx >= 0
            for j, c in enumerate(numeric):
                gap = np.isnan(x[:, j]) & known
                pdf[f"{c}_filled"] = np.where(gap, model.expectation(resp, c), x[:, j])
                pdf[f"{c}_was_filled"] = gap
            for c, idx in codes.items():
                gap = (idx < 0) & known & bool(model.levels[c])
                best = np.where(gap, model.distribution(resp, c).argmax(axis=1), idx) if model.levels[c] else idx
                pdf[f"{c}_filled"] = pd.Series([model.levels[c][b] if b >= 0 else None for b in best], index=pdf.index, dtype=object)
                pdf[f"{c}_was_filled"] = gap
            yield pdf[[f.name for f in out.fields]]

    out = T.StructType([*df.schema.fields, *[added[i] for i in range(len(fields))], *added[len(fields) :]])
    return df.mapInPandas(fill, out)


# Genotype calls and populations ---------------------------------------------------------------


def clean_pop(pop: Column) -> Column:
    """Blanks and tabs around a population code cut, in upper case."""
    return F.upper(F.trim(pop, F.lit(" \t")))


def current_calls(genotypes: DataFrame) -> DataFrame:
    """The version of each call with the latest `loaded_at` (null is earliest); g is null unless 0, 1 or 2.

    Versions with equal `loaded_at` are equal by the table's definition; should they differ, the largest g
    counts, a missing one last. Rows with a null in the key (ind_idx, chr, locus_idx) identify no call
    and are left out.
    """
    g = F.when(F.col("g").isin(0, 1, 2), F.col("g").cast("int"))
    known = genotypes.where(F.col("ind_idx").isNotNull() & F.col("chr").isNotNull() & F.col("locus_idx").isNotNull())
    # one number to order by and fixed-width values: the aggregation hashes, in place, instead of sorting
    version = F.shiftleft(F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-(1 << 60))), 2) + F.coalesce(g + 1, F.lit(0))
    rows = known.select("ind_idx", "chr", "locus_idx", "panel_id", "ppos", g.alias("g"), "first_copy", version.alias("_v"))
    latest = [F.max_by(c, "_v").alias(c) for c in ("panel_id", "ppos", "g", "first_copy")]
    return rows.groupBy("ind_idx", "chr", "locus_idx").agg(*latest)


def current_individuals(individuals: DataFrame, populations: DataFrame) -> DataFrame:
    """The latest registration of each individual (null is earliest), `pop` cleaned and null unless in `populations`."""
    latest = individuals.where(F.col("ind_idx").isNotNull()).groupBy("ind_idx").agg(F.max(F.struct("registered_at", "fam_id", "pop")).alias("v"))
    flat = latest.select("ind_idx", F.col("v.fam_id").alias("fam_id"), clean_pop(F.col("v.pop")).alias("raw_pop"))
    valid = populations.select(F.col("pop").alias("valid_pop")).where(F.col("valid_pop").isNotNull()).distinct()
    return flat.join(valid, flat.raw_pop == valid.valid_pop, "left").select("ind_idx", "fam_id", F.col("valid_pop").alias("pop"))


def _left_out(total: Column, own: Column) -> Column:
    """Mean without one's own value; null where nothing is left."""
    return F.when(own > 0, total / own)


def call_fills(calls: DataFrame, individuals: DataFrame, k: int = 4) -> DataFrame:
    """(panel_id, chr, locus_idx, pop, g_fill): the value that a missing call of that site and pop gets.

    The record of a call is its value (categorical), the mean value of the panel's other calls at the
    site and that of those of the same pop (Gaussian, missing where there are none). Calls of a site
    and pop are counted by value first, and the fit runs on those counts.
    """
    pop = individuals.select("ind_idx", "pop")
    tagged = calls.join(pop, "ind_idx", "left").select("panel_id", "chr", "locus_idx", "pop", "g")
    by_pop = tagged.groupBy("panel_id", "chr", "locus_idx", "pop").agg(
        *(F.count(F.when(F.col("g") == v, 1)).alias(f"n{v}") for v in (0, 1, 2)),
        F.count(F.when(F.col("g").isNull(), 1)).alias("gaps"),
    )
    site = Window.partitionBy("panel_id", "chr", "locus_idx")  # rows per site: one per pop
    by_pop = by_pop.withColumn("n", F.col("n0") + F.col("n1") + F.col("n2")).withColumn("s", F.col("n1") + 2 * F.col("n2"))
    by_pop = materialise(by_pop.withColumns({"site_n": F.sum("n").over(site), "site_s": F.sum("s").over(site)}), "sites")
    known_pop = F.col("pop").isNotNull()
    seen = by_pop.select("*", F.explode(F.array(*(F.struct(F.lit(v).alias("g"), F.col(f"n{v}").alias("w")) for v in (0, 1, 2)))).alias("e")).where("e.w > 0")
    records = seen.select(
        F.col("e.g").alias("g"),
        _left_out(F.col("site_s") - F.col("e.g"), F.col("site_n") - 1).alias("site_mean"),
        F.when(known_pop, _left_out(F.col("s") - F.col("e.g"), F.col("n") - 1)).alias("pop_mean"),
        F.col("e.w").alias("w"),
    )
    model = fit_mixture(materialise(weigh(records, ["g", "site_mean", "pop_mean"], "w"), "em"), ["site_mean", "pop_mean"], {"g": [0, 1, 2]}, k)
    gaps = by_pop.where((F.col("gaps") > 0) & (F.col("site_n") > 0)).select(
        "panel_id", "chr", "locus_idx", "pop", (F.col("site_s") / F.col("site_n")).alias("site_mean"), F.when(known_pop, _left_out(F.col("s"), F.col("n"))).alias("pop_mean")
    )

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _numeric(pdf, model.numeric)
            resp, _ = model.responsibilities(x, {})
            pdf["g_fill"] = model.distribution(resp, "g").argmax(axis=1).astype("int32")
            yield pdf[["panel_id", "chr", "locus_idx", "pop", "g_fill"]]

    return gaps.mapInPandas(fill, "panel_id int, chr string, locus_idx int, pop string, g_fill int")


def fill_calls(genotypes: DataFrame, individuals: DataFrame, populations: DataFrame, k: int = 4) -> DataFrame:
    """Current calls with `g_filled` and `g_was_filled`.

    A missing call is filled where another individual of the panel has a call at the site, else it
    stays null with `g_was_filled` false. `individuals` and `populations` are the raw tables.
    """
    calls = materialise(current_calls(genotypes).drop("first_copy"), "calls")  # read three times below
    inds = materialise(current_individuals(individuals, populations), "individuals")
    fills = call_fills(calls, inds, k)
    key = ["ind_idx", "panel_id", "chr", "locus_idx", "ppos"]
    there = calls.where(F.col("g").isNotNull()).select(*key, "g", F.col("g").alias("g_filled"), F.lit(False).alias("g_was_filled"))
    gaps = calls.where(F.col("g").isNull()).join(inds.select("ind_idx", F.col("pop").alias("ind_pop")), "ind_idx", "left").alias("c")
    f = fills.alias("f")
    same = F.col("c.panel_id").eqNullSafe(F.col("f.panel_id")) & (F.col("c.chr") == F.col("f.chr")) & (F.col("c.locus_idx") == F.col("f.locus_idx")) & F.col("c.ind_pop").eqNullSafe(F.col("f.pop"))
    filled = gaps.join(f, same, "left").select(*(F.col(f"c.{c}") for c in key), F.col("c.g"), F.col("f.g_fill").alias("g_filled"), F.col("f.g_fill").isNotNull().alias("g_was_filled"))
    return there.unionByName(filled)


def fill_pops(individuals: DataFrame, populations: DataFrame, k: int = 8) -> DataFrame:
    """Current individuals with `pop` (valid or null), `pop_filled` and `pop_was_filled`.

    The record of an individual is its pop, the commonest pop of its family's other members
    (categorical) and that pop's share (Gaussian). A missing pop gets the family's pop that is most
    probable under the fitted mixture; without a family member of known pop it stays null.
    """
    inds = current_individuals(individuals, populations)
    codes = sorted(r[0] for r in populations.where(F.col("pop").isNotNull()).select("pop").distinct().collect())  # the fixed list of codes
    family = inds.where(F.col("fam_id").isNotNull() & F.col("pop").isNotNull()).groupBy("fam_id", "pop").agg(F.count(F.lit(1)).alias("n"))
    # per family, its pops with their counts: never more entries than there are codes
    family = materialise(family.groupBy("fam_id").agg(F.sort_array(F.collect_list(F.struct("pop", "n"))).alias("pops")), "families")

    def top(pops: Column) -> Column:
        """The (n, pop) of the commonest; of equals, the first in order of code."""
        return F.aggregate(pops, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("pop")), lambda a, e: F.when(e["n"] > a["n"], F.struct(e["n"].alias("n"), e["pop"].alias("pop"))).otherwise(a))

    def size(pops: Column) -> Column:
        return F.aggregate(pops, F.lit(0).cast("bigint"), lambda a, e: a + e["n"])

    own = family.select("pops", F.explode("pops").alias("own"))
    others = F.transform("pops", lambda e: F.struct(e["pop"].alias("pop"), (e["n"] - (e["pop"] == F.col("own.pop")).cast("int")).alias("n")))
    records = own.select(F.col("own.pop").alias("pop"), F.col("own.n").alias("w"), others.alias("others")).select("pop", "w", top(F.col("others")).alias("t"), size(F.col("others")).alias("rest"))
    records = records.select("pop", F.col("t.pop").alias("fam_pop"), F.when(F.col("rest") > 0, F.col("t.n") / F.col("rest")).alias("fam_share"), "w")
    model = fit_mixture(materialise(weigh(records, ["pop", "fam_pop", "fam_share"], "w"), "em"), ["fam_share"], {"pop": codes, "fam_pop": codes}, min(k, max(1, len(codes))))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _numeric(pdf, ["fam_share"])
            resp, _ = model.responsibilities(x, {"fam_pop": pd.Index(codes).get_indexer(pdf["fam_pop"])})
            p = model.distribution(resp, "pop")
            at = {c: i for i, c in enumerate(codes)}
            # the family's own counts weigh the model's probabilities; equal ones go to the first code
            pdf["pop_fill"] = [max(((p[i, at[e["pop"]]] * e["n"], -at[e["pop"]]), e["pop"]) for e in pops)[1] for i, pops in enumerate(pdf["pops"])]
            yield pdf[["fam_id", "pop_fill"]]

    asked = family.withColumn("t", top(F.col("pops"))).select("fam_id", "pops", F.col("t.pop").alias("fam_pop"), (F.col("t.n") / size(F.col("pops"))).alias("fam_share"))
    fills = asked.mapInPandas(fill, "fam_id string, pop_fill string")
    gap = F.col("pop").isNull() & F.col("pop_fill").isNotNull()
    return inds.join(fills, "fam_id", "left").select("ind_idx", "fam_id", "pop", F.when(gap, F.col("pop_fill")).otherwise(F.col("pop")).alias("pop_filled"), gap.alias("pop_was_filled"))


def filled_cases(genotypes: DataFrame, individuals: DataFrame, populations: DataFrame) -> DataFrame:
    """(field_name, ind_idx, chr, locus_idx) of every value that was filled."""
    g = fill_calls(genotypes, individuals, populations).where("g_was_filled").select(F.lit("g").alias("field_name"), "ind_idx", "chr", "locus_idx")
    pop = fill_pops(individuals, populations).where("pop_was_filled").select(F.lit("pop").alias("field_name"), "ind_idx", F.lit("").alias("chr"), F.lit(-1).alias("locus_idx"))
    return g.unionByName(pop)
