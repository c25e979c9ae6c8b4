"""Percentiles per group from merging centroid digests, with the rank error counted.

A digest is a list of centroids (mean, weight) in order of value, and its depth: how many clusterings its
values have gone through at most. Sorted values are clustered under the size function
k(q) = delta / 2pi * asin(2q - 1): no cluster spans more than one unit of k, a cell, so it is small near either end and at most
pi / delta of the weight in the middle. Merging is clustering again, of all digests laid together. What a
cluster spans never grows by that: among more rows it covers a share so much smaller that it still fits one cell.

A clustering therefore moves the rank of a value by one cell at most, which bounds the error by the depth (`rank_bound`).

Every input partition makes digests of its own rows, so a group that holds most rows shuffles a few
hundred centroids per partition, not its rows. A second pass counts, for each reported percentile,
the rows below it and not above it, which gives the true error in rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rohspark.session import materialise

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
DELTA = 1500.0
_BROADCAST = 50_000  # groups whose estimates are broadcast at a time, about
_FLUSH = 400_000  # values or centroids held by a task at a time


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, mean, weight) of the clusters; groups are small integers, results are sorted by group and mean."""
    if not len(group):
        return group, mean, weight
    by = np.lexsort((mean, group))
    group, mean, weight = group[by], mean[by], weight[by]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, len(group)))
    upto = np.cumsum(weight)
    before = np.repeat(upto[starts] - weight[starts], sizes)
    total = np.repeat(np.add.reduceat(weight, starts), sizes)
    right = np.clip((upto - before) / total, 0.0, 1.0)
    left = np.clip((upto - before - weight) / total, 0.0, 1.0)
    cell, last = (np.floor(delta / (2 * math.pi) * (np.arcsin(2 * q - 1) + math.pi / 2)) for q in (left, np.nextafter(right, 0)))
    alone = last > cell  # reaches over a cell's end, so it stays a cluster by itself
    edges = np.flatnonzero(head | np.concatenate([[True], (cell[1:] != cell[:-1]) | alone[1:] | alone[:-1]]))
    w = np.add.reduceat(weight, edges)
    lowest, highest = mean[edges], np.maximum.reduceat(mean, edges)
    centre = np.clip(np.add.reduceat(mean * weight, edges) / w, lowest, highest)  # equal values stay exact
    return group[edges], centre, w


def rank_bound(q: float, delta: float = DELTA, depth: int = 3) -> float:
    """Bound of the error in rank at `q`, as a share of the rows, for a digest of this depth.

    Each clustering moves a rank by at most one cell and the interpolation by one more. The cells met lie within
    depth + 1 units of k around q; the widest of these counts.
    """
    theta = max(abs(math.asin(2 * q - 1)) - 2 * math.pi * (depth + 1) / delta, 0.0)
    return (depth + 1) * math.pi / delta * math.cos(theta)


def _quantiles(mean: np.ndarray, weight: np.ndarray, low: float, high: float, qs: tuple[float, ...]) -> list[float]:
    """Values at `qs`, between the middles of neighbouring centroids; centroids of weight one are exact."""
    at = np.cumsum(weight) - weight / 2
    n = weight.sum()
    x = np.interp(np.array(qs) * n, np.concatenate([[0.0], at, [n]]), np.concatenate([[low], mean, [high]]))
    return [float(v) for v in x]


_DIGEST = "n bigint, low double, high double, means array<double>, weights array<double>, depth int"
_COLUMNS = ["n", "low", "high", "means", "weights", "depth"]


class _Buffer:
    """Centroids of many groups; a group's key is a tuple of the key columns' values."""

    def __init__(self, keys: list[str], delta: float):
        self.keys, self.delta = keys, delta
        self.clear()

    def clear(self) -> None:
        self.index: dict[tuple, int] = {}
        self.ends: list[list[float]] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.clustered: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # clustered once here, and left alone until the end
        self.held = self.kept = self.depth = self.deeper = 0

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        """The group number of each row."""
        columns = [batch.column(c).dictionary_encode() for c in self.keys]
        code = np.zeros(batch.num_rows, dtype=np.int64)
        for c in columns:
            code = code * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
        unique, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        values = list(zip(*(batch.column(c).take(pa.array(first)).to_pylist() for c in self.keys)))
        return np.array([self.index.setdefault(v, len(self.index)) for v in values], dtype=np.int64)[inverse]

    def add(self, group: np.ndarray, mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray) -> None:
        """owner: the group of each entry of low and high."""
        while len(self.ends) < len(self.index):
            self.ends.append([math.inf, -math.inf])
        by = np.argsort(owner, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], owner[by][1:] != owner[by][:-1]])) if len(owner) else []
        if len(owner):
            for g, a, b in zip(owner[by][at], np.minimum.reduceat(low[by], at), np.maximum.reduceat(high[by], at)):
                e = self.ends[g]
                e[0], e[1] = min(e[0], float(a)), max(e[1], float(b))
        self.parts.append((group, mean, weight))
        self.held += len(mean)

    def compress(self) -> None:
        """Clusters what came in since the last time; what that gives isn't clustered again before the end."""
        if self.held:
            got = cluster(*(np.concatenate(x) for x in zip(*self.parts)), self.delta)
            self.clustered.append(got)
            self.kept += len(got[0])
            self.parts, self.held = [], 0
            if self.kept > _FLUSH and len(self.clustered) > 1:
                self._all()

    def _all(self) -> None:
        self.clustered = [cluster(*(np.concatenate(x) for x in zip(*self.clustered)), self.delta)]
        self.kept, self.deeper = len(self.clustered[0][0]), self.deeper + 1

    def flush(self, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        if not self.index:
            return
        self.compress()
        if len(self.clustered) > 1:
            self._all()
        group, mean, weight = self.clustered[0]
        starts = np.searchsorted(group, np.arange(len(self.index) + 1)).astype(np.int32)
        n = np.add.reduceat(weight, starts[:-1])
        columns = [pa.array([k[i] for k in self.index], type=t) for i, t in enumerate(types)]
        columns += [pa.array(np.rint(n).astype(np.int64)), pa.array([e[0] for e in self.ends]), pa.array([e[1] for e in self.ends])]
        columns += [pa.ListArray.from_arrays(pa.array(starts), pa.array(x)) for x in (mean, weight)]
        columns.append(pa.array(np.full(len(self.index), self.depth + 1 + self.deeper, dtype=np.int32)))
        yield pa.RecordBatch.from_arrays(columns, names=[*self.keys, *_COLUMNS])
        self.clear()


def _typed(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)


def local_digests(values: DataFrame, keys: list[str], value: str, delta: float = DELTA) -> DataFrame:
    """Digests of each group's rows, one or more per partition; nothing is shuffled. Takes finite numbers."""
    rows = values.select(*keys, F.col(value).cast("double").alias("_v"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, types = _Buffer(keys, delta), None
        for batch in batches:
            types = types or [batch.schema.field(c).type for c in keys]
            v = batch.column("_v").to_numpy(zero_copy_only=False)
            group = buffer.codes(batch)
            buffer.add(group, v, np.ones(len(v)), v, v, group)
            if buffer.held > _FLUSH:
                yield from buffer.flush(types)  # a digest of its own: rows are clustered once
        yield from buffer.flush(types)

    return rows.mapInArrow(make, f"{_typed(rows, keys)}, {_DIGEST}")


def merge_digests(digests: DataFrame, keys: list[str], delta: float = DELTA) -> DataFrame:
    """One digest per group of `keys` from any number of digests, as of other partitions, days or runs.

    Digests are shuffled by their keys and merged as they stream in, so a task holds a bounded number
    of centroids, whatever the number of a group's digests.
    """
    placed = digests.select(*keys, *_COLUMNS).repartition(*keys).sortWithinPartitions(*keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, types, last = _Buffer(keys, delta), None, None
        for whole in batches:
            if not whole.num_rows:
                continue
            types = types or [whole.schema.field(c).type for c in keys]
            step = 2000
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                if buffer.held > _FLUSH:
                    buffer.compress()
                if buffer.held + buffer.kept > _FLUSH // 2 and last != _first(batch, keys):
                    yield from buffer.flush(types)
                owner = buffer.codes(batch)
                sizes = np.diff(batch.column("means").offsets.to_numpy())
                mean, weight = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("means", "weights"))
                low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
                buffer.add(np.repeat(owner, sizes), mean, weight, low, high, owner)
                buffer.depth = max(buffer.depth, pc.max(batch.column("depth")).as_py())
                last = _first(batch.slice(batch.num_rows - 1), keys)
        yield from buffer.flush(types)

    return placed.mapInArrow(merge, f"{_typed(placed, keys)}, {_DIGEST}")


def _first(batch: pa.RecordBatch, keys: list[str]) -> tuple:
    return tuple(batch.column(c)[0].as_py() for c in keys)


def digest_quantiles(digests: DataFrame, keys: list[str], qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(keys, n, depth, xs): the values at `qs` of each digest."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, weights = batch.column("means").to_numpy(zero_copy_only=False), batch.column("weights").to_numpy(zero_copy_only=False)
            low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
            xs = [_quantiles(m, w, a, b, qs) for m, w, a, b in zip(means, weights, low, high)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), batch.column("n"), batch.column("depth"), pa.array(xs, type=pa.list_(pa.float64()))], names=[*keys, "n", "depth", "xs"])

    return digests.mapInArrow(look, f"{_typed(digests, keys)}, n bigint, depth int, xs array<double>")


def _match(a: list[str]) -> Column:
    on = F.lit(True)
    for c in a:
        on = on & F.col(f"v.{c}").eqNullSafe(F.col(f"e.{c}"))
    return on


def _counted(values: DataFrame, estimates: DataFrame, keys: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """Per group, for each of `qs` the rows below and not above the estimate; counted per partition first."""
    blocks = -(-estimates.count() // _BROADCAST) or 1  # more groups than fit one broadcast are counted block by block, so values aren't shuffled
    found = None
    for i in range(blocks):
        some = estimates if blocks == 1 else estimates.where(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == i)
        part = _counted_block(values, some, keys, value, qs)
        found = part if found is None else found.unionByName(part)
    return found


def _counted_block(values: DataFrame, estimates: DataFrame, keys: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    joined = values.alias("v").join(F.broadcast(estimates).alias("e"), _match(keys))
    v = F.col(f"v.{value}")
    sums = [F.sum(F.when(v < F.col("e.xs")[i], 1).otherwise(0)).alias(f"lt{i}") for i in range(len(qs))]
    sums += [F.sum(F.when(v <= F.col("e.xs")[i], 1).otherwise(0)).alias(f"le{i}") for i in range(len(qs))]
    return joined.groupBy(*(F.col(f"v.{c}").alias(c) for c in keys)).agg(*sums)


def certified_quantiles(values: DataFrame, digests: DataFrame, keys: list[str], value: str, qs: tuple[float, ...] = QUANTILES, delta: float = DELTA) -> DataFrame:
    """(keys, n, q, estimate, rank_error, bound, certified) per group and percentile.

    `rank_error` is counted: the distance, as a share of n, of q * n from the range of ranks that the
    estimate takes among the group's rows. `bound` is what the digest promises by its depth, one row's share included,
    and `certified` tells that the count keeps it.
    """
    estimates = materialise(digest_quantiles(digests, keys, qs), "estimates")
    counts = _counted(values, estimates, keys, value, qs).alias("v")

    def promise(q: float) -> Column:
        turn = F.lit(2 * math.pi / delta) * (F.col("e.depth") + 1)
        return turn / 2 * F.cos(F.greatest(F.lit(abs(math.asin(2 * q - 1))) - turn, F.lit(0.0)))

    each = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), promise(q).alias("b"), F.col("e.xs")[i].alias("x"), F.col(f"v.lt{i}").alias("lt"), F.col(f"v.le{i}").alias("le")) for i, q in enumerate(qs))))
    rows = counts.join(estimates.alias("e"), _match(keys)).select(*(F.col(f"e.{c}").alias(c) for c in keys), F.col("e.n").alias("n"), each.alias("r"))
    want = F.col("r.q") * F.col("n")
    error = F.greatest(F.lit(0.0), F.col("r.lt") - want, want - F.col("r.le")) / F.col("n")
    bound = F.col("r.b") + 1 / F.col("n")
    return rows.select(*keys, "n", F.col("r.q").alias("q"), F.col("r.x").alias("estimate"), error.alias("rank_error"), bound.alias("bound"), (error <= bound).alias("certified"))


def latest_lengths(roh: DataFrame) -> DataFrame:
    """(pop, called_on, roh_length): finite positive lengths, one row per `roh_id`, `pop` cut and in upper case.

    Of several rows of one id the latest by `loaded_at` counts (null is earliest; of equals the largest
    length). Rows with a null id are left out. A null or empty pop is a group like any other.
    """
    length = F.col("roh_length")
    fine = length.isNotNull() & ~F.isnan(length) & (length > 0) & (length < float("inf"))
    latest = roh.where(F.col("roh_id").isNotNull()).groupBy("roh_id").agg(F.max(F.struct("loaded_at", "roh_length", "pop", "called_on")).alias("v")).select("v.pop", "v.called_on", "v.roh_length")
    return latest.where(fine).select(F.upper(F.trim("pop", F.lit(" \t"))).alias("pop"), "called_on", "roh_length")


def length_percentiles(roh: DataFrame, qs: tuple[float, ...] = QUANTILES, delta: float = DELTA) -> DataFrame:
    """Certified percentiles of `roh_length` per pop and day, and per pop from the merged digests of its days.

    Columns: level (`pop` or `pop_day`), pop, called_on (null at level `pop`), n, q, estimate,
    rank_error, bound, certified. See `latest_lengths` for the rows that count; an empty table gives none.
    """
    values = materialise(latest_lengths(roh), "lengths")
    daily = materialise(merge_digests(local_digests(values, ["pop", "called_on"], "roh_length", delta), ["pop", "called_on"], delta), "daily")
    total = materialise(merge_digests(daily, ["pop"], delta), "total")
    by_day = certified_quantiles(values, daily, ["pop", "called_on"], "roh_length", qs, delta).select(F.lit("pop_day").alias("level"), "*")
    by_pop = certified_quantiles(values, total, ["pop"], "roh_length", qs, delta).select(F.lit("pop").alias("level"), "*")
    return by_day.unionByName(by_pop.withColumn("called_on", F.lit(None).cast(roh.schema["called_on"].dataType)))
