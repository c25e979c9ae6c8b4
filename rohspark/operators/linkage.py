"""Linkage disequilibrium of neighbouring sites, and scores weighted by it.

Calls are dealt to tiles of at most `TILE_SITES` sites (and the w - 1 behind them) and `TILE_PEOPLE` individuals. A
tile is a small matrix, in which all pairs of sites less than `w` apart are counted by shifting it against itself. So each call
is moved once; what leaves a tile is one row of counts per pair, and tiles of one pair are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rohspark.functions import exprs
from rohspark.operators.roh import _w

TILE_SITES, TILE_PEOPLE = 1024, 1024


def _pair_counts(calls: DataFrame, w: int, phased: bool) -> DataFrame:
    """(panel_id, chr, i, j, both, joint): per pair the individuals with both calls, and what they share.

    Shared are two homozygotes (unphased, 1) or copies that carry the coded allele at both sites (phased, up to 2).
    """
    if w > TILE_SITES:
        raise ValueError(f"pairs are at most {TILE_SITES} sites apart")
    tile = F.floor(F.col("idx") / TILE_SITES).cast("int")
    before = F.floor((F.col("idx") - (w - 1)) / TILE_SITES).cast("int")  # the tile whose last sites look ahead to this one
    tiles = F.when((before < tile) & (before >= 0), F.array(tile, before)).otherwise(F.array(tile))
    code = (F.when(F.col("g").isin(0, 1, 2), F.col("g")).otherwise(F.lit(-1))).cast("tinyint")
    dealt = calls.select("panel_id", "chr", F.floor(F.col("ind_idx") / TILE_PEOPLE).cast("int").alias("block"), F.explode(tiles).alias("tile"), "idx", "ind_idx", code.alias("g"), F.coalesce(F.col("first_copy").cast("tinyint"), F.lit(-1).cast("tinyint")).alias("first"))

    key = ["panel_id", "chr", "block", "tile"]

    def count(tab: pa.Table) -> pa.RecordBatch:
        idx, ind = (tab.column(c).to_numpy().astype(np.int64) for c in ("idx", "ind_idx"))
        start = tab.column("tile")[0].as_py() * TILE_SITES
        row = np.unique(ind, return_inverse=True)[1]
        width = int(idx.max()) - start + 1
        g, first = (np.full((int(row.max()) + 1, width), -1, dtype=np.int8) for _ in range(2))
        g[row, idx - start] = tab.column("g").to_numpy()
        first[row, idx - start] = tab.column("first").to_numpy()
        here = np.zeros(width, dtype=bool)
        here[idx - start] = True
        known = g >= 0
        found: list[tuple[np.ndarray, ...]] = []
        for d in range(1, min(w, width)):
            n = min(width - d, TILE_SITES)  # pairs belong to the tile of their first site
            a, b = g[:, :n], g[:, d : d + n]
            both = known[:, :n] & known[:, d : d + n]
            if phased:
                same = np.where((a == 2) & (b == 2), 2, 0) + ((a == 1) & (b == 2)) + ((a == 2) & (b == 1))
                same += (a == 1) & (b == 1) & (first[:, :n] == first[:, d : d + n]) & (first[:, :n] >= 0)
            else:
                same = ((a != 1) & (b != 1)).astype(np.int64)
            pair = np.flatnonzero(here[:n] & here[d : d + n])
            found.append((start + pair, start + pair + d, both.sum(axis=0)[pair], np.where(both, same, 0).sum(axis=0)[pair]))
        i, j, both, joint = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(4))
        heads = [pa.repeat(tab.column(c)[0], len(i)) for c in ("panel_id", "chr")]
        return pa.RecordBatch.from_arrays([*heads, pa.array(i, type=pa.int32()), pa.array(j, type=pa.int32()), pa.array(both, type=pa.int64()), pa.array(joint, type=pa.int64())], names=["panel_id", "chr", "i", "j", "both", "joint"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tile after tile of the sorted rows; one tile is held at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in key]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1
            if held and any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in key):
                yield count(pa.Table.from_batches(held))
                held = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a:
                    yield count(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield count(pa.Table.from_batches(held))

    panel_type = calls.schema["panel_id"].dataType.simpleString()
    counts = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(walk, f"panel_id {panel_type}, chr string, i int, j int, both bigint, joint bigint")
    return counts.groupBy("panel_id", "chr", "i", "j").agg(F.sum("both").alias("both"), F.sum("joint").alias("joint"))


def pair_ld(calls: DataFrame, sites: DataFrame, w: int, phased: bool = False) -> DataFrame:
    """(panel_id, chr, i, j, ld) for sites i < j of less than `w` apart.

    `calls` has idx, g and first_copy of every individual to count, one row per individual and site; `sites` has idx, freq and hom_freq
    from all individuals. Unphased: the squared correlation of being homozygous; null where no
    individual has both calls. Phased: the squared correlation of the coded allele. At most 1, and 0
    where a frequency is 0 or 1.
    """
    counts = _pair_counts(calls.select("panel_id", "chr", "ind_idx", "idx", "g", "first_copy"), w, phased)
    counts = counts.select("panel_id", "chr", "i", "j", (F.col("joint") / F.nullif((2 if phased else 1) * F.col("both"), F.lit(0).cast("bigint"))).alias("x"))
    s = sites.select("panel_id", "chr", F.col("idx"), F.col("freq" if phased else "hom_freq").alias("f"))
    joined = counts.join(s.select("panel_id", "chr", F.col("idx").alias("i"), F.col("f").alias("fi")), ["panel_id", "chr", "i"]).join(s.select("panel_id", "chr", F.col("idx").alias("j"), F.col("f").alias("fj")), ["panel_id", "chr", "j"])
    fi, fj = F.col("fi"), F.col("fj")
    r = F.pow(F.col("x") - fi * fj, F.lit(2.0)) / F.nullif(fi * (1 - fi) * fj * (1 - fj), F.lit(0.0))
    inside = (fi > 0) & (fi < 1) & (fj > 0) & (fj < 1)
    ld = F.when(inside, F.when(F.col("x").isNull(), F.lit(None)).otherwise(F.least(r, F.lit(1.0)))).otherwise(F.lit(0.0))
    return joined.select("panel_id", "chr", "i", "j", ld.alias("ld"))


def ld_weights(pairs: DataFrame, sites: DataFrame, w: int) -> DataFrame:
    """(panel_id, chr, win_start, idx, ld_sum): 1 and the site's LD with the others of each window that holds it.

    Null where one of these is unknown. Only whole windows have rows.
    """
    one = pairs.select("panel_id", "chr", F.col("i").alias("s"), F.col("j").alias("o"), "ld")
    both = one.unionByName(pairs.select("panel_id", "chr", F.col("j").alias("s"), F.col("i").alias("o"), "ld"))
    around = both.groupBy("panel_id", "chr", "s").agg(F.collect_list(F.struct("o", "ld")).alias("near"))  # fewer than 2 w
    size = sites.groupBy("panel_id", "chr").agg(F.count(F.lit(1)).alias("n"))
    each = sites.select("panel_id", "chr", F.col("idx").alias("s")).join(around, ["panel_id", "chr", "s"], "left").join(size, ["panel_id", "chr"])
    first, last = F.greatest(F.lit(0), F.col("s") - (w - 1)), F.least(F.col("s"), F.col("n") - w).cast("int")
    opened = each.where(first <= last).withColumn("win_start", F.explode(F.sequence(first, last)))
    inside = F.filter(F.coalesce("near", F.array().cast("array<struct<o:int,ld:double>>")), lambda e: (e["o"] >= F.col("win_start")) & (e["o"] < F.col("win_start") + w))
    total = F.aggregate(F.sort_array(inside), F.lit(1.0), lambda a, e: a + e["ld"])
    return opened.select("panel_id", "chr", "win_start", F.col("s").alias("idx"), total.alias("ld_sum"))


def site_weights(numbered: DataFrame, m: int = 7, mu: float = 1e-9) -> DataFrame:
    """`weight`: no mutation and no recombination over the step from the previous site, or from 0 for the first."""
    w = Window.partitionBy("panel_id", "chr").orderBy("idx")
    d = F.col("ppos") - F.coalesce(F.lag("ppos").over(w), F.lit(0))
    g = F.col("gpos") - F.coalesce(F.lag("gpos").over(w), F.lit(0.0))
    return numbered.withColumn("weight", exprs.nomut(m, mu, d) * exprs.norec(m, g))


def weighted_window_scores(scored: DataFrame, weights: DataFrame, w: int) -> DataFrame:
    """`scored` (with `weight`) and `score`: over each whole window the sum of lod * weight / ld_sum.

    Null under the breaks that `window_scores` knows, and where an LD is unknown. The weights of a
    window are gathered to one short array per window start, which meets the individuals' rows in one join;
    the window's own site scores are an array from the sorted rows, so site-by-window pairs aren't shuffled.
    """
    lists = weights.groupBy("panel_id", "chr", F.col("win_start").alias("idx")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "ld_sum"))), lambda e: e["ld_sum"]).alias("ld_sums"))
    joined = scored.join(lists, ["panel_id", "chr", "idx"], "left")
    here = _w().rowsBetween(0, w - 1)
    parts = F.collect_list(F.col("lod") * F.col("weight")).over(here)
    whole = (F.count(F.lit(1)).over(here) == w) & (F.sum("brk").over(_w().rowsBetween(1, w - 1)) == 0)
    summed = F.aggregate(F.zip_with(parts, "ld_sums", lambda a, b: a / b), F.lit(0.0), lambda a, x: a + x)
    return joined.withColumn("score", F.when(whole & (F.size("ld_sums") == w), summed)).drop("ld_sums")
