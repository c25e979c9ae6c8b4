"""Per-key statistics without the imbalance that a few heavy keys cause.

Rows are range-partitioned on a composite key (chr, panel, site, individual, load time, input
partition). Spark samples the key to choose the bounds, so every partition gets about as many rows,
however many of them one chr holds: a heavy chr spans several partitions, light ones share one. The last part of
the key spreads even exact copies of one row. Each partition is sorted and folded into one partial
state per chr; neighbouring states are then stitched, since a call or site can lie on both sides of
a bound. Only the states, one per (chr, partition) that meets, are shuffled by chr.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of g that are calls; anything else is missing.
CALLS = (0, 1, 2)

_STATE = (
    "part int, chr string, n_rows bigint, calls bigint, missing bigint, n0 bigint, n1 bigint, n2 bigint, sites bigint,"
    " first_site array<bigint>, last_site array<bigint>, first_call array<bigint>, last_call array<bigint>, last_g int"
)


def partition_count(df: DataFrame, rows_per_partition: int = 1_000_000) -> int:
    """Range partitions for `df`: at least the session's shuffle partitions, more as rows grow."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // rows_per_partition))


class _Fold:
    """The state of one chr within one partition, fed with sorted pieces."""

    def __init__(self, part: int, chrom: str | None):
        self.part, self.chrom = part, chrom
        self.n = np.zeros(6, dtype=np.int64)  # rows, calls, missing, n0, n1, n2
        self.sites = 0
        self.first_call: tuple | None = None
        self.last_call: tuple | None = None
        self.last_g = -1

    def feed(self, keys: np.ndarray, g: np.ndarray) -> None:
        """keys: rows of (panel, locus, ind), sorted, versions of a call in order of load time."""
        self.n[0] += len(g)
        same_call = (keys[1:] == keys[:-1]).all(axis=1)
        same_site = (keys[1:, :2] == keys[:-1, :2]).all(axis=1)
        head = tuple(int(x) for x in keys[0])
        if self.last_call is None:
            self.first_call = head
            self.sites += 1
        else:
            if head != self.last_call:
                self._count(np.array([self.last_g]))
            if head[:2] != self.last_call[:2]:
                self.sites += 1
        self.sites += int((~same_site).sum())
        self._count(g[:-1][~same_call])  # the last version of each call but the piece's last
        self.last_call, self.last_g = tuple(int(x) for x in keys[-1]), int(g[-1])

    def _count(self, g: np.ndarray) -> None:
        by = [int((g == v).sum()) for v in CALLS]
        self.n[1] += sum(by)
        self.n[2] += len(g) - sum(by)
        self.n[3:] += by

    def state(self) -> dict:
        self._count(np.array([self.last_g]))
        n = [int(x) for x in self.n]
        return {
            "part": self.part, "chr": self.chrom, "n_rows": n[0], "calls": n[1], "missing": n[2], "n0": n[3], "n1": n[4], "n2": n[5], "sites": self.sites,
            "first_site": list(self.first_call[:2]), "last_site": list(self.last_call[:2]), "first_call": list(self.first_call), "last_call": list(self.last_call), "last_g": self.last_g,
        }


_NULL_KEY = np.iinfo(np.int64).min  # stands for null in a key; nulls sort first, as this does


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out: list[dict] = []
    now: _Fold | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("chr").dictionary_encode()
        names, index = codes.dictionary.to_pylist(), codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        keys = np.stack([batch.column(c).cast(pa.int64()).fill_null(_NULL_KEY).to_numpy(zero_copy_only=False) for c in ("panel_id", "locus_idx", "ind_idx")], axis=1)
        g = batch.column("g").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(index[1:] != index[:-1]) + 1), len(g)]
        for a, b in zip(cuts, cuts[1:]):
            chrom = names[index[a]] if index[a] >= 0 else None
            if now is None or now.chrom != chrom:
                if now is not None:
                    out.append(now.state())
                now = _Fold(part, chrom)
            now.feed(keys[a:b], g[a:b])
    if now is not None:
        out.append(now.state())
    schema = pa.schema(
        [("part", pa.int32()), ("chr", pa.string())] + [(c, pa.int64()) for c in ("n_rows", "calls", "missing", "n0", "n1", "n2", "sites")] + [(c, pa.list_(pa.int64())) for c in ("first_site", "last_site", "first_call", "last_call")] + [("last_g", pa.int32())]
    )
    for i in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_pylist(out[i : i + 10_000], schema=schema)


def chr_states(genotypes: DataFrame, partitions: int | None = None) -> DataFrame:
    """One partial state per (partition, chr) of the range-partitioned calls."""
    rows = genotypes.select("chr", "panel_id", "locus_idx", "ind_idx", "loaded_at", "g").withColumn("spread", F.spark_partition_id())
    order = ["chr", "panel_id", "locus_idx", "ind_idx", "loaded_at", "spread"]
    ranged = rows.repartitionByRange(partitions or partition_count(rows), *order).sortWithinPartitions(*order)
    return ranged.select("chr", "panel_id", "locus_idx", "ind_idx", "g").mapInArrow(_fold, _STATE)


def chr_stats(genotypes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per chr: rows, current calls, current missing calls, sites and current calls by value.

    A call is keyed by (panel, locus, individual) within its chr; of several versions the one with
    the latest `loaded_at` counts (null is earliest), copies count once. `n_rows` counts every row.
    A site is a (panel, locus). A null chr is a group of its own, and a null within the rest of the
    key is a value like any other. An empty table gives no rows; further columns are ignored.
    """
    w = Window.partitionBy("chr").orderBy("part")
    joined = (F.lead("first_call").over(w) == F.col("last_call")) & F.col("last_call").isNotNull()
    again = F.when(F.coalesce(joined, F.lit(False)), 1).otherwise(0)  # the next state holds a later version of this state's last call
    site_again = F.when(F.coalesce(F.lead("first_site").over(w) == F.col("last_site"), F.lit(False)), 1).otherwise(0)
    stitched = chr_states(genotypes, partitions).select("chr", "n_rows", "calls", "missing", "n0", "n1", "n2", "sites", "last_g", again.alias("again"), site_again.alias("site_again"))

    def less(name: str, drop) -> F.Column:
        return F.sum(F.col(name) - drop).alias(name)

    is_call = F.col("last_g").isin(*CALLS).cast("int")
    return stitched.groupBy("chr").agg(
        F.sum("n_rows").alias("n_rows"),
        less("calls", F.col("again") * is_call),
        less("missing", F.col("again") * (1 - is_call)),
        less("sites", F.col("site_again")),
        *(less(f"n{v}", F.col("again") * (F.col("last_g") == v).cast("int")) for v in CALLS),
    )


def chr_sites(loci: DataFrame, blocks: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per chr: `loci_rows`, `loci_sites` (distinct panel and locus), and of its blocks `panels`, `nloci`, `nloci_known` and `nloci_stale`.

    The sites come from the same range partitions and stitched states as the calls. A block is one (panel, chr), of whose rows
    the largest `nloci` counts; `nloci` is their sum, `nloci_known` the blocks where it isn't null, and `nloci_stale` those where it
    isn't the number of the block's sites in `loci`. A chr of one table alone has nulls for the other, a null chr is a group of
    its own; rows of a null panel are a panel's like any other. Empty tables give no rows.
    """
    as_calls = loci.select("chr", "panel_id", "locus_idx", F.lit(0).alias("ind_idx"), F.lit(None).cast("timestamp").alias("loaded_at"), F.lit(None).cast("smallint").alias("g"))
    there = chr_stats(as_calls, partitions).select("chr", F.col("n_rows").alias("loci_rows"), F.col("sites").alias("loci_sites"))
    block = blocks.groupBy("panel_id", "chr").agg(F.max("nloci").alias("nloci"))
    sizes = loci.groupBy("panel_id", "chr", "locus_idx").agg(F.count(F.lit(1)).alias("_n")).groupBy("panel_id", "chr").agg(F.count(F.lit(1)).alias("size"))
    b, z = block.alias("b"), sizes.alias("z")
    both = b.join(z, F.col("b.panel_id").eqNullSafe(F.col("z.panel_id")) & F.col("b.chr").eqNullSafe(F.col("z.chr")), "left")
    stale = F.col("b.nloci").isNotNull() & (F.col("b.nloci") != F.coalesce("z.size", F.lit(0)))
    told = both.groupBy(F.col("b.chr").alias("chr")).agg(F.count(F.lit(1)).alias("panels"), F.sum("b.nloci").alias("nloci"), F.count("b.nloci").alias("nloci_known"), F.count(F.when(stale, 1)).alias("nloci_stale"))
    t, u = there.alias("t"), told.alias("u")
    return t.join(u, F.col("t.chr").eqNullSafe(F.col("u.chr")), "full").select(F.coalesce("t.chr", "u.chr").alias("chr"), "loci_rows", "loci_sites", "panels", "nloci", "nloci_known", "nloci_stale")


def heavy_chr(genotypes: DataFrame, share: float = 0.04, partitions: int | None = None) -> DataFrame:
    """Each non-null chr that holds at least `share` of all rows; of an empty table, none."""
    stats = chr_stats(genotypes, partitions).select("chr", "n_rows")
    total = Window.partitionBy(F.lit(1))  # over one row per chr
    return stats.withColumn("total", F.sum("n_rows").over(total)).where((F.col("n_rows") >= share * F.col("total")) & F.col("chr").isNotNull()).select("chr")
