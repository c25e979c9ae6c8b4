import datetime as dt
import random

from tests.conftest import T0

from rohspark.operators import key_stats

SCHEMA = "panel_id int, chr string, locus_idx int, ppos bigint, ind_idx int, g smallint, first_copy boolean, loaded_at timestamp, part string, n_rows int"


def rows_of(seed, n, hot=None):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        chrom = hot if hot and r.random() < 0.4 else r.choice(["chr1", "chr1", "chr1", "chr2", "chrUn_0001", None])
        row = (r.choice([1, 2, None]), chrom, r.randrange(6), 5, r.choice([1, 2, 3, None]), r.choice([0, 1, 2, None, -9, 3]), None, r.choice([None, T0, T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=2)]), "x", 7)
        out.append(row)
    return out


def brute(rows):
    """Versions with one key and time are equal by the table's definition, so the first row of each decides."""
    by = {}
    for p, c, l, _, i, g, _, t, *_ in rows:
        d = by.setdefault(c, {"n": 0, "calls": {}, "sites": set()})
        d["n"] += 1
        d["sites"].add((p, l))
        k = (p, l, i)
        t = t or dt.datetime.min.replace(tzinfo=dt.timezone.utc)
        if k not in d["calls"] or t > d["calls"][k][0]:
            d["calls"][k] = (t, g)
    out = {}
    for c, d in by.items():
        g = [x for _, x in d["calls"].values()]
        out[c] = (d["n"], sum(x in (0, 1, 2) for x in g), sum(x not in (0, 1, 2) for x in g), len(d["sites"]), *(g.count(v) for v in (0, 1, 2)))
    return out


def consistent(rows):
    """One g for each key and time."""
    seen, out = {}, []
    for row in rows:
        k = (row[0], row[1], row[2], row[4], row[7])
        seen.setdefault(k, row[5])
        out.append((*row[:5], seen[k], *row[6:]))
    return out


def got(df):
    return {r["chr"]: (r["n_rows"], r["calls"], r["missing"], r["sites"], r["n0"], r["n1"], r["n2"]) for r in df.collect()}


def test_against_brute_force_with_many_cuts(spark):
    for seed, parts in ((1, 1), (2, 7), (3, 40)):
        rows = consistent(rows_of(seed, 600, "chr7"))
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert got(key_stats.chr_stats(df, parts)) == brute(rows)


def test_one_call_repeated_over_all_partitions(spark):
    rows = [(1, "chr1", 0, 5, 1, 2, None, T0, "x", 7)] * 500 + [(1, "chr1", 1, 6, 1, 0, None, T0, "x", 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert got(key_stats.chr_stats(df, 8)) == {"chr1": (501, 2, 0, 2, 1, 0, 1)}


def test_heavy_and_empty(spark):
    rows = consistent(rows_of(5, 300))
    df = spark.createDataFrame(rows, SCHEMA)
    n = {}
    for r in rows:
        n[r[1]] = n.get(r[1], 0) + 1
    assert {r["chr"] for r in key_stats.heavy_chr(df, 0.3).collect()} == {c for c, k in n.items() if c is not None and k >= 0.3 * len(rows)}
    empty = spark.createDataFrame([], SCHEMA)
    assert key_stats.chr_stats(empty).count() == 0 and key_stats.heavy_chr(empty).count() == 0


def test_sites_and_blocks(spark):
    loci = "panel_id int, chr string, locus_idx int, n_rows string"
    blocks = "panel_id int, chr string, nloci int, panels string"
    rows = [(p, c, i, "clash") for p in (1, 2) for c in ("chr1", None) for i in range(30)] + [(1, "chr1", 3, "clash")] * 5 + [(1, "chr9", None, None)]
    told = [(1, "chr1", 30, ""), (1, "chr1", None, ""), (2, "chr1", 29, ""), (1, None, None, ""), (2, "chrX", 4, "")]
    got = {r["chr"]: tuple(r)[1:] for r in key_stats.chr_sites(spark.createDataFrame(rows, loci), spark.createDataFrame(told, blocks), partitions=5).collect()}
    assert got == {"chr1": (65, 60, 2, 59, 2, 1), None: (60, 60, 1, None, 0, 0), "chr9": (1, 1, None, None, None, None), "chrX": (None, None, 1, 4, 1, 1)}
    empty = key_stats.chr_sites(spark.createDataFrame([], loci), spark.createDataFrame([], blocks))
    assert empty.count() == 0
