import math
import os
import random

import numpy as np
import pytest

from rohspark.llm import packing
from rohspark.llm.leaks import words

pytestmark = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer file")
D = "doc_id bigint, text string, piece int, capacity int"
B = "budget_id int, capacity int, doc_id int"


def encode(text):
    with open(packing.TOKENIZER, "rb") as f:
        return packing.load_tokenizer(f.read()).encode_ordinary(text)


def docs(n=150, seed=1):
    r = random.Random(seed)
    v = [f"{a}{b}" for a in ("kel", "mor", "tis", "an") for b in ("in", "eth", "ul", "ox", "er")]
    return [(i, " ".join(r.choice(v) for _ in range(int(r.lognormvariate(3.5, 1.2)))), 1, 2) for i in range(n)]


def check(rows, sizes, budgets):
    """Every text is covered once per budget, in order, and no container overflows."""
    for b, cap in budgets:
        mine = [r for r in rows if r["budget_id"] == b]
        used = {}
        for r in mine:
            assert r["capacity"] == cap
            used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        assert not used or max(used.values()) <= cap
        by = {}
        for r in mine:
            by.setdefault(r["doc_id"], []).append((r["token_start"], r["n_tokens"], r["piece"]))
        assert by.keys() == sizes.keys()
        for d, parts in by.items():
            parts.sort()
            assert sum(n for _, n, _ in parts) == sizes[d] and [p for *_, p in parts] == list(range(len(parts)))
            assert all(a == cap * k for k, (a, _, _) in enumerate(parts)) and (len(parts) == 1 or sizes[d] > cap)
    return True


def test_round_trip_and_fill(spark):
    rows = docs() + [(900, "", 0, 0), (901, "tok " * 5000, 0, 0)]
    sizes = {d: len(encode(t)) for d, t, *_ in rows}
    budgets = [(1, 64), (2, 300)]
    df = spark.createDataFrame([*rows, (902, None, 0, 0)], D).repartition(4)
    bs = spark.createDataFrame([(1, 64, 0), (2, 300, 0), (2, 300, 1), (3, 0, 0), (4, None, 0), (None, 5, 0)], B)
    for shard in (2048, 40):
        packed = packing.pack_texts(df, bs, shard_texts=shard)
        assert check(packed.collect(), sizes, budgets)
        used = {r["budget_id"]: r["used"] for r in packing.fill_report(packed).collect()}
        assert used[1] > 0.85 and used[2] > 0.85
    again = packing.pack_texts(df.repartition(2), bs)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packing.pack_texts(df, bs).collect()))


def test_scores_are_bm25(spark):
    rows = docs(60, 4)
    got = packing.sized_texts(spark.createDataFrame(rows, D)).orderBy("doc_id").collect()
    counts = [dict() for _ in rows]
    for c, (_, t, *_) in zip(counts, rows):
        for w in words(t):
            c[w] = c.get(w, 0) + 1
    n, mean = len(rows), sum(sum(c.values()) for c in counts) / len(rows)
    df = {}
    for c in counts:
        for w in c:
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    table = np.zeros(packing.BUCKETS)
    sizer = packing._Sizer(open(packing.TOKENIZER, "rb").read())
    for w, x in idf.items():
        table[sizer.bucket(w)] = x
    owner = np.repeat(np.arange(n), [len(r["terms"]) for r in got])
    s = packing.bm25_scores(np.array([t for r in got for t in r["terms"]]), owner, np.array([c for r in got for c in r["counts"]], dtype=np.float32), np.array([r["n_words"] for r in got]), table, mean)
    for i in range(0, n, 7):
        for j in range(n):
            if i != j:
                want = sum(idf[w] * counts[j][w] * 2.2 / (counts[j][w] + 1.2 * (0.25 + 0.75 * sum(counts[j].values()) / mean)) for w in counts[i] if w in counts[j])
                assert s[i, j] == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_windows_take_the_nearest_that_fit():
    sizes = np.array([90, 10, 10, 10, 95])
    scores = np.zeros((5, 5), dtype=np.float32)
    scores[0, 2] = 5
    place = packing.fill_windows(sizes, 100, scores)
    assert place[0] == place[2] and place[1] == place[3] and len(set(place)) == 3
    assert len(packing.fill_windows(np.zeros(0, dtype=int), 5, np.zeros((0, 0), dtype=np.float32))) == 0
    r = np.random.default_rng(1)
    sizes = r.integers(1, 200, 500)
    place = packing.fill_windows(sizes, 200, r.random((500, 500), dtype=np.float32))
    assert np.bincount(place, sizes).max() <= 200 and len(set(place)) <= 1.05 * sizes.sum() / 200


def test_neighbours_share_containers(spark):
    r = random.Random(5)
    rows = []
    for i in range(200):
        stem = ["kelmor", "tisanul"][i % 2]
        rows.append((i, " ".join(f"{stem}{r.choice('abcdefgh')}" for _ in range(r.randrange(10, 14))), 0, 0))
    packed = packing.pack_texts(spark.createDataFrame(rows, D), spark.createDataFrame([(1, 250, 0)], B)).collect()
    by = {}
    for p in packed:
        by.setdefault(p["container"], []).append(p["doc_id"] % 2)
    pure = sum(max(c.count(0), c.count(1)) for c in by.values()) / len(packed)
    assert pure > 0.8  # half would be chance


def test_empty_tables(spark):
    e, b = spark.createDataFrame([], D), spark.createDataFrame([(1, 10, 0)], B)
    assert packing.pack_texts(e, b).count() == 0
    assert packing.pack_texts(spark.createDataFrame(docs(3), D), spark.createDataFrame([], B)).count() == 0
    twice = packing.pack_texts(spark.createDataFrame(docs(1) * 2, D), b)
    n = len(encode(docs(1)[0][1]))
    assert twice.selectExpr("sum(n_tokens)").first()[0] == 2 * n
    with pytest.raises(ValueError):
        packing.pack_texts(e, spark.createDataFrame([(1, 5, 0), (2, 6, 0)], B), max_budgets=1)


def test_every_text_is_a_candidate_of_every_seed(spark):
    rows = docs(400, 7)
    texts = packing.sized_texts(spark.createDataFrame(rows, D)).orderBy("doc_id").collect()
    n, mean = len(texts), sum(r["n_words"] for r in texts) / len(texts)
    owner = np.repeat(np.arange(n), [len(r["terms"]) for r in texts])
    terms, counts = (np.array([x for r in texts for x in r[c]]) for c in ("terms", "counts"))
    df = np.bincount(terms, minlength=packing.BUCKETS)
    scores = packing.bm25_scores(terms, owner, counts.astype(np.float32), np.array([r["n_words"] for r in texts]), np.log1p((n - df + 0.5) / (df + 0.5)), mean)
    rest = np.array([r["n_tokens"] % 300 for r in texts])
    free, want = {i for i in range(n) if rest[i]}, set()
    for seed in sorted(free, key=lambda i: (-rest[i], i)):
        if seed not in free:
            continue
        free.discard(seed)
        mine, room = [seed], 300 - rest[seed]
        while fitting := [i for i in free if rest[i] <= room]:
            pick = max(fitting, key=lambda i: (scores[seed, i] + 1e-3) * rest[i] ** 2)
            free.discard(pick)
            mine.append(pick)
            room -= rest[pick]
        want.add(frozenset(mine))
    for together in (40, 2048):
        by = {}
        for r in packing.pack_texts(spark.createDataFrame(rows, D), spark.createDataFrame([(1, 300, 0)], B), shard_texts=together).collect():
            if r["n_tokens"] < 300:
                by.setdefault(r["container"], set()).add(r["doc_id"])
        got = {frozenset(c) for c in by.values()}
        assert len(got & want) >= 0.98 * len(want)  # sums in another order may break a tie


def brute_force(rows):
    """All BM25 scores of (query, text), and the token counts, by row."""
    counts = [dict() for _ in rows]
    for c, (_, t, *_) in zip(counts, rows):
        for w in words(t or ""):
            c[w] = c.get(w, 0) + 1
    n, mean = len(rows), sum(sum(c.values()) for c in counts) / len(rows)
    df = {}
    for c in counts:
        for w in c:
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    s = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            if i != j:
                size = 1.2 * (0.25 + 0.75 * sum(counts[j].values()) / mean)
                s[i, j] = sum(idf[w] * counts[j][w] * 2.2 / (counts[j][w] + size) for w in counts[i] if w in counts[j])
    return s


@pytest.mark.parametrize("block", [4096, 3])
def test_neighbours_are_those_of_a_brute_force_search(spark, block):
    rows = docs(160, 9)
    s = brute_force(rows)
    got = {}
    for r in packing.neighbours(spark.createDataFrame(rows, D).repartition(3), k=10, every=20, block_seeds=block).collect():
        got.setdefault(r["doc_id"], {})[r["neighbour"]] = r["score"]
    assert sorted(got) == [i for i in range(0, 160, 20) if s[i].any()]
    for i, near in got.items():
        want = np.sort(s[i])[::-1][:10]
        assert len(near) == min(10, (s[i] > 0).sum()) and i not in near
        assert np.allclose(sorted(near.values(), reverse=True), want[: len(near)], rtol=1e-4)
        assert all(s[i, j] == pytest.approx(v, rel=1e-4) for j, v in near.items())


def test_runs_tasks_and_blocks_keep_every_token(spark):
    rows = docs(300, 3) + [(1000 + i, "kelin morul tisox", 0, 0) for i in range(150)] + [(5000, "anin " * 900, 0, 0), (5001, "", 0, 0)]
    sizes = {d: len(encode(t)) for d, t, *_ in rows}
    df = spark.createDataFrame(rows, D).repartition(4)
    packed = packing.pack_texts(df, spark.createDataFrame([(1, 64, 0), (2, 300, 0)], B), every=7, block_seeds=5, run_texts=40, task_texts=120)
    assert check(packed.collect(), sizes, [(1, 64), (2, 300)])
    assert min(r["used"] for r in packing.fill_report(packed).collect()) > 0.8


def test_texts_without_a_seed_are_packed_too(spark):
    rows = [(7 * i + 1, t, 0, 0) for i, (_, t, *_) in enumerate(docs(40, 2)) if (7 * i + 1) % 50]
    sizes = {d: len(encode(t)) for d, t, *_ in rows}
    df = spark.createDataFrame([(None, "kelin morul", 0, 0), *rows], D)
    got = packing.pack_texts(df, spark.createDataFrame([(1, 64, 0)], B), every=1000).collect()
    assert sum(r["n_tokens"] for r in got) == sum(sizes.values()) + len(encode("kelin morul"))
    assert packing.neighbours(df, every=1000).count() == 0


def test_text_ids(spark):
    rows = [(f"d{i}", t) for i, t, *_ in docs(60, 6)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert packing.neighbours(df, k=3, every=5).groupBy("doc_id").count().where("count > 3").count() == 0
    assert packing.pack_texts(df, spark.createDataFrame([(1, 64, 0)], B)).select("doc_id").distinct().count() == 60
