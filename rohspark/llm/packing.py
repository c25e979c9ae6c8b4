"""Packing texts into containers of fixed capacity, neighbours by BM25 together.

One pass sizes every text in tokens and reduces it to hashed terms with their counts; document
frequencies are counted over all texts. The rest takes three steps.

1. The seeds, a stated query set of one text in `SEED_EVERY`, are indexed: an inverted index in shards of at most
   `BLOCK_SEEDS` seeds and `BLOCK_POSTINGS` postings. Every text streams past every shard and is scored for every
   seed, so retrieval is exact and whole; nothing is pruned.
2. Each text is returned to one seed: the one for which its score, over the root of the seed's own weight, is best. So every
   seed gets a list of unused neighbours in order of score. Lists are laid end to end by a range partitioning with
   sampled bounds, in which a list of any length spreads over partitions.
3. The lists are cut into runs of a bounded number of texts, and the windows of each capacity are filled run by run: the
   largest unused text of the run opens a window, and of the run's unused texts the one with the best BM25 score and
   fit goes in next, until none fits. Windows that stay too empty are opened again: their texts go on to the next run.

No step holds more than a shard, a batch or a run. Scoring grows with the number of texts times that of seeds, all else
in proportion to the texts.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rohspark.llm.leaks import words
from rohspark.session import materialise

#: Where the public tokenizer's ranks lie, and the pattern that splits text before its merges.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BUCKETS = 1 << 20  # terms are hashed to so many, which bounds the table of document frequencies
K1, B = 1.2, 0.75
SEED_EVERY = 50  # one text in so many is a seed: those whose id is divisible by it
BLOCK_SEEDS, BLOCK_POSTINGS = 4096, 4_000_000  # of one shard of the index, at most (one text is never cut)
RUN_TEXTS, RUN_POSTINGS = 2048, 8_000_000  # texts that are filled together, at most
TASK_TEXTS = 8192  # texts of one range partition, about
SHARD_TEXTS = 2048  # seeds that are scored together, at most
FIT = 2.0  # how strongly the share of the room that an item takes weighs beside its score
FILLED = 0.985  # windows less full than this go on to the next run
_DENSE = 256  # so many of the commonest terms are scored by a matrix product
_CELLS = 1 << 21  # scores or postings held at once


def load_tokenizer(ranks: bytes):
    """A tiktoken encoding from the bytes of a file of ranks."""
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


class _Sizer:
    """Token counts and hashed terms of texts."""

    def __init__(self, ranks: bytes):
        self.encode = load_tokenizer(ranks).encode_ordinary
        self.buckets: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        b = self.buckets.get(word)
        if b is None:
            if len(self.buckets) > 500_000:
                self.buckets.clear()
            b = self.buckets[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return b

    def size(self, text: str) -> tuple[int, int, list[int], list[int]]:
        counts = Counter(words(text))
        return len(self.encode(text)), sum(counts.values()), [self.bucket(w) for w in counts], list(counts.values())


def sized_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, n_words, terms, counts) of every text that isn't null."""
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, about 1 MB

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = _Sizer(shared.value)
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, batch.num_rows, 500):
                stop = min(start + 500, batch.num_rows)
                got = [sizer.size(texts[k].as_py()) for k in range(start, stop)]
                columns = list(zip(*got)) if got else [()] * 4
                types = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *(pa.array(c, type=t) for c, t in zip(columns, types))], names=[doc_id, "n_tokens", "n_words", "terms", "counts"])

    id_type = documents.schema[doc_id].dataType.simpleString()
    return documents.where(F.col(text).isNotNull()).select(doc_id, text).mapInArrow(size, f"{doc_id} {id_type}, n_tokens int, n_words int, terms array<int>, counts array<int>")


# Scores -------------------------------------------------------------------------------------------


@dataclass
class Weights:
    """What scoring needs to know of the whole corpus; its size depends on `BUCKETS` alone."""

    idf: np.ndarray
    mean_words: float
    column: np.ndarray  # the place of a bucket among the commonest, else -1

    @classmethod
    def of(cls, idf: np.ndarray, mean_words: float) -> "Weights":
        column = np.full(len(idf), -1, dtype=np.int32)
        common = np.argsort(idf, kind="stable")
        common = common[idf[common] > 0][:_DENSE]
        column[common] = np.arange(len(common))
        return cls(idf.astype(np.float32), float(mean_words), column)


@dataclass
class _Texts:
    """Postings of some texts: those of the commonest terms as a matrix of weights, the others in order of text."""

    dense: np.ndarray
    terms: np.ndarray
    owner: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, terms: np.ndarray, owner: np.ndarray, counts: np.ndarray, n_words: np.ndarray, w: Weights) -> "_Texts":
        norm = (K1 * (1 - B + B * n_words / max(w.mean_words, 1e-9))).astype(np.float32)
        counts = counts.astype(np.float32)
        weight = w.idf[terms] * (counts * np.float32(K1 + 1) / (counts + norm[owner]))
        column = w.column[terms]
        common = column >= 0
        cell = owner[common].astype(np.int64) * _DENSE + column[common]
        dense = np.bincount(cell, weight[common], minlength=len(n_words) * _DENSE).astype(np.float32).reshape(len(n_words), _DENSE)
        return cls(dense, terms[~common], owner[~common], weight[~common])


class SeedIndex:
    """An inverted index of texts as queries: term to the seeds that hold it. One shard of the whole index."""

    def __init__(self, tids: np.ndarray, terms: np.ndarray, owner: np.ndarray, w: Weights):
        self.tids, self.w, n = tids, w, len(tids)
        mass = np.bincount(owner, w.idf[terms], minlength=n)
        self.scale = (1 / np.sqrt(np.maximum(mass, 1e-9))).astype(np.float32)
        column = w.column[terms]
        common = column >= 0
        self.asked = np.zeros((_DENSE, n), dtype=np.float32)
        self.asked[column[common], owner[common]] = 1
        by = np.argsort(terms[~common], kind="stable")
        rare = terms[~common][by]
        self.seed = owner[~common][by].astype(np.int64)
        self.term, first = np.unique(rare, return_index=True)
        self.begin = np.append(first, len(rare))

    def scores(self, texts: _Texts) -> np.ndarray:
        """score[i, j]: BM25 of text i for the distinct terms of seed j."""
        m, n = len(texts.dense), len(self.tids)
        out = texts.dense @ self.asked
        if len(self.term) and len(texts.terms):
            at = np.minimum(np.searchsorted(self.term, texts.terms), len(self.term) - 1)
            there = self.term[at] == texts.terms
            at, owner, weight = at[there], texts.owner[there].astype(np.int64), texts.weight[there]
            sizes = self.begin[at + 1] - self.begin[at]
            ends = np.cumsum(sizes)
            a = 0
            while a < len(at):  # pieces of a bounded number of postings
                base = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, base + _CELLS, side="right")))
                k = sizes[a:b]
                place = np.arange(k.sum()) + np.repeat(self.begin[at[a:b]] - (ends[a:b] - k - base), k)
                low, high = int(owner[a]), int(owner[b - 1]) + 1
                cell = np.repeat((owner[a:b] - low) * n, k) + self.seed[place]
                out[low:high] += np.bincount(cell, np.repeat(weight[a:b], k), minlength=(high - low) * n).reshape(high - low, n)
                a = b
        return out[:m]


def bm25_scores(terms: np.ndarray, owner: np.ndarray, counts: np.ndarray, n_words: np.ndarray, idf: np.ndarray | Weights, mean_words: float = 0.0) -> np.ndarray:
    """score[i, j]: BM25 of text j for text i's distinct terms as the query; owner is the text of each posting."""
    w = idf if isinstance(idf, Weights) else Weights.of(idf, mean_words)
    texts, index = _Texts.of(terms, owner, counts, n_words, w), SeedIndex(np.arange(len(n_words)), terms, owner, w)
    step = max(1, _CELLS // max(1, len(n_words)))
    out = np.zeros((len(n_words), len(n_words)), dtype=np.float32)
    for a in range(0, len(n_words), step):
        b = min(a + step, len(n_words))
        lo, hi = np.searchsorted(texts.owner, [a, b])
        out[:, a:b] = index.scores(_Texts(texts.dense[a:b], texts.terms[lo:hi], texts.owner[lo:hi] - a, texts.weight[lo:hi])).T
    return out


def _postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms, owner, counts and n_words of a batch of sized texts."""
    lists = [batch.column(c) for c in ("terms", "counts")]
    owner = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(lists[0].offsets.to_numpy()))
    return lists[0].flatten().to_numpy(), owner, lists[1].flatten().to_numpy(), batch.column("n_words").to_numpy().astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int, postings: int) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in batches of at most `rows` rows and, but for single rows, `postings` postings."""
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
        a = 0
        while a < batch.num_rows:
            base = ends[a - 1] if a else 0
            b = min(a + rows, max(a + 1, int(np.searchsorted(ends, base + postings, side="right"))))
            yield batch.slice(a, b - a)
            a = b


# Retrieval ----------------------------------------------------------------------------------------


def corpus_weights(texts: DataFrame) -> Weights:
    """Counts the document frequencies of sized texts: at most `BUCKETS` rows reach the driver."""
    total = texts.agg(F.count(F.lit(1)), F.coalesce(F.avg("n_words"), F.lit(0.0))).first()
    n = int(total[0])
    seen = texts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toPandas()
    df = np.zeros(BUCKETS)
    df[seen["t"].to_numpy(dtype=np.int64)] = seen["df"]
    df = np.minimum(df, n)  # two words of a text may share a bucket
    return Weights.of(np.where(df > 0, np.log1p((n - df + 0.5) / (df + 0.5)), 0.0), float(total[1]))


def stated_seeds(texts: DataFrame, doc_id: str, every: int = SEED_EVERY) -> DataFrame:
    """One row per id of the query set: ids divisible by `every`, or whose hash is where ids aren't integers."""
    whole = isinstance(texts.schema[doc_id].dataType, T.IntegralType)
    chosen = texts.where((F.pmod(F.col(doc_id) if whole else F.xxhash64(doc_id), F.lit(every)) == 0) & F.col(doc_id).isNotNull() & (F.size("terms") > 0))
    return chosen.groupBy(doc_id).agg(F.max(F.struct("n_words", "_tid", "terms")).alias("v")).select(doc_id, "v._tid", "v.terms")


def _shards(texts: DataFrame, doc_id: str, every: int, block_seeds: int, w: Weights) -> list[tuple]:
    """(broadcast index, broadcast ids) of each shard of the index. The driver holds one shard at a time."""
    sc = texts.sparkSession.sparkContext
    seeds = materialise(stated_seeds(texts, doc_id, every), "seeds")
    n, postings = seeds.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    count = max(-(-n // block_seeds), -(-postings // BLOCK_POSTINGS)) if n else 0
    out = []
    for i in range(count):
        part = seeds.where(F.pmod(F.xxhash64("_tid"), F.lit(count)) == i).select("_tid", doc_id, "terms").orderBy("_tid").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        lists = part.column("terms").combine_chunks()
        owner = np.repeat(np.arange(part.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        shard = SeedIndex(part.column("_tid").to_numpy(), lists.flatten().to_numpy(), owner, w)
        shard.w = None  # travels once, not with every shard
        out.append(sc.broadcast((shard, part.column(doc_id).to_pylist())))
    return out


def _scan(texts: DataFrame, shard, shared, each, schema: str) -> DataFrame:
    """`each` over the scores of all texts, piece by piece, against one shard of the index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = shard.value
        step = max(1, min(2048, _CELLS // max(1, len(index.tids))))
        yield from each(index, ids, ((p, index.scores(_Texts.of(*_postings(p), shared.value))) for p in _pieces(batches, step, 1_000_000)))

    return texts.mapInArrow(scan, schema)


def best_seeds(texts: DataFrame, doc_id: str, shards: list, shared) -> DataFrame:
    """(_tid, seed, score): for each text that shares a term with a seed, the seed to which it is returned."""
    id_type = texts.schema[doc_id].dataType.simpleString()

    def each(index: SeedIndex, ids: list, scored) -> Iterator[pa.RecordBatch]:
        for piece, s in scored:
            s *= index.scale
            best = s.argmax(axis=1)
            top = s[np.arange(len(s)), best]
            found = np.flatnonzero(top > 0)
            yield pa.RecordBatch.from_arrays([piece.column("_tid").take(pa.array(found)), pa.array([ids[b] for b in best[found]], type=piece.schema.field(doc_id).type), pa.array(top[found].astype(np.float64))], names=["_tid", "seed", "score"])

    found = None
    for shard in shards:
        part = _scan(texts.select("_tid", doc_id, "n_words", "terms", "counts"), shard, shared, each, f"_tid bigint, seed {id_type}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return texts.sparkSession.createDataFrame([], f"_tid bigint, seed {id_type}, score double")
    return found if len(shards) == 1 else found.groupBy("_tid").agg(F.max(F.struct("score", "seed")).alias("v")).select("_tid", "v.seed", "v.score")


def neighbours(documents: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, every: int = SEED_EVERY, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, place, neighbour, score): the `k` texts with the best BM25 scores for each seed, by the index that packing uses.

    The seeds are the texts whose id is divisible by `every` (see `stated_seeds`), each searched against all
    texts but itself. Exact: every text is scored for every seed. Of equal scores the text with the larger id comes first.
    Texts with a null id or without a term in common aren't returned; null texts take no part. An empty table gives no rows.
    """
    texts = materialise(sized_texts(documents, doc_id, text, tokenizer).withColumn("_tid", F.monotonically_increasing_id()), "sized")
    w = corpus_weights(texts)
    shared = documents.sparkSession.sparkContext.broadcast(w)
    id_type = texts.schema[doc_id].dataType.simpleString()
    schema = f"{doc_id} {id_type}, neighbour {id_type}, score double"

    def each(index: SeedIndex, ids: list, scored) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        best, names = np.zeros((n, 0), dtype=np.float32), np.zeros((n, 0), dtype=object)
        kind = None
        for piece, s in scored:
            kind = piece.schema.field(doc_id).type
            s[piece.column("_tid").to_numpy()[:, None] == index.tids] = 0
            their = np.array(piece.column(doc_id).to_pylist(), dtype=object)
            s[[t is None for t in their]] = 0
            best = np.hstack([best, s.T])
            names = np.hstack([names, np.broadcast_to(their, (n, len(their)))])
            if best.shape[1] > k:  # all that tie with the last one kept stay, so that the choice among them is made once
                least = np.partition(best, -k, axis=1)[:, -k]
                kept = best >= np.maximum(least, np.float32(1e-30))[:, None]
                width = int(kept.sum(axis=1).max())
                by = np.argsort(~kept, axis=1, kind="stable")[:, :width]
                best, names = np.take_along_axis(np.where(kept, best, 0), by, 1), np.take_along_axis(names, by, 1)
        row, col = np.nonzero(best > 0)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in row], type=kind), pa.array(list(names[row, col]), type=kind), pa.array(best[row, col].astype(np.float64))], names=[doc_id, "neighbour", "score"])

    found = None
    for shard in _shards(texts, doc_id, every, block_seeds, w):
        part = _scan(texts.select("_tid", doc_id, "n_words", "terms", "counts"), shard, shared, each, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.sparkSession.createDataFrame([], schema)
    best = found.groupBy(doc_id).agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "neighbour")), asc=False), 1, k).alias("top"))
    return best.select(doc_id, F.posexplode("top").alias("place", "v")).select(doc_id, (F.col("place") + 1).alias("place"), "v.neighbour", "v.score")


# Filling ------------------------------------------------------------------------------------------


def fill_windows(sizes: np.ndarray, capacity: int, scores: np.ndarray, together: int = SHARD_TEXTS) -> np.ndarray:
    """The container of each item, none of which exceeds the capacity.

    Seeds come by falling size. Of the unused items that fit, the one with the best score goes in
    next, until none fits. The score is weighed by the share of the room that the item takes, so that
    a window isn't left with gaps that only rarer sizes would fill. `scores` is a square matrix; up to `together` of its
    rows are put in order of size at once.
    """
    n = len(sizes)
    order = np.lexsort((np.arange(n), -sizes))
    container = np.full(n, -1, dtype=np.int64)
    size = sizes[order]
    falling = -size
    gain = np.maximum(size, 0.01).astype(np.float32) ** np.float32(FIT)  # 0 once an item is used
    made = 0
    for start in range(0, n, together):
        block = np.arange(start, min(start + together, n))
        block = block[gain[block] > 0]
        left = start + np.flatnonzero(gain[start:] > 0)  # all that a seed of this block may take
        rows = scores[np.ix_(order[block], order[left])]
        value, fallen = gain[left], falling[left]
        for near, seed in zip(rows, block):
            at = int(np.searchsorted(left, seed))
            if value[at] == 0:
                continue
            value[at] = 0
            container[order[seed]] = made
            room = capacity - int(size[seed])
            first = int(np.searchsorted(fallen, -room))
            worth = (near[first:] + np.float32(1e-3)) * value[first:]
            while len(worth):
                pick = int(worth.argmax())
                if worth[pick] <= 0:
                    break
                worth[pick] = value[first + pick] = 0
                took = left[first + pick]
                container[order[took]] = made
                room -= int(size[took])
                behind = int(np.searchsorted(fallen, -room))
                first, worth = max(first, behind), worth[max(0, behind - first) :]
            made += 1
        gain[left] = value
    return container


class _Filler:
    """Fills the windows of all capacities over the runs of one task."""

    def __init__(self, budgets: list[tuple[int, int]], w: Weights, doc_id: str, part: int, together: int):
        self.budgets, self.w, self.doc_id, self.together = budgets, w, doc_id, together
        self.made = part << 36  # containers are numbered on from here
        self.carried: pa.RecordBatch | None = None
        self.waiting: list[np.ndarray] = [np.zeros(0, dtype=bool) for _ in budgets]  # of the carried texts, those that each capacity waits for

    def run(self, batch: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
        """Containers of a run behind the texts carried into it; all windows are closed in the `last`."""
        old = 0
        if self.carried is not None:
            old = self.carried.num_rows
            batch = pa.Table.from_batches([self.carried, batch]).combine_chunks().to_batches()[0] if batch.num_rows else self.carried
        n = batch.num_rows
        if not n:
            return
        by = pc.sort_indices(batch.select([self.doc_id, "n_tokens", "n_words"]), [(c, "ascending") for c in (self.doc_id, "n_tokens", "n_words")])
        batch, fresh = batch.take(by), by.to_numpy() >= old
        terms, owner, counts, n_words = _postings(batch)
        scores = bm25_scores(terms, owner, counts, n_words, self.w)
        n_tokens = batch.column("n_tokens").to_numpy().astype(np.int64)
        wait = []
        for (budget_id, capacity), waited in zip(self.budgets, self.waiting):
            whole, rest = n_tokens // capacity, n_tokens % capacity
            ours = np.concatenate([waited, np.ones(n - old, dtype=bool)])[by]
            items = np.flatnonzero(ours & ((rest > 0) | (n_tokens == 0)))
            place = fill_windows(rest[items], capacity, scores[np.ix_(items, items)], self.together)
            windows = int(place.max()) + 1 if len(place) else 0
            used = np.bincount(place, rest[items], minlength=windows)
            go_on = np.zeros(windows, dtype=bool) if last else used < FILLED * capacity
            later = np.zeros(n, dtype=bool)
            later[items[go_on[place]]] = True
            wait.append(later)
            done = items[~go_on[place]]
            full = np.repeat(np.flatnonzero(fresh), whole[fresh])
            piece = np.arange(len(full)) - np.repeat(np.cumsum(whole[fresh]) - whole[fresh], whole[fresh])
            at = np.concatenate([done, full])
            pieces = np.concatenate([whole[done], piece])
            sizes = np.concatenate([rest[done], np.full(len(full), capacity)])
            containers = self.made + np.concatenate([place[~go_on[place]], windows + np.arange(len(full))])
            self.made += windows + len(full)
            head = [pa.array(np.full(len(at), v, dtype=np.int32)) for v in (budget_id, capacity)]
            arrays = [*head, pa.array(containers), batch.column(self.doc_id).take(pa.array(at)), pa.array(pieces.astype(np.int32)), pa.array(pieces * capacity), pa.array(sizes.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["budget_id", "capacity", "container", self.doc_id, "piece", "token_start", "n_tokens"])
        kept = np.flatnonzero(np.logical_or.reduce(wait)) if wait else np.zeros(0, dtype=np.int64)
        self.carried = batch.take(pa.array(kept)) if len(kept) else None
        self.waiting = [x[kept] for x in wait]


def pack_texts(
    documents: DataFrame, budgets: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, shard_texts: int = SHARD_TEXTS, max_budgets: int = 1000,
    every: int = SEED_EVERY, block_seeds: int = BLOCK_SEEDS, run_texts: int = RUN_TEXTS, task_texts: int = TASK_TEXTS,
) -> DataFrame:
    """(budget_id, capacity, container, doc_id, piece, token_start, n_tokens): each text assigned for each capacity.

    A text within the capacity is one piece. A larger one is cut: into pieces that fill a container each and
    a rest, which is packed like a text of its size. No container holds more than its capacity;
    `container` is unique within a budget. Empty texts take no room and are assigned like others;
    null texts are left out. Repeated rows are items of their own. Budgets with a null id or capacity or a capacity below
    1 are left out and repeated ones count once. Further columns are ignored; empty tables give
    no rows.

    `every` and `block_seeds` describe the index (see the module), `run_texts` bounds the texts that are filled together,
    `task_texts` is about the number of texts of a task. Up to `run_texts` texts all make one run, in which every text is a
    candidate for every window. `shard_texts` bounds the window seeds whose scores are put in order together,
    which doesn't change the result.
    """
    chosen = budgets.where(F.col("budget_id").isNotNull() & (F.col("capacity") >= 1)).select(F.col("budget_id").cast("int"), F.col("capacity").cast("int")).distinct().orderBy("budget_id", "capacity").limit(max_budgets + 1).collect()
    if len(chosen) > max_budgets:
        raise ValueError(f"more than {max_budgets} budgets")
    budget_list = [(r[0], r[1]) for r in chosen]
    texts = materialise(sized_texts(documents, doc_id, text, tokenizer).withColumn("_tid", F.monotonically_increasing_id()), "sized")
    w = corpus_weights(texts)
    shared = documents.sparkSession.sparkContext.broadcast(w)
    lists = best_seeds(texts, doc_id, _shards(texts, doc_id, every, block_seeds, w), shared)
    listed = texts.join(lists, "_tid", "left")
    order: list[Column] = [F.col("seed"), F.col("score").desc(), F.col(doc_id), F.col("n_tokens"), F.col("n_words"), F.col("_tid")]
    parts = max(1, -(-texts.count() // task_texts))
    laid = listed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(doc_id, "n_tokens", "n_words", "terms", "counts")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filler = _Filler(budget_list, shared.value, doc_id, TaskContext.get().partitionId(), shard_texts)
        held: list[pa.RecordBatch] = []
        rows = postings = 0
        for piece in _pieces(batches, 256, RUN_POSTINGS // 8):
            n = len(piece.column("terms").flatten())
            if held and (rows + piece.num_rows > run_texts or postings + n > RUN_POSTINGS):
                yield from filler.run(_joined(held), False)
                held, rows, postings = [], 0, 0
            held.append(piece)
            rows, postings = rows + piece.num_rows, postings + n
        if held or filler.carried is not None:
            yield from filler.run(_joined(held), True)

    id_type = documents.schema[doc_id].dataType.simpleString()
    return laid.mapInArrow(fill, f"budget_id int, capacity int, container bigint, {doc_id} {id_type}, piece int, token_start bigint, n_tokens int")


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def fill_report(packed: DataFrame) -> DataFrame:
    """Per budget: pieces, tokens, containers, the fewest that could hold the tokens, and the share of room used."""
    full = packed.groupBy("budget_id", "capacity", "container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    report = full.groupBy("budget_id", "capacity").agg(F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("containers"))
    return report.withColumns({"least": F.ceil(F.col("tokens") / F.col("capacity")), "used": F.col("tokens") / (F.col("containers") * F.col("capacity"))})
