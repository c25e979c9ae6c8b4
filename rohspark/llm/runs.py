"""Runs of repeated events in ordered sequences, found by a regular expression over symbol strings.

Every event becomes one Unicode character. The events of an entity, in order, make a string in which
a backreference finds each run, disturbances included, in one match; the span of the match leads back
to the events. A separator stands wherever a run may not pass: between entities and wide steps.

An entity's events are cut into chunks of bounded length, so that no task holds a whole long entity.
Of a chunk only the three outermost runs at either cut can change by what lies beyond it (a run of
any length takes part in that by at most `min_flank` of its symbols), so only those are stitched:
they are gathered per entity, written as a shortened string, and matched by the same expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x4E00  # symbol 0 is this code point
_SEP = ord("|")
_OPEN = 3  # runs at a cut that may still change

#: Largest symbol: the last code point below the surrogates.
MAX_SYMBOL = 0xD7FF - _BASE


def run_pattern(min_flank: int) -> re.Pattern:
    """A stretch of equal symbols; one of `min_flank` or more goes on over a single other symbol
    if at least `min_flank` of its own follow, and so on."""
    return re.compile(rf"([^|])(?:\1{{{min_flank - 1},}}(?:(?!\1)[^|]\1{{{min_flank},}})*|\1*)", re.DOTALL)


def _spans(pattern: re.Pattern, symbols: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run; `breaks` marks symbols before which a separator stands."""
    at = np.arange(len(symbols)) + np.cumsum(breaks)
    text = np.full(len(symbols) + int(breaks.sum()), _SEP, dtype="<u4")
    text[at] = symbols + _BASE
    spans = np.array([m.span() for m in pattern.finditer(text.tobytes().decode("utf-32-le"))], dtype=np.int64).reshape(-1, 2)
    back = np.zeros(len(text) + 1, dtype=np.int64)
    back[at] = np.arange(len(symbols))
    return back[spans[:, 0]], back[spans[:, 1] - 1]


def _weighted_spans(pattern: re.Pattern, symbols: np.ndarray, counts: np.ndarray, breaks: np.ndarray, min_flank: int) -> tuple[np.ndarray, np.ndarray]:
    """`_spans` of symbols that stand for several events each; `min_flank` of one are all that the expression can tell apart."""
    if (counts == 1).all():
        return _spans(pattern, symbols, breaks)
    index = np.repeat(np.arange(len(symbols)), np.minimum(counts, min_flank))
    lead = np.concatenate([[True], index[1:] != index[:-1]])
    i, j = _spans(pattern, symbols[index], breaks[index] & lead)
    return index[i], index[j]


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """Row number of each entry, and the flattened entries."""
    column = batch.column(name)
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), column.flatten()


def _field(entries: pa.StructArray, name: str) -> np.ndarray:
    return entries.field(name).to_numpy(zero_copy_only=False)


_LISTS = ("_o", "_p", "_s", "_v")
_HELD = 500_000  # rows whose versions a task tells apart at a time


def _latest(group: np.ndarray, order: np.ndarray, version: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Places of the last version of each event, by group and order; of equal versions that with the largest symbol."""
    by = np.lexsort((symbol, version, order, group))
    g, o = group[by], order[by]
    return by[np.concatenate([(g[1:] != g[:-1]) | (o[1:] != o[:-1]), [True]])] if len(by) else by


def _latest_lists(events: DataFrame, entity: list[str], order: str, position: str, symbol: str, version: str, chunk: int) -> DataFrame:
    """(entity, _chunk, _o, _p, _s, _v): events as lists per entity and chunk, made within each partition.

    Of the versions of one event that a task holds together only the last leaves it, so that copies of an event shrink before they
    are shuffled, and what is shuffled are lists, not rows.
    """
    known = F.col(order).isNotNull()
    for c in entity:
        known = known & F.col(c).isNotNull()
    sound = F.col(position).isNotNull() & (F.col(symbol) >= 0)
    s = F.when(sound, F.col(symbol)).otherwise(F.lit(-1)).cast("int")
    latest = F.coalesce(F.col(version), F.lit(-(1 << 62))).cast("bigint")
    rows = events.where(known).select(*entity, F.col(order).cast("bigint").alias("_o"), F.coalesce(F.col(position).cast("bigint"), F.lit(0).cast("bigint")).alias("_p"), s.alias("_s"), latest.alias("_v"))

    def gather(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        tab = pa.Table.from_batches(held).combine_chunks()
        code = np.zeros(tab.num_rows, dtype=np.int64)
        for c in entity:
            d = tab.column(c).combine_chunks().dictionary_encode()
            code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(), return_inverse=True)[1]
        o, p, s, v = (tab.column(c).to_numpy() for c in _LISTS)
        by = _latest(code, o, v, s)
        g, part = code[by], o[by] // chunk
        starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (part[1:] != part[:-1])]))
        offsets = pa.array(np.append(starts, len(by)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[by])) for x in (o, p, s, v)]
        heads = pa.array(by[starts])
        return pa.RecordBatch.from_arrays([*(tab.column(c).combine_chunks().take(heads) for c in entity), pa.array(part[starts]), *lists], names=[*entity, "_chunk", *_LISTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _HELD:
                yield gather(held)
                held, n = [], 0
        if n:
            yield gather(held)

    entity_type = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in entity)
    return rows.mapInArrow(run, f"{entity_type}, _chunk bigint, _o array<bigint>, _p array<bigint>, _s array<int>, _v array<bigint>")


def collapse_runs(
    events: DataFrame, entity: list[str], order: str, position: str, symbol: str, max_step: int, min_flank: int = 5, min_events: int = 1, chunk: int = 4096,
    range_of: DataFrame | None = None, version: str | None = None,
) -> DataFrame:
    """One row per run: entity, `symbol`, `n_events`, `n_bridged`, `start_<position>`, `stop_<position>`, `extent`.

    `events` has one row per event; a null or negative `symbol` is no event, and rows with a null in
    the entity, the order or the position are none either. A stretch is a maximal series of neighbours
    with equal symbol and no step in `position` over `max_step`. A stretch of one event is bridged if
    the stretches before and after it share a symbol and have at least `min_flank` events each, none
    of the steps being wide; chains of these are one run, every other stretch a run by itself.
    `n_events` leaves out the bridged events, and runs with fewer than `min_events` are left out.
    `extent` is the distance of the outermost positions, both included. Events with the same entity
    and order are taken in order of position, then symbol; repeated events count each, and are counted
    before they are gathered, so that copies of one event don't fill a task. With `version`, the name of a bigint column, rows of one
    entity and order are versions of one event: the largest counts (null is the least; of equals the largest symbol, no symbol
    being least), before anything else is left out; `order` must be whole numbers. Further columns are ignored. An empty table gives no rows.

    The range of `order`, which tells the number of chunks, is looked up first; `range_of` may name a table that is
    cheaper to read and whose `order` covers that of the events.
    """
    pattern = run_pattern(min_flank)
    key = [F.col(c) for c in entity]
    ok = F.col(symbol) >= 0
    for c in (*entity, order, position):
        ok = ok & F.col(c).isNotNull()
    if version is None:
        used = events.where(ok).select(*key, F.floor(F.col(order) / F.lit(chunk)).cast("bigint").alias("_chunk"), F.struct(F.col(order).cast("bigint").alias("o"), F.col(position).cast("bigint").alias("p"), F.col(symbol).cast("int").alias("s")).alias("_e"))
        counted = used.groupBy(*entity, "_chunk", "_e").agg(F.count(F.lit(1)).alias("n"))
        used = counted.select(*entity, "_chunk", F.struct("_e.o", "_e.p", "_e.s", "n").alias("_e"))
        grouped = used.groupBy(*entity, "_chunk").agg(F.sort_array(F.collect_list("_e")).alias("_es"))  # at most `chunk` orders a group
    else:
        gathered = _latest_lists(events, entity, order, position, symbol, version, chunk)
        grouped = gathered.groupBy(*entity, "_chunk").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in _LISTS))  # a few versions of at most `chunk` orders a group
    reach = (events.where(ok) if range_of is None else range_of).agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    first, last = (int(reach["a"] // chunk), int(reach["b"] // chunk)) if reach["a"] is not None else (0, 0)
    entity_type = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in entity)
    schema = f"{entity_type}, _chunk bigint, _ord int, open boolean, cut boolean, s int, n bigint, nb bigint, a bigint, b bigint"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if version is None:
                row, entries = _lists(batch, "_es")
                p, s, n = _field(entries, "p"), _field(entries, "s").astype(np.int64), _field(entries, "n")
            else:
                row, o = _lists(batch, "_o")
                o, p, s, v = (batch.column(c).flatten().to_numpy() for c in _LISTS)
                kept = _latest(row, o, v, s)
                kept = kept[s[kept] >= 0]
                row, p, s, n = row[kept], p[kept], s[kept].astype(np.int64), np.ones(len(kept), dtype=np.int64)
            if not len(row):
                continue
            if s.max() > MAX_SYMBOL:
                raise ValueError(f"symbols may not exceed {MAX_SYMBOL}")
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (p[1:] - p[:-1] > max_step)])
            i, j = _weighted_spans(pattern, s, n, new, min_flank)
            same = s == np.repeat(s[i], j - i + 1)
            own = np.add.reduceat(np.where(same, n, 0), i)
            other = np.add.reduceat(np.where(same, 0, n), i)
            r = row[i]
            head = np.concatenate([[True], r[1:] != r[:-1]])
            starts = np.flatnonzero(head)
            sizes = np.diff(np.append(starts, len(r)))
            ordinal = np.arange(len(r)) - np.repeat(starts, sizes)
            chunk_no = batch.column("_chunk").to_numpy()[r]
            is_open = ((chunk_no > first) & (ordinal < _OPEN)) | ((chunk_no < last) & (ordinal >= np.repeat(sizes, sizes) - _OPEN))
            cut = np.concatenate([[False], ~is_open[:-1]]) & ~head  # what lies before is settled and doesn't join
            keep = np.flatnonzero(is_open | (own >= min_events))
            rows = pa.array(r[keep])
            columns = [batch.column(c).take(rows) for c in entity]
            columns += [pa.array(x[keep]) for x in (chunk_no, ordinal.astype(np.int32), is_open, cut, s[i].astype(np.int32), own, other, p[i], p[j])]
            yield pa.RecordBatch.from_arrays(columns, names=[*entity, "_chunk", "_ord", "open", "cut", "s", "n", "nb", "a", "b"])

    runs = grouped.mapInArrow(find, schema)
    if first == last:  # no entity is cut
        return _result(runs, entity, symbol, position)
    part = F.struct("_chunk", "_ord", "cut", "s", "n", "nb", "a", "b").alias("_r")
    gathered = runs.where("open").groupBy(*entity).agg(F.sort_array(F.collect_list(part)).alias("_rs"))  # at most 2 * _OPEN per chunk

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, e = _lists(batch, "_rs")
            if not len(row):
                continue
            s, n, nb, a, b, cut = (_field(e, c) for c in ("s", "n", "nb", "a", "b", "cut"))
            s = s.astype(np.int64)
            new = np.concatenate([[True], (row[1:] != row[:-1]) | cut[1:].astype(bool) | (a[1:] - b[:-1] > max_step)])
            i, j = _weighted_spans(pattern, s, n, new, min_flank)
            same = s == np.repeat(s[i], j - i + 1)
            own = np.add.reduceat(np.where(same, n, 0), i)
            bridged = np.add.reduceat(np.where(same, nb, n), i)
            keep = np.flatnonzero(own >= min_events)
            rows = pa.array(row[i][keep])
            columns = [batch.column(c).take(rows) for c in entity]
            nothing = np.zeros(len(keep), dtype=np.int64)
            columns += [pa.array(x) for x in (nothing, nothing.astype(np.int32), nothing > 0, nothing > 0, s[i][keep].astype(np.int32), own[keep], bridged[keep], a[i][keep], b[j][keep])]
            yield pa.RecordBatch.from_arrays(columns, names=[*entity, "_chunk", "_ord", "open", "cut", "s", "n", "nb", "a", "b"])

    runs = runs.where("NOT open").unionByName(gathered.mapInArrow(stitch, schema))
    return _result(runs, entity, symbol, position)


def _result(runs: DataFrame, entity: list[str], symbol: str, position: str) -> DataFrame:
    named = {"s": symbol, "n": "n_events", "nb": "n_bridged", "a": f"start_{position}", "b": f"stop_{position}"}
    return runs.select(*entity, *(F.col(c).alias(to) for c, to in named.items()), (F.col("b") - F.col("a") + 1).alias("extent"))
