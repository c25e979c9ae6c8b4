"""Documents that contain passages of held-out test items, found by one Aho-Corasick automaton.

Words of normalised text are the alphabet: each word of the test items gets one character, every
other word the same filler, so a text becomes a short string that the automaton scans once. Its
patterns are all runs of `n` words of each passage (with the answer behind it, where asked for), and the
whole of it if it is shorter. Only the items travel to the tasks, which build the automaton; the texts are neither shuffled nor copied. Its
size is bounded: where the items have more patterns than `max_patterns`, they are dealt to several
blocks of that size, each scanned over all texts.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_WORD = re.compile(r"[^\W_]+")
_ASCII = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}
_ASCII_TABLE = str.maketrans(_ASCII)
_FILLER = "\0"
_LIMIT = 0x10FFFF - 0xE000  # distinct words that fit behind the surrogates


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the NFKC form in lower case."""
    if text.isascii():
        return text.translate(_ASCII_TABLE).split()
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """First and last + 1 code point in `text` of each of its `words`.

    Text that normalising leaves in place is searched as it is. Other text is cut where neighbours don't combine
    under NFKC, and each cut piece's characters map to it.
    """
    low = text.lower()
    if len(low) == len(text) and (text.isascii() or unicodedata.is_normalized("NFKC", text)):
        return [m.span() for m in _WORD.finditer(low)]
    pieces: list[int] = []  # the origin of each normalised character: index into bounds
    bounds: list[tuple[int, int]] = []
    out: list[str] = []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (ord(text[j]) > 0x2FF or ord(text[j - 1]) > 0x2FF):
            if unicodedata.combining(text[j]) == 0:  # a run of marks is passed over in one go
                form, behind = unicodedata.normalize("NFKC", text[i:j]), unicodedata.normalize("NFKC", text[j])
                if unicodedata.normalize("NFKC", text[i : j + 1]) == form + behind:
                    break
            j += 1
        low = unicodedata.normalize("NFKC", text[i:j]).lower()
        bounds.append((i, j))
        pieces += [len(bounds) - 1] * len(low)
        out.append(low)
        i = j
    return [(bounds[pieces[m.start()]][0], bounds[pieces[m.end() - 1]][1]) for m in _WORD.finditer("".join(out))]


class Automaton:
    """Patterns of many items over a common vocabulary; built once per Python worker and kept."""

    _kept: dict[str, "Automaton"] = {}

    def __init__(self, patterns: list[tuple[list[str], list[int]]]):
        import ahocorasick

        self.codes: dict[str, str] = {}
        for ws, _ in patterns:
            for w in ws:
                self.codes.setdefault(w, chr(0xE000 + len(self.codes)))
        if len(self.codes) > _LIMIT:
            raise ValueError("too many distinct words in one block of patterns")
        self.items = [ids for _, ids in patterns]
        self.sizes = [len(ws) for ws, _ in patterns]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, (ws, _) in enumerate(patterns):
            self.automaton.add_word("".join(self.codes[w] for w in ws), i)
        self.automaton.make_automaton()

    @classmethod
    def of(cls, key: str, shared: Broadcast) -> "Automaton":
        """The automaton of the broadcast items; a worker keeps the last one, under `key`."""
        if key not in cls._kept:
            items, n = shared.value
            cls._kept = {key: cls(item_patterns(items, n))}
        return cls._kept[key]

    def scan(self, text: str) -> dict[int, list[int]]:
        """Per item: its number of matches, the index of the first match's first word and the last match's last word."""
        ws = words(text)
        get = self.codes.get
        string = "".join([get(w, _FILLER) for w in ws])
        found: dict[int, list[int]] = {}
        for end, i in self.automaton.iter(string):
            start = end - self.sizes[i] + 1
            for item in self.items[i]:
                f = found.get(item)
                if f is None:
                    found[item] = [1, start, end]
                else:
                    f[0] += 1
                    f[1] = min(f[1], start)
                    f[2] = max(f[2], end)
        return found


def item_patterns(items: list[tuple[int, str | None]], n: int) -> list[tuple[list[str], list[int]]]:
    """Distinct word sequences with the ids of the items they betray; items without a word betray nothing."""
    patterns: dict[tuple[str, ...], dict[int, None]] = {}
    for item, text in items:
        ws = words(text or "")
        if not ws:
            continue
        grams = {tuple(ws)} if len(ws) < n else {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for g in grams:
            patterns.setdefault(g, {})[item] = None
    return [(list(g), list(ids)) for g, ids in patterns.items()]


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage",
    answer: str | None = None, n: int = 13, max_patterns: int = 500_000, max_item_chars: int = 200_000_000,
) -> DataFrame:
    """(doc_id, item_id, n_matches, leak_start, leak_end): each document with each item that it leaks.

    A document leaks an item if `n` consecutive words of it are consecutive in the item's passage, or the
    whole passage where that has fewer words. With `answer`, the passage followed by that column's
    text is searched for likewise. `leak_start` and `leak_end` are code points of the original text: from the first
    matching word to behind the last. Documents and items with null ids are left out; null, empty and
    wordless texts and passages leak nothing; repeated items count once. A repeated document row gives
    its rows again. Further columns are ignored, empty tables give no rows.

    The items, the held-out tests, are gathered at the driver; their total length is checked
    against `max_item_chars` first.
    """
    spark = documents.sparkSession
    said = F.col(passage) if answer is None else F.concat_ws(" ", F.col(passage), F.col(answer))
    held = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), said.alias("p")).distinct()
    size = held.agg(F.sum(F.length("p"))).first()[0] or 0
    if size > max_item_chars:
        raise ValueError(f"test items of {size} characters; at most {max_item_chars} are gathered at the driver")
    types = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"{doc_id} {types[0]}, {item_id} {types[1]}, n_matches int, leak_start int, leak_end int"
    rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id), F.col(text))

    def block(part: list) -> DataFrame:
        shared, key = spark.sparkContext.broadcast((part, n)), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton.of(key, shared)
            for batch in batches:
                out: tuple[list, ...] = ([], [], [], [], [])
                ids, texts = batch.column(0), batch.column(1)
                for k in range(batch.num_rows):
                    t = texts[k].as_py()
                    if not t or not automaton.items:
                        continue
                    found = automaton.scan(t)
                    if found:
                        spans = word_spans(t)
                        for item, (m, a, b) in found.items():
                            for to, v in zip(out, (k, item, m, spans[a][0], spans[b][1])):
                                to.append(v)
                at = pa.array(out[0], type=pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(out[1], type=item_type), *(pa.array(v, type=pa.int32()) for v in out[2:])], names=[doc_id, item_id, "n_matches", "leak_start", "leak_end"])

        return rows.mapInArrow(scan, schema)

    item_type = to_arrow_type(items.schema[item_id].dataType)
    found, part, size, last = None, [], 0, None
    for r in held.orderBy("i", "p").toLocalIterator():  # one block at a time; all passages of an item are in one block
        more = max(1, len((r["p"] or "").split()) - n + 1)
        if part and size + more > max_patterns and r["i"] != last:
            found = block(part) if found is None else found.unionByName(block(part))
            part, size = [], 0
        part.append((r["i"], r["p"]))
        size, last = size + more, r["i"]
    rest = block(part)
    return rest if found is None else found.unionByName(rest)
