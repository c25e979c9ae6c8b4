"""Statistics of a text's make-up, and a verdict whether it is natural prose.

One pass over the texts, batch by batch in Arrow; nothing is shuffled. Characters are classed by
deleting the known ones from the UTF-8 bytes, and words are counted once per distinct word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACES = bytes(i for i in range(128) if chr(i).isspace())
_ALNUM = bytes(i for i in range(128) if chr(i).isalnum())
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_BLANK_LINES = re.compile(r"\n\s*\n")
_BULLET = re.compile(r"(?:[-*+•◦‣]|\(?[0-9]{1,3}[.)]|[a-z][.)])\s")

#: Bounds of the verdict's first part, as stated for the project.
LEAST_WORDS, WORD_LENGTH, MOST_SYMBOLS, LEAST_ENDED, COMMON = 12, (2.5, 15.0), 0.40, 0.03, (0.08, 0.70)
#: Bounds on repetition: share of repeated lines and paragraphs, and characters in the commonest 2-, 3- and 4-gram.
MOST_DUP_LINES, MOST_DUP_PARAGRAPHS, MOST_TOP_GRAM = 0.30, 0.30, (0.20, 0.18, 0.16)
#: A list or a table by the share of its lines that look like one.
LIST_LINES, TABLE_LINES = 0.6, 0.6

_STATS = (
    ("n_words", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("n_lines", pa.int64()), ("ended_share", pa.float64()), ("common_share", pa.float64()),
    ("dup_line_share", pa.float64()), ("dup_line_chars", pa.float64()), ("dup_paragraph_share", pa.float64()),
    ("top_2gram_chars", pa.float64()), ("top_3gram_chars", pa.float64()), ("top_4gram_chars", pa.float64()), ("list_line_share", pa.float64()), ("table_line_share", pa.float64()),
    ("is_degenerate", pa.bool_()), ("verdict", pa.string()),
)
STATS = ", ".join(f"{c} {'string' if t == pa.string() else 'boolean' if t == pa.bool_() else 'bigint' if t == pa.int64() else 'double'}" for c, t in _STATS)


def symbols(text: str) -> int:
    """Non-whitespace characters that are no Unicode letter or number."""
    rest = text.encode("utf-8", "surrogatepass").translate(None, _SPACES + _ALNUM)
    if rest.isascii():
        return len(rest)
    return sum(n for c, n in Counter(rest.decode("utf-8", "surrogatepass")).items() if not c.isspace() and unicodedata.category(c)[0] not in "LN")


def _duplicates(parts: list[str]) -> tuple[float, float]:
    """Share of the parts, and of their characters, that repeat an earlier one."""
    if not parts:
        return 0.0, 0.0
    seen = Counter(parts)
    chars = sum(map(len, parts))
    return 1 - len(seen) / len(parts), sum((n - 1) * len(p) for p, n in seen.items()) / chars if chars else 0.0


def _top_gram(ws: list[str], n: int, chars: int) -> float:
    """Share of the words' characters in the commonest n-gram that occurs twice; of equals, the longest."""
    if len(ws) <= n:
        return 0.0
    grams = Counter(zip(*(ws[i:] for i in range(n))))
    most = max(grams.values())
    if most < 2:
        return 0.0
    return min(1.0, max(sum(map(len, g)) for g, c in grams.items() if c == most) * most / chars)


class Judge:
    """Statistics of texts against a set of common words."""

    def __init__(self, common: frozenset[str]):
        self.common = common
        self.known: dict[str, bool] = {}

    def is_common(self, word: str) -> bool:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[word] = _EDGES.sub("", word.lower()) in self.common
        return got

    def measure(self, text: str) -> tuple:
        ws = text.split()
        n = len(ws)
        chars = sum(map(len, ws))
        symbol_ratio = symbols(text) / chars if chars else 0.0
        lines = [x for x in map(str.strip, text.split("\n")) if x]
        ended = sum(x[-1] in ".!?" for x in lines) / len(lines) if lines else 0.0
        common = sum(c for w, c in Counter(ws).items() if self.is_common(w)) / n if n else 0.0
        mean = chars / n if n else 0.0
        dup_lines, dup_chars = _duplicates(lines)
        dup_paragraphs, _ = _duplicates([p for p in map(str.strip, _BLANK_LINES.split(text)) if p])
        grams = tuple(_top_gram(ws, k, chars) for k in (2, 3, 4))
        bullets = sum(bool(_BULLET.match(x)) for x in lines) / len(lines) if lines else 0.0
        cells = sum(x.count("|") >= 2 or x.count("\t") >= 2 or x.count(",") >= 4 for x in lines) / len(lines) if lines else 0.0
        degenerate = n < LEAST_WORDS or not WORD_LENGTH[0] <= mean <= WORD_LENGTH[1] or symbol_ratio > MOST_SYMBOLS or ended < LEAST_ENDED or not COMMON[0] <= common <= COMMON[1]
        if n < LEAST_WORDS:
            verdict = "near-empty"
        elif cells > TABLE_LINES:
            verdict = "table"
        elif bullets > LIST_LINES:
            verdict = "list"
        elif degenerate:
            verdict = "junk"
        elif dup_lines > MOST_DUP_LINES or dup_paragraphs > MOST_DUP_PARAGRAPHS or any(a > b for a, b in zip(grams, MOST_TOP_GRAM)):
            verdict = "boilerplate"
        else:
            verdict = "prose"
        return (n, mean, symbol_ratio, len(lines), ended, common, dup_lines, dup_chars, dup_paragraphs, *grams, bullets, cells, degenerate, verdict)


def text_quality(documents: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text", max_common: int = 1_000_000) -> DataFrame:
    """One row per document: its id and the statistics of `STATS`.

    Words are runs of non-whitespace and lengths code points. `symbol_ratio` is over the non-whitespace
    characters, `ended_share` over the non-blank lines (split at LF, whitespace at the end ignored)
    that end in `.`, `!` or `?`. `common_share` counts words that are in `common_words`, in any language,
    once in lower case and with all but letters and numbers cut from both ends. `is_degenerate` tells
    that one of the project's bounds is broken; `verdict` is prose, list, table, boilerplate, junk or
    near-empty. An empty or blank text has 0 in every statistic and is near-empty. A null text has null
    statistics and the verdict null. Null ids pass through, repeated rows each give a row, further
    columns are ignored.
    """
    words = common_words.where(F.col("word").isNotNull()).select("word").distinct().limit(max_common + 1).collect()
    if len(words) > max_common:
        raise ValueError(f"more than {max_common} common words")
    shared = documents.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in words))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = Judge(shared.value)
        nothing = (None,) * len(_STATS)
        for batch in batches:
            texts = batch.column(1)
            got = [nothing if (t := texts[k].as_py()) is None else j.measure(t) for k in range(batch.num_rows)]
            columns = zip(*got) if got else [()] * len(_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, (_, t) in zip(columns, _STATS))], names=[doc_id, *(c for c, _ in _STATS)])

    id_type = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(judge, f"{doc_id} {id_type}, {STATS}")
