"""Typed rows and located errors from raw lines, by an error-recovering recursive-descent grammar.

    line   := skip? (blank | comment | record)
    record := field (sep field)* sep?
    field  := quoted | bare
    quoted := '"' any-but-quote* '"'  followed by sep or the end
    sep    := (blank | tab | CR)+

Each line is a record-start anchor, so a broken quote never swallows the next line. Within a line the
parser goes on after an error: behind a broken quote it resumes at the next place that validates as
a record's start (a chr followed by a locus name, or by a number), else at the next separator, so that
all errors of the line are located. What stands behind such a start is a record of its own, given beside the failed line. Parsing one line needs no other line: there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed forms of the fields.
CHR = re.compile(r"(?:chr)?(?:[1-9]|1[0-9]|2[0-2]|X)|chrUn_[0-9]{4}")
LOCUS = re.compile(r"(?=.*[0-9])[A-Za-z][A-Za-z0-9_:.\-]{1,23}", re.DOTALL)
NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
POSITION = re.compile(r"[0-9]{1,10}")
ALLELES = frozenset("ACGT0")
MAX_POSITION = 2147483647

_SEP = " \t\r"
_SPACE = re.compile(f"[{_SEP}]+")
_BARE = re.compile(f'[^{_SEP}"]+')
_CLOSE = re.compile(f'"(?=[{_SEP}]|\\Z)')

OUT = (
    "status string, reason string, error_field int, error_col int, n_errors int, errors array<struct<reason:string,field:int,col:int>>,"
    " chr string, locus_name string, gpos double, ppos bigint, c_start bigint, c_end bigint, alleles array<string>,"
    " recovered array<struct<col:int,chr:string,locus_name:string,gpos:double,ppos:bigint,c_start:bigint,c_end:bigint,alleles:array<string>>>"
)
_NAMES = ["status", "reason", "error_field", "error_col", "n_errors", "errors", "chr", "locus_name", "gpos", "ppos", "c_start", "c_end", "alleles", "recovered"]


class LineParser:
    """Parses one line; `errors` holds (reason, field, column), both counted from 0."""

    def __init__(self, text: str):
        self.text, self.at, self.errors = text, 0, []
        self.fields: list[str] = []
        self.starts: list[int] = []
        self.anchors: list[tuple[int, int]] = []  # column of each record start resumed at, and the fields before it

    def fail(self, reason: str, col: int, field: int | None = None) -> None:
        self.errors.append((reason, len(self.fields) if field is None else field, col))

    def skip(self) -> None:
        m = _SPACE.match(self.text, self.at)
        if m:
            self.at = m.end()

    def record(self) -> list[str] | None:
        """The fields, or None for a blank line or a comment."""
        self.skip()
        if self.at == len(self.text) or self.text[self.at] == "#":
            return None
        end = len(self.text)
        while self.at < end:
            start = self.at
            value = self.quoted() if self.text[start] == '"' else self.bare()
            self.starts.append(start)
            self.fields.append(value)
            self.skip()
        return self.fields

    def bare(self) -> str:
        start = self.at
        m = _BARE.match(self.text, start)
        self.at = m.end()
        if self.at < len(self.text) and self.text[self.at] == '"':
            self.fail("quote inside a field", self.at)
            self.recover()
        return self.text[start : self.at]

    def quoted(self) -> str:
        start = self.at
        close = self.text.find('"', start + 1)
        if close < 0:
            self.fail("unclosed quote", start)
            self.recover()
            return self.text[start + 1 : self.at]
        self.at = close + 1
        if not _CLOSE.match(self.text, close):
            self.fail("text behind a closing quote", self.at)
            self.recover()
            return self.text[start + 1 : self.at]
        return self.text[start + 1 : close]

    def recover(self) -> None:
        """To the next validated record start within the line, else to the next separator."""
        for gap in _SPACE.finditer(self.text, self.at):
            first = _BARE.match(self.text, gap.end())
            space = first and _SPACE.match(self.text, first.end())
            second = space and _BARE.match(self.text, space.end())
            if second and CHR.fullmatch(first[0]) and first[0].startswith("chr") and (LOCUS.fullmatch(second[0]) or POSITION.fullmatch(second[0])):
                self.at = gap.start()
                self.anchors.append((gap.end(), len(self.fields) + 1))
                return
        m = _SPACE.search(self.text, self.at)
        self.at = m.start() if m else len(self.text)


def _position(p: LineParser, i: int, what: str) -> int | None:
    s = p.fields[i]
    if POSITION.fullmatch(s) and 1 <= int(s) <= MAX_POSITION:
        return int(s)
    p.fail(f"{what} is no position", p.starts[i], i)
    return None


def _behind_anchors(kind: str | None, n_ind: int | None, p: LineParser) -> list[dict]:
    """The valid records behind the anchors of a failed line, each up to the next anchor."""
    cols = [c for c, _ in p.anchors]
    found = [(c, parse_line(kind, n_ind, p.text[c:e])) for c, e in zip(cols, [*cols[1:], len(p.text)])]
    return [{"col": c, **dict(zip(_NAMES[6:13], values[6:13]))} for c, values in found if values[0] == "valid"]


def parse_line(kind: str | None, n_ind: int | None, line: str | None) -> tuple:
    """The values of `OUT` for one line."""
    if line is None:
        return ("skipped", *[None] * 13)
    p = LineParser(line)
    fields = p.record()
    if fields is None:
        return ("skipped", *[None] * 13)
    chrom = name = gpos = ppos = start = end = alleles = None
    width = 3 if kind == "centromere" else 4 + 2 * n_ind if kind == "tped" and n_ind is not None and n_ind >= 0 else None
    if width is None:
        p.fail("file is not described", 0, 0)
    else:
        if p.anchors:
            fields = fields[: p.anchors[0][1]]
        n = len(fields)
        if n != width:
            p.fail(f"{n} fields instead of {width}", p.starts[min(width, n - 1)], min(width, n))
        if CHR.fullmatch(fields[0]):
            chrom = fields[0] if fields[0].startswith("chr") else "chr" + fields[0]
        else:
            p.fail("chr is unknown", p.starts[0], 0)
        if kind == "centromere":
            start, end = (_position(p, i, what) if n > i else None for i, what in ((1, "start"), (2, "end")))
            if start is not None and end is not None and start >= end:
                p.fail("start is not below end", p.starts[1], 1)
        else:
            name = fields[1] if n > 1 else None
            if n > 1 and not LOCUS.fullmatch(name):
                p.fail("locus name is malformed", p.starts[1], 1)
            if n > 2 and NUMBER.fullmatch(fields[2]):
                gpos = float(fields[2])
            elif n > 2:
                p.fail("gpos is no number", p.starts[2], 2)
            ppos = _position(p, 3, "ppos") if n > 3 else None
            alleles = fields[4:width]
            if not ALLELES.issuperset(alleles):
                for i, a in enumerate(alleles, 4):
                    if a not in ALLELES:
                        p.fail("allele is none of A C G T 0", p.starts[i], i)
    if p.errors:
        r, f, c = p.errors[0]
        return ("failed", r, f, c, len(p.errors), [{"reason": a, "field": b, "col": d} for a, b, d in p.errors], *[None] * 7, _behind_anchors(kind, n_ind, p))
    return ("valid", None, None, None, 0, [], chrom, name, gpos, ppos, start, end, alleles, [])


def _plain(kind: str, rows: DataFrame) -> tuple[Column, DataFrame]:
    """Whether a line is valid beyond doubt, by the forms above and without quotes, and `rows` with their values typed.

    Such a line needs no recovery, so the grammar would give the same; it is spared the way through Python.
    """
    t = F.split(F.regexp_replace("raw_line", f"\\A[{_SEP}]+|[{_SEP}]+\\z", ""), f"[{_SEP}]+")
    rows = rows.withColumn("_t", t)
    shapes = [CHR.pattern, POSITION.pattern, POSITION.pattern] if kind == "centromere" else [CHR.pattern, LOCUS.pattern.replace("(?=.*", f"(?=[^{_SEP}]*"), NUMBER.pattern, POSITION.pattern]
    tail = "" if kind == "centromere" else f"(?:[{_SEP}]+[{''.join(sorted(ALLELES))}])*"
    shape = f"\\A[{_SEP}]*" + f"[{_SEP}]+".join(f"(?:{s})" for s in shapes) + tail + f"[{_SEP}]*\\z"
    width = F.lit(3) if kind == "centromere" else 4 + 2 * F.col("n_ind")
    at = {"c_start": 1, "c_end": 2} if kind == "centromere" else {"ppos": 3}
    ok = F.col("known") & F.col("raw_line").rlike(shape) & (F.size("_t") == width)
    for i in at.values():
        ok = ok & F.get("_t", F.lit(i)).try_cast("bigint").between(1, MAX_POSITION)
    if kind == "centromere":
        ok = ok & (F.get("_t", F.lit(1)).try_cast("bigint") < F.get("_t", F.lit(2)).try_cast("bigint"))
    return F.coalesce(ok, F.lit(False)), rows


def _typed(kind: str, rows: DataFrame) -> DataFrame:
    """Plainly valid lines with the columns of `OUT`."""
    first, t = F.get("_t", F.lit(0)), [F.get("_t", F.lit(i)) for i in range(4)]
    values = {"chr": F.when(first.startswith("chr"), first).otherwise(F.concat(F.lit("chr"), first))}
    if kind == "centromere":
        values |= {"c_start": t[1], "c_end": t[2]}
    else:
        values |= {"locus_name": t[1], "gpos": t[2], "ppos": t[3], "alleles": F.slice("_t", F.lit(5), F.greatest(F.size("_t") - 4, F.lit(0)))}
    values |= {"status": F.lit("valid"), "n_errors": F.lit(0), "errors": F.array(), "recovered": F.array()}
    fields = T._parse_datatype_string(OUT).fields
    return rows.select("file_id", "line_no", "raw_line", *(values.get(f.name, F.lit(None)).try_cast(f.dataType).alias(f.name) for f in fields))


def parse_lines(lines: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """(file_id, line_no, raw_line) with `status` and the typed values or the errors.

    `status` is `valid`, `failed` or `skipped` (blank lines, comments and null lines). Of a failed line
    `reason`, `error_field` and `error_col` locate the first error, `errors` all of them; its typed
    values are null, and `recovered` has the valid records that stand behind its broken quotes, with their columns. `chr` comes out with the prefix `chr`. A line whose `file_id` is null or not in
    `files` as a file of `kind`, or whose file lacks `n_ind` (tped), fails as not described. Of several
    rows of `files` for one id, the one with the largest `n_ind` counts. Further columns of either
    table are ignored; repeated lines each give a row; an empty table gives none.
    """
    about = files.where(F.col("file_kind") == kind).groupBy("file_id").agg(F.max("n_ind").alias("n_ind")).withColumn("known", F.lit(True))
    rows = lines.select("file_id", "line_no", "raw_line").join(about, "file_id", "left")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n_inds = [None if pd.isna(n) else int(n) for n in pdf["n_ind"]]
            got = [parse_line(kind if known is True else None, n, line) for known, n, line in zip(pdf["known"], n_inds, pdf["raw_line"])]
            out = pdf[["file_id", "line_no", "raw_line"]].copy()
            for c, values in zip(_NAMES, zip(*got) if got else [[]] * len(_NAMES)):
                out[c] = pd.Series(values, index=pdf.index, dtype=_DTYPES.get(c, object))
            yield out

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in ("file_id", "line_no", "raw_line"))
    plain, rows = _plain(kind, rows)
    rest = rows.where(~plain).select("file_id", "line_no", "raw_line", "n_ind", "known").mapInPandas(parse, f"{head}, {OUT}")
    return _typed(kind, rows.where(plain)).unionByName(rest)


_DTYPES = {"error_field": "Int32", "error_col": "Int32", "n_errors": "Int32", "gpos": "float64", "ppos": "Int64", "c_start": "Int64", "c_end": "Int64"}


def valid_rows(parsed: DataFrame, kind: str) -> DataFrame:
    """The typed rows of the valid lines."""
    values = ["chr", "c_start", "c_end"] if kind == "centromere" else ["chr", "locus_name", "gpos", "ppos", "alleles"]
    return parsed.where(F.col("status") == "valid").select("file_id", "line_no", *values)


def failed_rows(parsed: DataFrame) -> DataFrame:
    """The failed lines with the first error and all errors."""
    return parsed.where(F.col("status") == "failed").select("file_id", "line_no", "raw_line", "reason", "error_field", "error_col", "errors")


def recovered_rows(parsed: DataFrame, kind: str) -> DataFrame:
    """The typed records behind broken quotes of failed lines, with the column where each starts."""
    values = ["chr", "c_start", "c_end"] if kind == "centromere" else ["chr", "locus_name", "gpos", "ppos", "alleles"]
    return parsed.where("status = 'failed'").select("file_id", "line_no", F.explode("recovered").alias("r")).select("file_id", "line_no", "r.col", *(f"r.{v}" for v in values))
