"""Several values in one cell: a parsing expression grammar that splits a cell and keeps positions.

Grammar (ordered alternatives; the first that succeeds wins, a failure backtracks to the next)::

    cell    <- ws ( bracket / list ) ws !.
    bracket <- '[' items? ']' / '{' items? '}'          items <- place (ws [,;|] ws place)*
    list    <- place (sep place)*                       sep   <- ws [marks] ws / tab / newline / blank word &blank
    place   <- quoted / bare / empty
    quoted  <- '"' ('""' / '\\"' / !'"' .)* '"' &end    and the same with ' and with guillemets
    bare    <- (!sep .)+                                end   <- ws (sep / closing bracket / end of cell)

A quote that is not closed before an ``end`` does not match ``quoted``; the parser backtracks, reads the
place as bare and flags it.  A bracket that does not close, or whose items do not parse, is read as a list and
flagged.  Inside brackets a bare ``null``, ``None`` or nothing is an empty place.

Defined results: a null, empty or blank cell has no places.  Empty places count in the positions and carry a
null item.  A cell may be of any length; parsing is linear in it, runs of white space included, apart from
backtracked quotes, each of which reads on to the end once.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import python_rows

#: White space: every character Unicode calls so, with the invisible ones that surround values in practice.
WS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0x2060, 0xFEFF)))
LINES = "\t\n\r"
#: White space within a line: what sets a separating word or dash off from the values beside it.
BLANKS = "".join(c for c in WS if c not in LINES + "\x0b\x0c")
#: The delimiters of a list: marks, and words and dashes between blanks; of a bracketed list: marks.
MARKS, ITEM_MARKS = ",;|/；、，", ",;|；"
WORDS, DASHES = ("et", "ET", "Et", "&", "•"), "-–—"
#: Flags of a place.
UNCLOSED_QUOTE, UNCLOSED_BRACKET = 1, 2

_ws = re.compile(f"[{WS}]*+")
_words = "|".join(map(re.escape, WORDS))
_line_or_word = re.compile(f"[{BLANKS}]*+(?:\r\n|[{LINES}])|[{BLANKS}]++(?:{_words}|[{re.escape(DASHES)}])(?=[{BLANKS}]|$)")
_last_dash = re.compile(f"[{re.escape(DASHES)}][{WS}]*+$")
_after_no_blank = re.compile("(?<=[\x0b\x0c])")
_quotes = {'"': '"', "'": "'", "«": "»", "“": "”", "‘": "’"}
_open_close = {"[": "]", "{": "}"}
_nothing = {"", "null", "None", "NULL"}
#: What a cell with more than one value holds at least, from the grammar's own separators; others never reach the parser.
_MAY_SPLIT = f"[{re.escape(MARKS + ITEM_MARKS + LINES + DASHES)}]|[{BLANKS}](?:{_words})(?:[{BLANKS}]|$)"


class Place(NamedTuple):
    item: str | None
    flags: int


def _strip(s: str) -> str:
    return s.strip(WS)


class _Separators:
    """The separators of one cell.  A run of white space is read once, however many places ask for it."""

    def __init__(self, s: str, marks: str, bare: bool):
        self.s, self.marks, self.bare, self.run = s, marks, bare, (0, 0)

    def run_end(self, at: int) -> int:
        if not self.run[0] <= at < self.run[1]:
            self.run = (at, _ws.match(self.s, at).end())
        return self.run[1]

    def end(self, at: int) -> int:
        """Where the separator that begins at ``at`` ends; -1 if there is none."""
        s = self.s
        e = self.run_end(at)
        if s[e : e + 1] in self.marks and e < len(s):
            return _ws.match(s, e + 1).end()
        if self.bare:
            m = _line_or_word.match(s, at) if e > at else _last_dash.match(s, at)
            if m:
                return m.end()
        return -1

    def bare_end(self, at: int, closing: str) -> int:
        """Where a bare value that begins at ``at`` ends.  Inside a run of white space at whose beginning no separator
        begins, one can only begin after a character that is no blank."""
        s, n = self.s, len(self.s)
        while at < n and not (closing and s[at] == closing) and self.end(at) < 0:
            e = self.run_end(at)
            if self.bare and e > at + 1:
                for m in _after_no_blank.finditer(s, at + 1, e):
                    if _line_or_word.match(s, m.end()):
                        return m.end()
            at = max(e, at + 1)
        return at


def _quoted(s: str, at: int, sep: _Separators, closing: str) -> tuple[str, int] | None:
    """``quoted``: the value and where it ends, or None."""
    close = _quotes.get(s[at] if at < len(s) else "")
    if not close:
        return None
    i, out, n = at + 1, [], len(s)
    while i < n:
        c = s[i]
        if c == close:
            if close in "\"'" and s.startswith(close, i + 1):
                out.append(close)
                i += 2
                continue
            after = _ws.match(s, i + 1).end()
            if after == n or s[after] == closing or sep.end(i + 1) >= 0:
                return _strip("".join(out)), i + 1
        elif c == "\\" and i + 1 < n and s[i + 1] in ("\\", close):
            i += 1
            c = s[i]
        out.append(c)
        i += 1
    return None


def _places(s: str, at: int, sep: _Separators, closing: str) -> tuple[list[Place], int] | None:
    """``place (sep place)*`` up to ``closing`` or the end of the cell."""
    out: list[Place] = []
    n = len(s)
    while True:
        if sep.end(at) < 0:
            at = _ws.match(s, at).end()
        got = _quoted(s, at, sep, closing)
        if got:
            item, at = got
            out.append(Place(item or None, 0))
        else:
            begin = at
            at = sep.bare_end(at, closing)
            text = _strip(s[begin:at])
            broken = text[:1] in _quotes
            if broken:
                text = _strip(text.strip("\"'\u00ab\u00bb\u201c\u201d\u2018\u2019"))
            out.append(Place(None if text in _nothing else text, UNCLOSED_QUOTE * broken))
        if (end := sep.end(at)) >= 0:
            at = end
            continue
        at = _ws.match(s, at).end()
        if closing and at < n and s[at] == closing:
            return out, at + 1
        if at == n:
            return None if closing else (out, at)
        if closing:
            return None


def _bracket(s: str, at: int) -> list[Place] | None:
    close = _open_close.get(s[at])
    if not close:
        return None
    end = _ws.match(s, at + 1).end()
    if s.startswith(close, end):
        got: tuple[list[Place], int] | None = ([], end + 1)
    else:
        got = _places(s, at + 1, _Separators(s, ITEM_MARKS, False), close)
    return got[0] if got and _ws.match(s, got[1]).end() == len(s) else None


@lru_cache(maxsize=100_000)
def parse_cell(cell: str | None) -> tuple[Place, ...]:
    """The places of a cell in order."""
    s = _strip(cell or "")
    if not s:
        return ()
    got = _bracket(s, 0)
    if got is not None:
        return tuple(got)
    flag = UNCLOSED_BRACKET if s[0] in _open_close else 0
    found = _places(s, 0, _Separators(s, MARKS, True), "")[0]
    return tuple(Place(p.item, p.flags | flag) for p in found)


def split_cells(df: DataFrame, key: str, fields: list[str], several_only: bool = True) -> DataFrame:
    """(key, field_name, item_ord, item, flags): a row for each value of each cell of ``fields``.

    One row set a key: rows of a repeated key are merged first, on the largest cell, so every delivery of the
    same cell counts once.  ``several_only`` keeps the cells that hold more than one value.  Null keys are dropped.
    Only the key and the fields are read; what cannot split is filtered before Python sees it.
    """
    cells = df.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(fields)])
    cells = cells.where(F.col("_key").isNotNull())
    if several_only:
        cells = cells.select("_key", *[F.when(F.col(f"c{i}").rlike(_MAY_SPLIT), F.col(f"c{i}")).alias(f"c{i}") for i in range(len(fields))])
        cells = cells.where(F.coalesce(*[F.col(f"c{i}") for i in range(len(fields))]).isNotNull())
    kind = dict(df.dtypes)[key]
    cells = cells.groupBy("_key").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(fields))])
    least = 2 if several_only else 1
    names = list(fields)

    def kernel(cols):
        keys, field, ords, items, flags = [], [], [], [], []
        for i, name in enumerate(names):
            for k, cell in zip(cols["_key"], cols[f"c{i}"]):
                if cell is None:
                    continue
                places = parse_cell(cell)
                if sum(p.item is not None for p in places) < least:
                    continue
                for at, p in enumerate(places, 1):
                    if p.item is not None:
                        keys.append(k), field.append(name), ords.append(at), items.append(p.item), flags.append(p.flags)
        return {key: keys, "field_name": field, "item_ord": ords, "item": items, "flags": flags}

    return python_rows(cells, kernel, f"`{key}` {kind}, field_name string, item_ord int, item string, flags int")
