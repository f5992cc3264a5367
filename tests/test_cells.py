import re
import sys
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tressage.operators import cells
from tressage.operators.cells import UNCLOSED_BRACKET, UNCLOSED_QUOTE, parse_cell, split_cells

#: Every character that is white space to the standard library, less those that end or move a line.
UNICODE_BLANKS = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace() and chr(i) not in "\t\n\r\x0b\x0c"]


def items(cell):
    return [p.item for p in parse_cell(cell)]


def test_alternatives_in_order():
    assert items("53;61") == ["53", "61"]
    assert items('["44", null, "53"]') == ["44", None, "53"]
    assert items("['72', None, '14']") == ["72", None, "14"]
    assert items("{50,75}") == ["50", "75"]
    assert items("« 44 »,« 2A/2B »") == ["44", "2A/2B"]
    assert items('"Marché dit ""global""", "TRAVAUX"') == ['Marché dit "global"', "TRAVAUX"]
    assert items("'Études / maîtrise d'œuvre' ; 'X'") == ["Études / maîtrise d'œuvre", "X"]
    assert items("29, 29, 22 et 56") == ["29", "29", "22", "56"]
    assert items("Conception-réalisation - SERVICES") == ["Conception-réalisation", "SERVICES"]
    assert items("SERVICES -  - TRAVAUX-") == ["SERVICES", None, "TRAVAUX", None]


def test_empty_places_keep_positions():
    assert items("49 ;  ; 974") == ["49", None, "974"]
    assert items("61,44,") == ["61", "44", None]
    assert items(",44,50") == [None, "44", "50"]
    assert items("53, , 50") == ["53", None, "50"]


def test_empty_cells():
    for cell in (None, "", "  ", " ", "[]", "{}", "[ ]"):
        assert items(cell) == []


def test_malformed_quotes_and_brackets_backtrack():
    p = parse_cell('"a;b')
    assert [x.item for x in p] == ["a", "b"] and p[0].flags == UNCLOSED_QUOTE
    p = parse_cell("[1,2")
    assert all(x.flags == UNCLOSED_BRACKET for x in p) and len(p) == 2


def test_long_cell():
    assert len(items(";".join(["x"] * 20_000))) == 20_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc ;,|/\"'", min_size=0, max_size=8), min_size=2, max_size=6))
def test_quoted_lists_round_trip(values):
    cell = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    assert items(cell) == [v.strip() or None for v in values]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_never_fails(cell):
    parse_cell(cell)


def test_split_cells(spark):
    rows = [("a", "1;2", "x"), ("a", "1;2", "x"), ("b", None, '"p, q","r"'), ("c", "7", "s"), (None, "1;2", "t"), ("d", "", "[]")]
    df = spark.createDataFrame(rows, "k string, f string, flags string").selectExpr("*", "1 as item", "2 as _key")
    got = sorted(map(tuple, split_cells(df, "k", ["f", "flags"]).drop("flags").collect()))
    assert got == [("a", "f", 1, "1"), ("a", "f", 2, "2"), ("b", "flags", 1, "p, q"), ("b", "flags", 2, "r")]
    assert split_cells(df.limit(0), "k", ["f", "flags"]).count() == 0
    singles = split_cells(df, "k", ["f"], several_only=False)
    assert ("c", "f", 1, "7") in [tuple(r)[:4] for r in singles.collect()]


def test_every_unicode_blank_sets_a_word_off(spark):
    assert set(UNICODE_BLANKS) < set(cells.BLANKS) and len(UNICODE_BLANKS) > 20
    rows = [(f"{ord(b):x}{w}", f"44{b}{w}{b}35") for b in cells.BLANKS for w in (*cells.WORDS, *cells.DASHES)]
    for _, cell in rows:
        assert items(cell) == ["44", "35"], ascii(cell)
    got = split_cells(spark.createDataFrame(rows, "k string, f string"), "k", ["f"])
    assert got.count() == 2 * len(rows)


@pytest.mark.parametrize("run", [" ", "\u00a0", "\t", "\x0b", " \x0b", "- ", "\u3000\u200b"])
def test_runs_of_white_space_are_linear(run):
    def seconds(n):
        cell, began = "a" + run * n + "b", time.perf_counter()
        parse_cell.__wrapped__(cell)
        return time.perf_counter() - began

    assert seconds(100_000) < 20 * max(seconds(10_000), 0.02)
    if run in (" ", "\u00a0"):
        assert min(seconds(100_000) for _ in range(3)) < 0.1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["et", " ", "\u00a0", "\u202f", "\t", "\x0b", "a", "é", ",", "/", "-", '"', "'", "[", "]", "{", "}", "&", "\r\n", "ET"]), max_size=14).map("".join))
def test_nothing_that_splits_is_filtered(cell):
    if sum(p.item is not None for p in parse_cell(cell)) > 1:
        assert re.search(cells._MAY_SPLIT, cell)
