"""The N best items of every group, by simultaneous bisection of all groups.

A row's rank is an order-preserving code of its score and its identifier: word 0 holds the bits of the score
as a sortable 64-bit integer, the words after it seven bytes each of the identifier, negated so that the
smaller identifier ranks higher; an identifier that has ended ranks above all that go on, the shorter first.
For each group a cutoff is refined on that code: one pass counts the rows above the midpoints of LEVELS
successive halvings at once (the counts of the 2**LEVELS cells those midpoints make), keeps the cell in which
the group reaches N, accepts what lies above it and drops what lies below.  A cell that holds a single code
sends the group on, to the first word in which its identifiers differ.  All groups move in the same pass; a
pass handles only rows that are not decided yet, which after the first are about N a group.

Scale: counts are combined before the shuffle, so a group of any size costs one row a cell and task.
The cutoffs (a row a group) meet the rows in a shuffle join; rows of hot groups are not shuffled
(:func:`tressage.runtime.skew_join`).  No window ever sees more than the cells or the N rows of a group.

Defined results: a null group or item, and a null or NaN score, are no candidates.  A repeated item counts
once, with its highest score.  -0.0 equals 0.0.  A group with fewer than N candidates keeps them all.  An
empty table gives an empty result.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, hot_keys, skew_join

LEVELS = 16
_CHUNK = 7
_MANTISSA = 1 << 52


def sortable_code(x: Column) -> Column:
    """The bits of a double as a long in the order of the doubles; exact, and inside whole-stage codegen."""
    a = F.abs(x)
    e0 = F.floor(F.log2(a))
    m0 = a / F.pow(F.lit(2.0), e0)
    e = F.when(m0 < 1, e0 - 1).when(m0 >= 2, e0 + 1).otherwise(e0)
    frac = (a / F.pow(F.lit(2.0), e) - 1) * float(_MANTISSA)
    normal = (e + 1023).cast("long") * F.lit(_MANTISSA) + frac.cast("long")
    tiny = (a * F.pow(F.lit(2.0), F.lit(1000)) * F.pow(F.lit(2.0), F.lit(74))).cast("long")
    size = F.when(a == 0, F.lit(0)).when(a < 2.2250738585072014e-308, tiny).when(a > 1.7976931348623157e308, F.lit(2047 * _MANTISSA)).otherwise(normal)
    return F.when(x < 0, -size).otherwise(size)


def _word() -> Column:
    part = "substring(encode(_i, 'utf-8'), cast((_w - 1) * 7 + 1 as int), 7)"
    chunk = F.expr(f"-cast(conv(rpad(hex({part}), 14, '0'), 16, 10) as long)")
    length = F.expr("octet_length(_i)")
    return F.when(F.col("_w") == 0, F.col("_c")).when((F.col("_w") - 1) * _CHUNK < length, chunk).otherwise(F.lit(1 << 60) - length.cast("long"))


def _shift(lo: Column, hi: Column) -> Column:
    """The shift that leaves LEVELS bits of what differs between two codes: each bit is one bisection."""
    return F.greatest(F.lit(0), F.length(F.bin(lo.bitwiseXOR(hi))) - LEVELS)


def _common(a: Column, b: Column) -> Column:
    """How many bytes two strings have in common at their start, found by halving."""
    x, y = F.encode(a, "utf-8"), F.encode(b, "utf-8")
    steps = F.array(*[F.lit(1 << k) for k in range(27, -1, -1)])
    most = F.least(F.octet_length(a), F.octet_length(b))
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= most) & (F.substring(x, F.lit(1), n + k) == F.substring(y, F.lit(1), n + k)), n + k).otherwise(n))


def _cutoffs(cells: DataFrame, need: DataFrame | None, n: int) -> DataFrame:
    """From counts by group and cell: the cell in which the group reaches what it needs, and the next cutoff."""
    down = Window.partitionBy("_g").orderBy(F.col("_b").desc())
    cells = cells.join(need.select("_g", "_need"), "_g") if need is not None else cells.withColumn("_need", F.lit(n).cast("long"))
    cells = cells.withColumn("_above", F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    at = F.min_by(F.struct("_n", "_lo", "_hi", (F.col("_need") - F.col("_above")).alias("need"), "_w", "_first", "_last"), "_b")
    cut = cells.where(F.col("_above") < F.col("_need")).groupBy("_g").agg(F.min("_b").alias("_cut"), at.alias("at"))
    one = F.col("at._lo") == F.col("at._hi")
    onward = F.when(F.col("at._w") == 0, F.lit(1)).otherwise(F.greatest(F.col("at._w"), F.floor(_common(F.col("at._first"), F.col("at._last")) / _CHUNK).cast("int")) + 1)
    return cut.select(
        "_g", "_cut", F.col("at.need").alias("_need"), (F.col("at._n") <= F.col("at.need")).alias("_all"),
        F.when(one, onward).otherwise(F.col("at._w")).alias("_w2"), F.when(one, F.lit(56 - LEVELS)).otherwise(_shift(F.col("at._lo"), F.col("at._hi"))).alias("_s2"))


def _count_cells(rows: DataFrame, identifiers: bool) -> DataFrame:
    """Counts by group and cell; the first and last identifier too where scores no longer decide (few rows)."""
    code = _word()
    ends = [F.min("_i").alias("_first"), F.max("_i").alias("_last")] if identifiers else []
    cells = rows.select("_g", "_w", "_i", code.alias("_k"), _sr(code, F.col("_s")).alias("_b")).groupBy("_g", "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"), F.max("_w").alias("_w"), *ends)
    return cells if identifiers else cells.withColumns({"_first": F.lit(""), "_last": F.lit("")})


def _sr(x: Column, s: Column) -> Column:
    return F.call_function("shiftright", x, s.cast("int"))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """Columns ``group``, ``rank_no`` int, ``item``, ``score``: the first ``n`` items of each group."""
    scratch = scratch or Scratch(df.sparkSession, "topn")
    score_col = F.col(f"`{score}`").cast("double")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(F.col(f"`{group}`").alias("_g"), F.col(f"`{item}`").cast("string").alias("_i"), (score_col + 0.0).alias("_v"))
    rows = rows.where(F.col("_g").isNotNull() & F.col("_i").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.groupBy("_g", "_i").agg(F.max("_v").alias("_v"))
    rows = scratch.write(rows.select("_g", "_i", "_v", sortable_code(F.col("_v")).alias("_c")), "best")

    low, high, total = rows.agg(F.min("_c"), F.max("_c"), F.count(F.lit(1))).first()
    start = 0 if low is None else max(0, (64 if (low < 0) != (high < 0) else (low ^ high).bit_length()) - LEVELS)
    undecided = rows.withColumns({"_w": F.lit(0), "_s": F.lit(start)})
    state, hot, taken, last = None, None, [], None
    while True:
        cells = _count_cells(undecided, state is not None)
        if state is None:
            cells = scratch.write(cells, "cells")
            sizes = cells.groupBy("_g").agg(F.sum("_n").alias("_size"))
            found = scratch.write(hot_keys(sizes, ["_g"], "_size", total), "hot")
            hot = found if found.head(1) else None
        state = scratch.write(_cutoffs(cells, state, n), "cutoffs")
        met = skew_join(undecided, state.select("_g", "_cut", "_all", "_w2", "_s2"), ["_g"], hot)
        cell = _sr(_word(), F.col("_s"))
        kept = met.where(cell >= F.col("_cut")).select(
            "_g", "_i", "_v", "_c", ((cell > F.col("_cut")) | F.col("_all")).alias("_in"), F.col("_w2").alias("_w"), F.col("_s2").alias("_s"))
        kept = scratch.write(kept, "kept")
        taken.append(kept.where("_in").select("_g", "_i", "_v"))
        if last is not None and not last.where("_in").head(1):
            scratch.drop(last)
            taken.pop(-2)
        last = kept
        undecided = kept.where("not _in").drop("_in")
        if not undecided.head(1):
            break
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    by = Window.partitionBy("_g").orderBy(F.col("_v").desc(), F.col("_i"))
    return out.select(
        F.col("_g").alias(group), F.row_number().over(by).alias("rank_no"), F.col("_i").cast(kinds[item]).alias(item), F.col("_v").alias(score))
