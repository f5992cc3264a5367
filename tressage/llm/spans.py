"""Long exact spans shared between records: hashes of every window, counted, merged into intervals.

A span of at least ``length`` characters that recurs consists of windows of ``length`` that recur, and the
windows of a record that recur elsewhere, merged, are the maximal intervals.  Tokens are characters (Unicode code
points, exactly as stored), so no boundary is missed.  Steps:

1. *Anchors.*  Every window has an anchor: among the hashes of its sub-windows of two thirds its length the
   smallest, the leftmost on ties.  Equal windows have equal anchors, and neighbours mostly the same, so a record has
   one anchor in about ``length / 6`` characters.  Anchors are counted over records; a window whose anchor occurs in
   one record cannot recur.  This drops most windows before they are shuffled, and loses none.
2. *Counts.*  The Rabin-Karp hashes (64 bits and 31 of a second hash) of all windows left are counted over records.
3. *Intervals.*  Windows that recur in another record merge into maximal intervals.

Scale: anchors are counted by smallest and largest record, combined before the shuffle.  A window's hash occurs at
most as often as its anchor, so windows whose anchor is not hot form small groups and are compared within one shuffle;
those of hot anchors, as of a passage in a third of all records, are counted with a combining aggregate, and go back to
their rows by :func:`tressage.runtime.skew_join`.

Defined results: null and short texts share nothing; a span repeated only within its record does not count;
copies of a whole record share all of it if they are long enough; records are told apart by ``key``, which must
be unique; null keys are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, hot_keys, skew_join

#: Characters hashed together: short texts end to end, a longer one in blocks that overlap by a window less one.
PIECE = 1 << 16


def _pieces(docs: list, texts: list, extra: list, length: int):
    """(ids, bases, starts, sizes, points, extra) of runs of texts or blocks laid end to end.

    ``bases`` is where a block begins in its text, ``starts`` where it begins in the run; every window lies within one block.
    """
    import numpy as np

    ids, bases, run, more, size = [], [], [], [], 0

    def flush():
        sizes = np.array([len(t) for t in run])
        points = np.frombuffer("".join(run).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return np.array(ids, np.int64), np.array(bases), np.cumsum(sizes) - sizes, sizes, points, more

    for doc, text, x in zip(docs, texts, extra):
        for base in range(0, len(text) - length + 1, PIECE):
            block = text[base : base + PIECE + length - 1]
            if run and size + len(block) > PIECE:
                yield flush()
                ids, bases, run, more, size = [], [], [], [], 0
            ids.append(doc), bases.append(base), run.append(block), more.append(x)
            size += len(block)
    if run:
        yield flush()


def _inside(starts, sizes, length: int):
    """(place, text) of every window of ``length`` that lies within one text, places counted over the whole run."""
    import numpy as np

    n = sizes - length + 1
    text = np.repeat(np.arange(len(sizes)), n)
    return np.arange(len(text)) - np.repeat(np.cumsum(n) - n - starts, n), text


def _anchors(points, length: int):
    """(position, hash) of the anchor of every window of ``length``."""
    import numpy as np

    from .rolling import window_hashes

    part = max(1, length * 2 // 3)
    h = window_hashes(points, part)
    span, n = length - part + 1, len(points) - length + 1
    at = np.empty(n, np.int64)
    for i in range(0, n, 1 << 16):
        j = min(n, i + (1 << 16))
        view = np.lib.stride_tricks.sliding_window_view(h[i : j + span - 1], span)
        at[i:j] = view.argmin(axis=1) + np.arange(i, j)
    return at, h[at]


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for ids, bases, starts, sizes, points, _ in _pieces(docs, texts, docs, length):
                place, text = _inside(starts, sizes, length)
                at, h = _anchors(points, length)
                at, h = at[place], h[place]
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                text, at = text[first], at[first]
                yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(h[first].view(np.int64)), pa.array((at - starts[text] + bases[text]).astype(np.int32))], names=["doc", "h", "at"])

    return rows.mapInArrow(run, "doc long, h long, at int")


def _window_rows(rows: DataFrame, length: int) -> DataFrame:
    """The hashes of the windows whose anchor is among the record's positions ``ats``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .rolling import mix, window_hashes

        for b in batches:
            docs, texts, kept = (b.column(i).to_pylist() for i in range(3))
            for ids, bases, starts, sizes, points, ats in _pieces(docs, texts, kept, length):
                wanted = np.zeros(len(points), bool)
                for a, base, start, size in zip(ats, bases, starts, sizes):
                    a = np.asarray(a, np.int64) - base
                    wanted[a[(a >= 0) & (a < size)] + start] = True
                place, text = _inside(starts, sizes, length)
                at, _ = _anchors(points, length)
                keep = wanted[at[place]]
                place, text = place[keep], text[keep]
                h1 = window_hashes(points, length)[place].view(np.int64)
                h2 = (window_hashes(mix(points + np.uint64(0xABCDEF)), length)[place] >> np.uint64(33)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(h1), pa.array(h2), pa.array((place - starts[text] + bases[text]).astype(np.int32))], names=["doc", "h1", "h2", "at"])

    return rows.mapInArrow(run, "doc long, h1 long, h2 int, at int")


def shared_windows(df: DataFrame, key: str, text: str, length: int = 120, scratch: Scratch | None = None) -> DataFrame:
    """(doc, at) of every window of ``length`` characters that also occurs in another record."""
    scratch = scratch or Scratch(df.sparkSession, "spans")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= length))
    anchors = scratch.write(_anchor_rows(rows, length), "anchors")
    several = anchors.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    several = scratch.write(several.select("h", "n"), "several")
    hot = scratch.write(hot_keys(several, ["h"], "n", anchors.count()), "hot")
    common = bool(hot.head(1))

    def windows(live: DataFrame) -> DataFrame:
        places = live.groupBy("doc").agg(F.collect_list("at").alias("ats"))
        return _window_rows(rows.join(places, "doc").select("doc", "text", "ats"), length)

    rare = several.join(F.broadcast(hot), "h", "left_anti") if common else several
    same = Window.partitionBy("h1", "h2")
    cold = windows(skew_join(anchors, rare.select("h"), ["h"], hot if common else None, "left_semi"))
    found = cold.withColumn("other", F.min("doc").over(same) < F.max("doc").over(same)).where("other").select("doc", "at")
    if common:
        busy = scratch.write(windows(anchors.join(F.broadcast(hot), "h", "left_semi")), "busy")
        again = busy.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
        again = scratch.write(again.select("h1", "h2", "n"), "again")
        top = scratch.write(hot_keys(again, ["h1", "h2"], "n", busy.count()), "hot")
        back = skew_join(busy, again.select("h1", "h2"), ["h1", "h2"], top if top.head(1) else None, "left_semi")
        found = found.unionByName(back.select("doc", "at"))
    return found


def shared_intervals(df: DataFrame, key: str, text: str, length: int = 120, scratch: Scratch | None = None) -> DataFrame:
    """(key, begin, end): the maximal intervals of each record, end exclusive, made of spans that occur elsewhere."""
    found = shared_windows(df, key, text, length, scratch)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column(1)
            at, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            # one number a window, in order of record and place
            place = np.sort(np.repeat(np.arange(len(size), dtype=np.int64) << 32, size) | at)
            first = np.flatnonzero(np.r_[True, place[1:] > place[:-1] + length])[: len(place)]
            last = np.r_[first[1:], len(place)] - 1 if len(first) else first
            at = (place & 0xFFFFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place[first] >> 32)), pa.array(at[first]), pa.array(at[last] + np.int32(length))], names=["doc", "begin", "end"])

    # a record's windows are as many as its characters at most, and merge where they meet
    merged = found.groupBy("doc").agg(F.collect_list("at").alias("ats")).mapInArrow(run, "doc long, begin int, end int")
    return merged.select(F.col("doc").alias(key), "begin", "end")


def shared_chars(df: DataFrame, key: str, text: str, length: int = 120, scratch: Scratch | None = None) -> DataFrame:
    """(key, shared_chars) of each record with a shared span: how many of its characters lie in one."""
    return shared_intervals(df, key, text, length, scratch).groupBy(key).agg(F.sum((F.col("end") - F.col("begin")).cast("long")).alias("shared_chars"))
