"""Evaluation texts that leaked into a corpus, found through templates of their windows.

Words are maximal runs of letters and digits after compatibility decomposition, without combining marks and
invisible format characters, case folded.  A word's template is a typed placeholder where it is a number, a unit or
a name, else the word itself; names are the words that the items write with a capital inside a sentence and never
without.  The template of a window of ``size`` words is hashed; windows of the corpus meet those of the items by a
hash join on template.  What fills the placeholders, the slots, tells the cases apart: equal slots are a leaked
passage; slots that differ by a consistent substitution are a re-parameterised one.

Scale, alike at every size: the items' template hashes go to every task as a bitmap that grows with their number up to
MOST_BITS, so corpus windows whose template no item has are dropped where they are read, but for a small share; the
join decides.  A window travels as hashes (64 bits of template, 128 of words), never as text.  The join is a broadcast
behind a count of the items' windows, beyond it a join that leaves the windows of hot passages in place.  Names go to
the tasks as hashes behind a count, beyond it every text is joined with its own; both give the same placeholders.
Whether a substitution is consistent depends on which slots of the item are equal, so it is decided once for all
items of a template with the same equalities.

Defined results: null texts and texts of fewer than ``size`` words match nothing; a repeated passage counts once a
document and item; null ids are dropped; an empty item table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, hot_keys, skew_join

#: With at most so many names (eight bytes each) every task holds them all.
BROADCAST_NAMES = 4_000_000
#: With at most so many item windows (some 50 bytes each) the join with them is a broadcast.
BROADCAST_ITEMS = 100_000
#: The bitmap of the items' templates: at least 64 bits a window, up to 64 MB.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
NUMBER, UNIT, NAME = "#n", "#u", "#p"
#: Units of money, time and measure as folded words.
UNITS = frozenset("eur euro euros mois jour jours an ans annee annees semaine semaines heure heures unite unites points km m2 kg day days month months year years".split())
_word = re.compile(r"[^\W_]+")
_ends = re.compile(r"[.!?:;\n]")


@lru_cache(1)
def _dropped() -> re.Pattern:
    """Combining marks and format characters, as ranges of one character class."""
    points = [i for i in range(0x300, 0x110000) if unicodedata.category(chr(i)) in ("Mn", "Mc", "Me", "Cf")] + [0xAD]
    parts, begin, last = [], None, None
    for p in sorted(points):
        if last is None or p != last + 1:
            if begin is not None:
                parts.append((begin, last))
            begin = p
        last = p
    parts.append((begin, last))
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in parts) + "]+")


_ASCII = frozenset(map(chr, range(128)))


@lru_cache(100_000)
def _is_dropped(c: str) -> bool:
    return unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf")


def plain(text: str) -> str:
    """The text with compatibility forms resolved, marks and invisible characters gone; case is kept."""
    if text.isascii():
        return text
    t = unicodedata.normalize("NFKD", text)
    gone = [c for c in set(t) - _ASCII if _is_dropped(c)]
    if len(gone) > 20:
        return _dropped().sub("", t)
    for c in gone:
        t = t.replace(c, "")
    return t


def words(text: str | None) -> list[str]:
    return _word.findall(plain(text).casefold()) if text else []


def cases(text: str | None) -> tuple[set[str], set[str]]:
    """Folded words that stand with a capital inside a sentence, and those that stand without one."""
    upper, lower = set(), set()
    t = plain(text or "")
    for m in _word.finditer(t):
        w = m.group()
        if w[:1].islower():
            lower.add(w.casefold())
        elif w[:1].isupper() and (before := t[: m.start()].rstrip()) and not _ends.match(before[-1]):
            upper.add(w.casefold())
    return upper, lower


def placeholder(word: str, is_name) -> str:
    if any(c.isdigit() for c in word):
        return NUMBER
    return UNIT if word in UNITS else NAME if is_name(word) else word


def name_hash(word: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(word, seed=3)
    return h - (1 << 64) if h >> 63 else h


class Names:
    """Membership of words in the sorted hashes of names."""

    def __init__(self, hashes):
        self.hashes = hashes

    def __call__(self, word: str) -> bool:
        h = name_hash(word)
        i = int(self.hashes.searchsorted(h))
        return i < len(self.hashes) and int(self.hashes[i]) == h


class Windows:
    """Of a text of n windows: ``th``, ``wh`` and ``wh2``, the hashes of their templates and words, and their slots."""

    def __init__(self, size: int, hashes, slot):
        import numpy as np

        from .rolling import window_hashes

        self.size, self.own, self.slot = size, hashes[1], slot
        self.th = window_hashes(hashes[0], size).view(np.int64)
        self._both = hashes[1:]

    def words(self, at):
        """The two hashes of the words of the windows at ``at``."""
        import numpy as np

        from .rolling import window_hashes

        return [window_hashes(h, self.size).view(np.int64)[at] for h in self._both]

    def slotted(self):
        """Which windows have slots."""
        import numpy as np

        n = np.concatenate([[0], np.cumsum(self.slot)])
        return n[self.size :] > n[: len(n) - self.size]

    def slots(self, at: int) -> list[int]:
        """The hashes of the words in the slots of a window, in order."""
        import numpy as np

        k = slice(at, at + self.size)
        return self.own[k][self.slot[k]].view(np.int64).tolist()


class Templates:
    """Hashes of the template and of the words of every window of ``size`` words."""

    def __init__(self, size: int, is_name):
        import numpy as np

        self.size, self.is_name = size, is_name
        self.known: dict[str, int] = {}
        self.hashes = np.empty((3, 1 << 12), np.uint64)
        self.slot = np.empty(1 << 12, bool)

    def _number(self, w: str) -> int:
        """The number of a new word, whose hashes are kept under it."""
        import numpy as np
        import xxhash

        n = len(self.known)
        if n == len(self.slot):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)], axis=1)
            self.slot = np.concatenate([self.slot, np.empty_like(self.slot)])
        kind = placeholder(w, self.is_name)
        self.hashes[0, n] = xxhash.xxh64_intdigest(kind)
        self.hashes[1, n] = xxhash.xxh64_intdigest(w, seed=1)
        self.hashes[2, n] = xxhash.xxh64_intdigest(w, seed=2)
        self.slot[n] = kind != w
        self.known[w] = n
        return n

    def windows(self, text: str | None) -> Windows | None:
        import numpy as np

        ws = words(text)
        if len(ws) < self.size:
            return None
        if len(self.known) > 1_000_000:
            self.known.clear()
        get, add = self.known.get, self._number
        at = np.array([n if (n := get(w)) is not None else add(w) for w in ws])
        return Windows(self.size, self.hashes[:, at], self.slot[at])


def item_names(items: DataFrame, passage: str) -> DataFrame:
    """(w, h): the name words of the items and their hashes, found in parallel."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            up, low = set(), set()
            for text in b.column(0).to_pylist():
                u, w = cases(text)
                up |= u
                low |= w
            ws = sorted(up | low)
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([w not in low for w in ws], pa.bool_()), pa.array([name_hash(w) for w in ws], pa.int64())], names=["w", "n", "h"])

    found = items.select(F.col(f"`{passage}`").cast("string").alias("t")).mapInArrow(run, "w string, n boolean, h long")
    return found.groupBy("w", "h").agg(F.bool_and("n").alias("n")).where("n").select("w", "h")


def _with_names(rows: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (k, t) with ``own``, the hashes of the names in the texts of their key."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = set(words(text))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(ws), pa.int64()), pa.array([name_hash(w) for w in ws], pa.int64())], names=["k", "h"])

    held = scratch.write(rows.mapInArrow(run, "k long, h long").distinct(), "words")
    hot = scratch.write(hot_keys(held.groupBy("h").agg(F.count(F.lit(1)).alias("n")), ["h"], "n", held.count()), "hot")
    own = skew_join(held, names.select("h").distinct(), ["h"], hot if hot.head(1) else None, "left_semi")
    return rows.join(own.groupBy("k").agg(F.sort_array(F.collect_set("h")).alias("own")), "k", "left")


def _bitmap(hashes: DataFrame, n: int):
    """A bit for each template hash, as 64-bit words on the driver: at most MOST_BITS bits whatever the items."""
    import numpy as np

    bits = LEAST_BITS
    while bits < min(64 * n, MOST_BITS):
        bits *= 2
    at = F.col("th").bitwiseAND(F.lit(bits - 1).cast("long"))
    word, bit = F.shiftright(at, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(th & 63 as int))").alias("bit")
    found = hashes.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


class Matcher:
    """The windows of the items, and those of a corpus that may meet them by template."""

    def __init__(self, items: DataFrame, item: str, passage: str, size: int, scratch: Scratch):
        self.size, self.scratch, self.spark = size, scratch, items.sparkSession
        self.names = scratch.write(item_names(items, passage), "names")
        self.sent = None
        if self.names.count() <= BROADCAST_NAMES:
            import numpy as np

            flat = np.sort(self.names.select("h").toPandas()["h"].to_numpy(np.int64))
            self.sent = self.spark.sparkContext.broadcast(flat.tobytes())
        self.items = scratch.write(self._windows(items, item, passage, None, True).withColumnRenamed("k", "item"), "items")
        self.n = self.items.count()
        self.map = self.spark.sparkContext.broadcast(_bitmap(self.items.select("th"), self.n).tobytes())

    def small(self, table: DataFrame) -> DataFrame:
        """A table of at most a row an item window, broadcast behind a count of these."""
        return F.broadcast(table) if self.n <= BROADCAST_ITEMS else table

    def corpus(self, df: DataFrame, key: str, text: str, slots: bool) -> DataFrame:
        """(doc, th, wh, wh2, slots) of the windows whose template is in the bitmap; with ``slots`` those that have any."""
        return self._windows(df, key, text, self.map, slots).withColumnRenamed("k", "doc")

    def _windows(self, df: DataFrame, key: str, text: str, wanted, with_slots: bool) -> DataFrame:
        rows = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).where("k is not null and t is not null")
        sent, size = self.sent, self.size
        if sent is None:
            rows = _with_names(rows, self.names, self.scratch)
        out = "k long, th long, wh long, wh2 long, slots array<long>"

        def run(batches):
            import numpy as np
            import pyarrow as pa

            templates = None if sent is None else Templates(size, Names(np.frombuffer(sent.value, np.int64)))
            bits = None if wanted is None else np.frombuffer(wanted.value, np.uint64)
            for b in batches:
                own = b.column(2).to_pylist() if sent is None else None
                ks, cols, slots = [], [[], [], []], []
                for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    made = templates or Templates(size, Names(np.array(own[i] or [], np.int64)))
                    w = made.windows(t)
                    if w is None:
                        continue
                    at = np.arange(len(w.th))
                    if bits is not None:
                        h = w.th.view(np.uint64) & np.uint64(64 * len(bits) - 1)
                        at = at[(bits[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)]
                        if with_slots and len(at):
                            at = at[w.slotted()[at]]
                    if not len(at):
                        continue
                    ks += [k] * len(at)
                    for c, v in zip(cols, (w.th[at], *w.words(at))):
                        c.append(v)
                    slots += [w.slots(p) for p in at.tolist()] if with_slots else [None] * len(at)
                flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), *map(pa.array, flat), pa.array(slots, pa.list_(pa.int64()))], names=["k", "th", "wh", "wh2", "slots"])

        return rows.mapInArrow(run, out)

    def meet(self, found: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        """``found`` joined with a table of one row a key, a key of many windows staying where it is."""
        if self.n <= BROADCAST_ITEMS:
            return found.join(F.broadcast(table), keys, how)
        sizes = self.scratch.write(found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes")
        hot = self.scratch.write(hot_keys(sizes, keys, "n", sizes.agg(F.sum("n")).first()[0] or 0), "hot")
        return skew_join(found, table, keys, hot if hot.head(1) else None, how)


def leaked(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, size: int = 12, scratch: Scratch | None = None) -> DataFrame:
    """(key, item): each document and item with at least ``size`` successive words in common.

    Windows meet on template and on 128 bits of their words' hashes; the items of one window travel in one row.
    """
    m = Matcher(items, item, passage, size, scratch or Scratch(corpus.sparkSession, "leakage"))
    same = ["th", "wh", "wh2"]
    found = m.corpus(corpus, key, text, False).select("doc", *same)
    if m.n > BROADCAST_ITEMS:
        found = m.scratch.write(found, "found")
    met = m.meet(found, m.items.groupBy(*same).agg(F.collect_set("item").alias("items")), same)
    return met.select(F.col("doc").alias(key), F.explode("items").alias(item)).distinct()


def reparameterised(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, size: int = 12, scratch: Scratch | None = None) -> DataFrame:
    """(key, item, windows, one_to_one): documents that hold windows of an item's template with other slots.

    Every item of a template counts.  The substitution must be consistent: slots that are equal in the item are equal in
    the document.  ``one_to_one`` counts the windows where also slots that differ in the item differ in the document.  A
    window counts once an item, however often the item holds the template; one that some item holds as it is, is a
    copy and does not count.  A template's items with the same equalities are decided together.
    """
    m = Matcher(items, item, passage, size, scratch or Scratch(corpus.sparkSession, "leakage"))
    equal = lambda c: F.transform(c, lambda x: F.array_position(c, x).cast("int"))
    found = m.corpus(corpus, key, text, True)
    if m.n > BROADCAST_ITEMS:
        found = m.scratch.write(found, "found")
    found = m.meet(found, m.items.select("th", "wh", "wh2").distinct(), ["th", "wh", "wh2"], "left_anti")
    held = m.items.where("size(slots) > 0").select("item", "th", equal(F.col("slots")).alias("p")).groupBy("item", "th").agg(F.sort_array(F.collect_set("p")).alias("class"))
    held = m.scratch.write(held, "classes")
    classes = held.groupBy("th").agg(F.collect_set("class").alias("classes"))
    if m.n > BROADCAST_ITEMS:
        found = m.scratch.write(found, "other")
    met = m.meet(found, classes, ["th"]).select("doc", "th", "slots", equal(F.col("slots")).alias("own"), F.explode("classes").alias("class"))
    fits = F.exists("class", lambda p: F.forall(F.arrays_zip(F.col("slots").alias("x"), p.alias("p")), lambda z: z["x"] == F.element_at("slots", z["p"])))
    per = met.where(fits).groupBy("doc", "th", "class").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.array_contains("class", F.col("own"))).alias("one_to_one"))
    pairs = per.join(m.small(held), ["th", "class"])
    return pairs.groupBy(F.col("doc").alias(key), F.col("item").alias(item)).agg(F.sum("windows").alias("windows"), F.sum("one_to_one").alias("one_to_one"))
