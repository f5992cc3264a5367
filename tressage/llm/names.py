"""Names typed by people: all spellings of one organisation linked.

1. *Parse.*  Encoding damage, HTML entities, accents, case, postcodes and departments of the organisation are undone;
   what is left is read as a kind (a municipality, its hospital, ...), a place, a qualifier of the place (its river), and
   the proper name of a school.  Kinds come from a lexicon of titles; titles that are misspelled, reordered or
   abbreviated are told by Monge-Elkan similarity to those of the lexicon (:func:`title_by_evidence`).
2. *Candidates.*  Strings are MinHashed over padded q-grams and banded.  :func:`bands_for` picks the number of bands from
   the collision curve 1 - (1 - s**r)**b, for the recall wanted at the least similarity one slip leaves.  A q-gram that
   comes again counts again, so that repeated syllables leave no less.
3. *Verification.*  Monge-Elkan similarity over the tokens of two strings, the inner similarity being the
   optimal-string-alignment distance, computed for a batch of pairs at a time; the weakest token must pass too.
4. *Star clustering.*  A string is a satellite of the most similar one that is a star, unless it is typed too often for a
   slip (FEW, RATIO); two well attested places one letter apart both stay stars.  Stars are chosen in order of
   support, in rounds, as no string that follows a star is one itself.
5. *Twice.*  Steps 2 to 4 run over the places, where all organisations of a place bear witness to its spelling, and
   then over whole names (kind, place, qualifier and school), a pair of which must have the same place.  A kind is a
   token of the whole name like any other.  The star of its whole name is a name's entity.  A missing qualifier is filled
   in where the place, or else the organisation, has only one.

Scale: names are made distinct with counts before anything else; places are a small fraction of names; bands that
hold one string are dropped before the join, those of many are split, and pairs go from rarer to commoner strings only.
A place that a third of all names share stays where it is when its names meet what is known of it.  The pairs of an
entity, where they are asked for, come from a self-join split by its size.

Defined results: nulls, empty strings and the stand-ins in STAND_INS name nobody and are in no entity; a
name that is only punctuation, digits or titles names nobody; repeated names count once.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import HOT_FLOOR, Scratch, hot_keys, skew_join

Q, PAD, ROWS_A_BAND, LEAST_SIMILARITY, RECALL = 3, 2, 4, 0.45, 0.999
TOKEN, WHOLE, FEW, RATIO = 0.83, 0.85, 2, 0.34
#: A group is joined with itself in parts of about so many rows.
BLOCK = 500
#: The least similarity of a misspelled title word, the fewest letters of one, and of an abbreviation.
TITLE, TITLE_LETTERS, STEM = 0.8, 5, 3

#: What people type where a name is missing, folded.
STAND_INS = frozenset(("", "n a", "na", "nc", "n c", "nr", "non renseigne", "non communique", "non precise", "acheteur public", "voir dce", "voir avis", "inconnu", "sans objet", "neant", "null", "none", "nan", "test", "xxx"))
#: Words that carry no name.
FILLERS = frozenset("de des d du l la le les et".split())
LINKS = frozenset("sur s en les lez sous".split())
#: Departments of an organisation, folded and without fillers.
_departments = re.compile(r"\b(?:service (?:marches(?: publics)?|commande publique|achats?)|direction (?:achats|commande publique|generale)|pouvoir adjudicateur|cellule marches)\b")
#: Titles and abbreviations of the kinds of organisation, folded and without fillers; first match wins.
KINDS = tuple((k, re.compile(rf"\b(?:{p})\b")) for k, p in (
    ("welfare", r"centre communal action sociale|ccas|c c a s"),
    ("intercommunal", r"communaute communes|comcom|com communes|cte cnes|cte communes|cdc|cc|c c"),
    ("hospital", r"(?:centre|ctre) hosp(?:italier)?|hopital(?: public)?|ch|c h"),
    ("housing", r"(?:office public|off pub) habitat|oph|o p h|habitat"),
    ("water", r"synd(?:icat)? (?:interc(?:ommunal)? )?eaux|sie|s i e"),
    ("transport", r"(?:societe economie|soc eco) mixte transports|sem transports|transports|sem"),
    ("school", r"lycee|lyc|lgt"),
    ("purchasing", r"centrale achats?(?: regionale)?"),
    ("municipality", r"commune|cne|mairie|hotel ville|ville|monsieur maire|m maire"),
))
#: The titles in full, as words, for those typed in other ways.
TITLES = tuple((k, t.split()) for k, ts in (
    ("welfare", ("centre communal action sociale",)), ("intercommunal", ("communaute communes",)), ("hospital", ("centre hospitalier", "hopital public", "hopital")),
    ("housing", ("office public habitat",)), ("water", ("syndicat intercommunal eaux", "syndicat eaux")), ("transport", ("societe economie mixte transports", "transports")),
    ("school", ("lycee",)), ("municipality", ("monsieur maire", "hotel ville", "commune", "mairie", "ville")),
) for t in ts)
_damage = re.compile("[ÂÃâ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,2}")


def _undamaged(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group().encode(code).decode()
        except UnicodeError:
            continue
    return m.group()


def fold(name: str) -> str:
    """Lower-case words without accents, fillers' apostrophes or markup."""
    t = html.unescape(_damage.sub(_undamaged, name))
    t = unicodedata.normalize("NFKD", t)
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").casefold()
    return " ".join(re.findall(r"[^\W_]+", t))


def _title_word(word: str, title: str) -> float:
    """How well a typed word stands for a word of a title: spelled alike, or cut short."""
    if word == title:
        return 1.0
    if STEM <= len(word) < len(title) and title.startswith(word):
        return 0.95
    if len(word) >= STEM and word[0] == title[0] and word[-1] == title[-1] and len(word) < len(title) and len(title) >= 6:
        letters = iter(title)
        if all(c in letters for c in word):  # a contraction
            return 0.9
    if min(len(word), len(title)) >= TITLE_LETTERS:
        return alignment(word, title)
    # one slip in a word of four letters
    return TITLE if len(title) == 4 and len(word) in (3, 4, 5) and (1 - alignment(word, title)) * max(len(word), 4) < 1.5 else 0.0


def title_by_evidence(words: list[str]) -> tuple[str, set[int]] | None:
    """The kind whose title the words hold in any order and spelling, and which words; None if there is none.

    Every word of a title must have a word of its own at TITLE or more, and something must be left for the place.  The
    title of most words counts, then the better spelled.
    """
    best = None
    for kind, title in TITLES:
        used: set[int] = set()
        total = 0.0
        for t in title:
            sim, at = max(((_title_word(w, t), -i) for i, w in enumerate(words) if i not in used), default=(0.0, 0))
            if sim < TITLE:
                break
            used.add(-at)
            total += sim
        else:
            left = [w for i, w in enumerate(words) if i not in used]
            if any(len(w) > 2 and w.isalpha() for w in left) and (best is None or (len(title), total) > best[:2]):
                best = (len(title), total, kind, used)
    return best and (best[2], best[3])


@lru_cache(10_000)
def _near_filler(word: str) -> bool:
    """A filler with one slip."""
    return len(word) <= 3 and any((1 - alignment(word, f)) * max(len(word), len(f)) < 1.5 for f in ("de", "des", "du", "les"))


def place_words(words: list[str], kind: str) -> list[str]:
    """The words left for the place: without those of the kind's titles in other spellings, and misspelled fillers."""
    titles = {t for k, ts in TITLES if k == kind for t in ts}
    left = [w for w in words if w == "@" or w in LINKS or not any(_title_word(w, t) >= TITLE for t in titles)]
    left = [w for w in left if w in LINKS or not _near_filler(w)] if any(len(w) > 3 for w in left) else left
    return left if any(len(w) > 2 and w.isalpha() for w in left) else words


def parse_name(name: str | None) -> list[tuple[str, bool, str, str, str]]:
    """The readings of a name, best first: (kind, saint, place, qualifier, school); none if it names nobody."""
    t = fold(name or "")
    if t in STAND_INS:
        return []
    t = re.sub(r"\b\d{2,5}\b", " ", t)
    links = [w for w in t.split() if w not in FILLERS or w in LINKS]
    t = " ".join(links)
    bare = " ".join(w for w in links if w not in FILLERS)
    bare = " ".join(_departments.sub(" ", bare).split())
    kind, found = "municipality", False
    for k, pattern in KINDS:
        if pattern.search(bare):
            kind, found = k, True
            break
    words = bare.split()
    if not found and len(words) > 1 and (told := title_by_evidence(words)):
        kind, found = told[0], True
        words = ["@" if i in told[1] else w for i, w in enumerate(words)]
        if kind == "school" and "@" in words[-1:]:
            words = ["@", *words[:-1]]
    if found:
        for k, pattern in KINDS:
            if k in (kind, "municipality"):
                text = pattern.sub(" @ ", " ".join(words))
                words = text.split()
    school = ""
    if kind == "school":
        at = words.index("@") if "@" in words else len(words)
        if at + 1 < len(words) and words[at + 1] != "@":
            school = words.pop(at + 1)
    words = [w for w in place_words(words, kind) if w != "@"]
    saint = any(w in ("saint", "st", "sainte", "ste") for w in words)
    words = [w for w in words if w not in ("saint", "st", "sainte", "ste")]
    if kind == "transport" and len(words) > 1:
        words = [w for w in words if not (w.startswith("sem") and len(w) > 7)] or words
    place, qualifier = words, ""
    for i, w in enumerate(words):
        if i and w in LINKS:
            place, qualifier = words[:i], " ".join(x for x in words[i + 1 :] if x not in LINKS)
            break
    else:
        if len(words) == 2 and re.search(rf"\b{words[0]}\W+(?:les|lez)\W+{words[1]}\b", fold(name or "")):
            place, qualifier = words[:1], words[1]
    text = " ".join(place)
    if not re.search(r"[^\W\d_]{3}", text):
        return []
    readings = [(kind, saint, text, qualifier, school)]
    if len(place) == 1 and text.startswith("sem") and len(text) > 7 and (kind == "transport" or not found):
        readings.insert(0, ("transport", saint, text[3:], qualifier, ""))
        if kind == "transport":
            readings.pop()
    return readings


def alignment(a: str, b: str) -> float:
    """1 - (optimal string alignment distance / longer length)."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    before, last = [], list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
    return 1 - last[m] / max(n, m, 1)


def monge_elkan(a: str, b: str) -> tuple[float, float]:
    """Mean and least, over the tokens of each side, of the best similarity on the other; symmetric."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0, 0.0
    grid = [[alignment(s, t) for t in y] for s in x]
    rows, cols = [max(r) for r in grid], [max(c) for c in zip(*grid)]
    return (sum(rows) / len(rows) + sum(cols) / len(cols)) / 2, min(rows + cols)


def alignments(pairs: list[tuple[str, str]]):
    """:func:`alignment` of many pairs at once, a cell of all their tables at a time; 0 where the lengths alone forbid TOKEN."""
    import numpy as np

    out = np.zeros(len(pairs))
    near = [k for k, (a, b) in enumerate(pairs) if a and b and min(len(a), len(b)) >= TOKEN * max(len(a), len(b)) - 1e-9]
    near.sort(key=lambda k: max(len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(near):
        longest = max(map(len, pairs[near[at]]))
        end = at
        while end < len(near) and end - at < 20_000 and max(map(len, pairs[near[end]])) <= longest + 4:
            end += 1
        some = near[at:end]
        at = end
        n, m = (max(len(pairs[k][side]) for k in some) for side in (0, 1))
        x, y = np.zeros((n + 1, len(some)), np.uint32), np.ones((m + 1, len(some)), np.uint32)
        for i, k in enumerate(some):
            for side, grid in ((0, x), (1, y)):
                s = pairs[k][side]
                grid[1 : len(s) + 1, i] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        la, lb = (np.array([len(pairs[k][side]) for k in some]) for side in (0, 1))
        rows = [np.tile(np.arange(m + 1, dtype=np.int32)[:, None], (1, len(some)))]
        found = np.zeros(len(some), np.int32)
        for i in range(1, n + 1):
            row = np.empty_like(rows[-1])
            row[0] = i
            last = rows[-1]
            for j in range(1, m + 1):
                cell = np.minimum(np.minimum(last[j], row[j - 1]) + 1, last[j - 1] + (x[i] != y[j]))
                if i > 1 and j > 1:
                    swap = (x[i] == y[j - 1]) & (x[i - 1] == y[j])
                    cell = np.where(swap, np.minimum(cell, rows[-2][j - 2] + 1), cell)
                row[j] = cell
            rows = [*rows[-1:], row]
            done = la == i
            found[done] = row[lb[done], np.flatnonzero(done)]
        out[some] = 1 - found / np.maximum(la, lb)
    return out


def monge_elkans(pairs: list[tuple[str, str]]):
    """:func:`monge_elkan` of many pairs at once; inner similarities that lengths alone keep below TOKEN are 0."""
    import numpy as np

    split = [(a.split(), b.split()) for a, b in pairs]
    inner = sorted({(s, t) for x, y in split for s in x for t in y if s != t})
    sims = dict(zip(inner, alignments(inner).tolist()))
    out = np.zeros((len(pairs), 2))
    for k, (x, y) in enumerate(split):
        if x and y:
            grid = [[1.0 if s == t else sims[s, t] for t in y] for s in x]
            rows, cols = [max(r) for r in grid], [max(c) for c in zip(*grid)]
            out[k] = (sum(rows) / len(rows) + sum(cols) / len(cols)) / 2, min(rows + cols)
    return out


def bands_for(similarity: float = LEAST_SIMILARITY, recall: float = RECALL, rows: int = ROWS_A_BAND) -> int:
    """The fewest bands of ``rows`` hashes that meet ``recall`` at ``similarity`` on the collision curve."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def grams(text: str, q: int = Q) -> set[str]:
    """The q-grams of the padded text; one that comes again carries which time it is."""
    padded = "^" * PAD + text + "$" * PAD
    seen: dict[str, int] = {}
    out = set()
    for i in range(len(padded) - q + 1):
        g = padded[i : i + q]
        n = seen[g] = seen.get(g, 0) + 1
        out.add(g if n == 1 else f"{g}\0{n}")
    return out


def _readings(names: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                out += [(name, i, *r) for i, r in enumerate(parse_name(name))]
            cols = list(zip(*out)) if out else [()] * 7
            types = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["name", "reading", "kind", "saint", "place", "qualifier", "school"])

    return names.mapInArrow(run, "name string, reading int, kind string, saint boolean, place string, qualifier string, school string")


def band_keys(text: str, bands: int, rows: int = ROWS_A_BAND, known: dict | None = None):
    """The key of each MinHash band of a text."""
    import numpy as np
    import xxhash

    from .rolling import mix

    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    known = {} if known is None else known
    h = np.array([known.setdefault(g, xxhash.xxh64_intdigest(g)) for g in grams(text)], np.uint64)
    least = mix(h[None, :] ^ seeds[:, None]).min(axis=1).reshape(bands, rows)
    k = np.zeros(bands, np.uint64)
    for i in range(rows):
        k = mix(k ^ least[:, i])
    return k.view(np.int64)


def _bands(strings: DataFrame, bands: int, rows: int = ROWS_A_BAND) -> DataFrame:
    """(text, support, place, band, key) of the MinHash bands over the q-grams of the padded text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known: dict[str, int] = {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if len(known) > 1_000_000:
                known.clear()
            at = pa.array(np.repeat(np.arange(n), bands))
            key = np.concatenate([band_keys(p, bands, rows, known) for p in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(3)], pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(key)], names=["text", "support", "place", "band", "key"])

    return strings.select("text", "support", "place").mapInArrow(run, "text string, support long, place string, band int, key long")


def _similar(pairs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            sims = monge_elkans(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
            keep = pa.array((sims[:, 0] >= WHOLE - 1e-9) & (sims[:, 1] >= TOKEN))
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sims[:, 0])], names=["a", "b", "support", "sim"])
            yield out.filter(keep)

    return pairs.select("a", "b", "support").mapInArrow(run, "a string, b string, support long, sim double")


def _split(rows: DataFrame, keys: list[str], salt: str, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of a self-join on ``keys`` and ``part``: each row once, and each row in every part of its group."""
    j = rows.join(sizes.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), keys)
    once = j.withColumn("part", F.pmod(F.xxhash64(salt), F.col("parts")).cast("int")).drop("parts")
    return once, j.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def stars(strings: DataFrame, scratch: Scratch) -> DataFrame:
    """(text, star) for every string of ``strings`` (text, support, place); strings of different places are not linked."""
    banded = scratch.write(_bands(strings, bands_for()), "bands")
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    once, every = _split(banded, ["band", "key"], "text", shared)
    x, y = once.alias("x"), every.alias("y")
    weaker = (F.col("x.support") < F.col("y.support")) | ((F.col("x.support") == F.col("y.support")) & (F.col("x.text") > F.col("y.text")))
    same = F.lit(True)
    for c in ("band", "key", "part", "place"):
        same &= F.col(f"x.{c}") == F.col(f"y.{c}")
    pairs = x.join(y, same & weaker & (F.col("x.support") <= F.greatest(F.lit(FEW).cast("double"), F.col("y.support") * RATIO)))
    pairs = pairs.select(F.col("x.text").alias("a"), F.col("y.text").alias("b"), F.col("y.support").alias("support")).distinct()
    edges = scratch.write(_similar(pairs), "similar")
    scratch.drop(banded)
    state = scratch.write(strings.select("text").join(edges.select(F.col("a").alias("text")).distinct(), "text", "left_anti").withColumn("star", F.lit(True)), "stars")
    while True:
        open_ = edges.join(state.select(F.col("text").alias("a")), "a", "left_anti")
        seen = open_.join(state.select(F.col("text").alias("b"), "star"), "b", "left")
        new = seen.groupBy("a").agg(F.max(F.coalesce(F.col("star"), F.lit(False))).alias("near"), F.min(F.col("star").isNotNull()).alias("all"))
        new = scratch.write(new.where("near or all").select(F.col("a").alias("text"), (~F.col("near")).alias("star")), "stars")
        if not new.head(1):
            break
        state = state.unionByName(new)
    centres = state.where("star").select(F.col("text").alias("b"))
    best = edges.join(state.where("not star").select(F.col("text").alias("a")), "a", "left_semi").join(centres, "b", "left_semi")
    best = best.groupBy("a").agg(F.max_by("b", F.struct("sim", "support", "b")).alias("star"))
    return centres.select(F.col("b").alias("text"), F.col("b").alias("star")).unionByName(best.select(F.col("a").alias("text"), "star"))


def entities(names: DataFrame, name: str, scratch: Scratch | None = None) -> DataFrame:
    """(name, entity, kind, place, qualifier, school) of every distinct name that names somebody."""
    scratch = scratch or Scratch(names.sparkSession, "names")
    distinct = names.select(F.col(f"`{name}`").cast("string").alias("name")).where("name is not null").distinct()
    read = scratch.write(_readings(distinct), "readings")
    total = read.count()

    def meet(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
        """``rows`` with the one row of ``table`` for their key, which a third of them may share."""
        if total <= HOT_FLOOR:  # no key can be hot
            return rows.join(table, key)
        sizes = scratch.write(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "sizes")
        hot = scratch.write(hot_keys(sizes, [key], "n", total), "hot")
        return skew_join(rows, table, [key], hot if hot.head(1) else None)

    sure = read.groupBy("name").agg(F.max("reading").alias("last"))
    read = scratch.write(read.join(sure, "name").withColumn("sure", F.col("last") == 0).drop("last"), "read")
    places = scratch.write(read.groupBy("place").agg(F.count(F.lit(1)).alias("support"), F.count_if("sure").alias("sure_support")), "places")
    star = scratch.write(stars(places.select(F.col("place").alias("text"), "support", F.lit("").alias("place")), scratch).withColumnRenamed("text", "place"), "star")
    backed = star.join(places, "place").groupBy("star").agg(F.sum("sure_support").alias("backing"))
    read = meet(read, star.join(backed, "star"), "place")
    # an uncertain reading holds if certain ones know its place; else the next reading counts
    ranked = read.withColumn("order", F.when(F.col("sure") | ((F.col("reading") == 0) & (F.col("backing") > 0)), F.lit(0)).otherwise(F.col("reading") + 1))
    chosen = ranked.groupBy("name").agg(F.min_by(F.struct("kind", "saint", "star", "qualifier", "school"), F.struct("order", F.col("reading"))).alias("r")).select("name", "r.*")
    chosen = scratch.write(chosen, "chosen")

    def only(rows: DataFrame, by: list[str], out: str) -> DataFrame:
        """The qualifier of a group that has one, spellings of it that came once in ten or less left aside."""
        q = rows.where("qualifier <> ''").groupBy(*by, "qualifier").agg(F.count(F.lit(1)).alias("n"))
        top = q.groupBy(*by).agg(F.max("n").alias("most"), F.max_by("qualifier", F.struct("n", "qualifier")).alias("first"))
        rest = q.join(top, by).where("n > most / 10").groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.first("first").alias("first"))
        return rest.where("k = 1").select(*by, F.col("first").alias(out))

    holy = chosen.where("kind <> 'transport'").groupBy("star").agg(F.count_if("saint").alias("with"), F.count_if(~F.col("saint")).alias("without"))
    known = chosen.select("star").distinct().join(holy, "star", "left").join(only(chosen, ["star"], "river"), "star", "left")
    own = only(chosen, ["star", "kind", "school"], "own")
    told = meet(chosen, known.na.fill(0, ["with", "without"]), "star")
    told = scratch.write(told, "told")
    lacking = told.where("qualifier = '' and river is null").join(own, ["star", "kind", "school"], "left")
    told = told.where("not (qualifier = '' and river is null)").withColumn("own", F.lit(None).cast("string")).unionByName(lacking.select(*told.columns, "own"))
    both = F.least("with", "without") > F.greatest("with", "without") * RATIO
    saint = F.when(both, F.col("saint")).otherwise(F.col("with") > F.col("without"))
    river = F.when(F.col("qualifier") == "", F.coalesce("river", "own", F.lit(""))).otherwise(F.col("qualifier"))
    told = told.select("name", "kind", F.when(saint, F.concat(F.lit("saint "), "star")).otherwise(F.col("star")).alias("place"), river.alias("qualifier"), "school")
    told = scratch.write(told.withColumn("text", F.concat_ws(" ", F.concat(F.lit("="), "kind"), "place", F.when(F.col("qualifier") != "", F.col("qualifier")), F.when(F.col("school") != "", F.col("school")))), "whole")
    whole = told.groupBy("text", "place").agg(F.count(F.lit(1)).alias("support"), F.min(F.struct("kind", "place", "qualifier", "school")).alias("r"))
    whole = scratch.write(whole, "wholes")
    last = stars(whole.select("text", "support", "place"), scratch).join(whole.select(F.col("text").alias("star"), "r"), "star").select("text", "r")
    out = meet(told.select("name", "text"), last, "text").select("name", "r.*")
    return out.select("name", F.concat_ws("|", "kind", "place", "qualifier", "school").alias("entity"), "kind", "place", "qualifier", "school")


def same_name_pairs(found: DataFrame) -> DataFrame:
    """(name_a, name_b), the smaller by code points first, of every two names of one entity; a self-join split by size."""
    rows = found.select("entity", "name")
    once, every = _split(rows, ["entity"], "name", rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    pairs = once.withColumnRenamed("name", "name_a").join(every.withColumnRenamed("name", "name_b"), ["entity", "part"])
    return pairs.where("name_a < name_b").select("name_a", "name_b")
