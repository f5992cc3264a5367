"""Each operator against a brute-force version or an exact round trip, with nulls, ties, repeats, empty and long input."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tressage.llm import bpe, components, leakage, names, spans, topn
from tressage.llm.rolling import window_hashes


# --- top N ---------------------------------------------------------------------------------------------------------


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), s), s)
    groups = {}
    for (g, i), s in best.items():
        groups.setdefault(g, []).append((-s, i))
    return sorted((g, k, i) for g, v in groups.items() for k, (_, i) in enumerate(sorted(v)[:n], 1))


def found_top(df, n):
    return sorted((r.g, r.rank_no, r.i) for r in topn.top_n(df, "g", "i", "s", n).collect())


@pytest.mark.parametrize("n", [1, 3, 5])
def test_top_n_with_ties_and_skew(spark, n):
    r = random.Random(n)
    rows = [("hot" if r.random() < 0.4 else f"g{r.randrange(40)}", f"{r.choice(['EP-', 'é', ''])}{r.randrange(60):03d}", r.choice([0.5, 0.5, 0.25, -1.5, 0.0, -0.0, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), float("nan"), None, r.random()])) for _ in range(3000)]
    rows += [(None, "x", 1.0), ("n", None, 1.0), ("n", "only", 0.1), ("z", "a", 1.0), ("z", "a\0", 1.0), ("z", "", 1.0)]
    df = spark.createDataFrame(rows, "g string, i string, s double").selectExpr("*", "1 as _g", "2 as rank_no", "3 as _c")
    got = found_top(df, n)
    assert got == brute_top([(a, b, c) for a, b, c in rows], n)


def test_top_n_empty_and_long_identifiers(spark):
    df = spark.createDataFrame([("g", "x" * 5000 + str(k), 1.0) for k in range(8)], "g string, i string, s double")
    assert found_top(df, 3) == [("g", k + 1, "x" * 5000 + str(k)) for k in range(3)]
    assert found_top(df.limit(0), 3) == []
    assert found_top(df.selectExpr("g", "i", "cast(null as double) as s"), 3) == []


def test_codes_keep_the_order_of_doubles(spark):
    r = random.Random(1)
    values = sorted({r.uniform(-1, 1) * 10.0 ** r.randint(-320, 300) for _ in range(3000)})
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", topn.sortable_code(F.col("x")).alias("c"))
    codes = [c for _, c in sorted(map(tuple, df.collect()))]
    assert all(a < b for a, b in zip(codes, codes[1:]))


# --- components ----------------------------------------------------------------------------------------------------


def brute_groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((v, find(v)) for v in parent)


@pytest.mark.parametrize("cell_edges", [40, 1_000_000])
def test_components_of_chains_stars_and_noise(spark, cell_edges):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 400)] + [(1000, 1001 + i) for i in range(300)] + [(5000 + r.randrange(300), 5000 + r.randrange(300)) for _ in range(200)] + [(-3, -9), (7, 7), (None, 1), (2, None), (9, 8), (8, 9)]
    r.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long").selectExpr("*", "1 as v", "2 as cell")
    got = sorted((x.vertex, x.group) for x in components.connected_components(df, "a", "b", cell_edges=cell_edges).collect())
    assert got == brute_groups(pairs)


def test_a_hub_with_a_fixed_share_of_all_links_is_split(spark, monkeypatch):
    r = random.Random(5)
    pairs = [(1, 2 + i) for i in range(900)] + [(2000 + r.randrange(400), 2000 + r.randrange(400)) for _ in range(600)]
    df = spark.createDataFrame(pairs, "a long, b long")
    real = components.local_union_find
    log = spark.sparkContext.accumulator(0)

    def counted(a, b, seed):
        if len(a) > 130:
            log.add(1)
        return real(a, b, seed)

    monkeypatch.setattr(components, "local_union_find", counted)
    got = sorted((x.vertex, x.group) for x in components.connected_components(df, "a", "b", cell_edges=60).collect())
    assert got == brute_groups(pairs) and log.value == 0
    components.connected_components(df, "a", "b", cell_edges=2000).count()
    assert log.value > 0  # the count does see what a task holds


def test_components_of_nothing(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert components.connected_components(df, "a", "b").count() == 0


def test_notice_groups(spark):
    notices = spark.createDataFrame([(1, "18-1"), (1, "18-1"), (2, "18-2"), (3, "18-3"), (4, None), (None, "18-9")], "idx long, idweb string")
    links = spark.createDataFrame([(2, " 18-1\t"), (3, " 18-2\n"), (3, "18-3"), (1, "18-99"), (77, "18-1"), (2, ""), (2, None), (None, "18-1")], "right_idx long, target_idweb string")
    assert sorted(map(tuple, components.notice_groups(notices, links).collect())) == [(1, 1), (1, 2), (1, 3)]
    assert components.notice_groups(notices, links.limit(0)).count() == 0


# --- tokens --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.default_vocabulary(), "rb") as f:
        return bpe.TrieEncoder(bpe.read_ranks(f.read()))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library_and_decode_to_the_text(encoder, library, text):
    ids = encoder.encode_batch([text])[0]
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert b"".join(encoder.tokens[i] for i in ids).decode() == text


def test_long_words_and_special_strings(encoder, library):
    for text in ("a" * 30_000, "ab" * 9000, " " * 5000, "=-" * 3000, "<|endoftext|> x", "\n\n\n", "日本" * 2000):
        assert encoder.encode_batch([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_clearing_the_trie_changes_nothing(library, monkeypatch, encoder):
    monkeypatch.setattr(bpe, "NODES", 5)
    monkeypatch.setattr(bpe, "WORDS", 3)
    small = bpe.TrieEncoder(encoder.ranks)
    texts = ["le marché public", "le marché privé", "", None, "le marchand"]
    assert small.encode_batch(texts) == encoder.encode_batch(texts)


def test_encode_table(spark, library):
    df = spark.createDataFrame([(1, "Bonjour"), (2, ""), (3, None)], "doc_id long, text string").selectExpr("*", "0 as ids", "0 as _t")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text").collect()}
    assert got == {1: library.encode("Bonjour", add_special_tokens=False).ids, 2: [], 3: []}
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


# --- leakage -------------------------------------------------------------------------------------------------------


def plain_words(t):
    s = unicodedata.normalize("NFKD", t or "")
    return re.findall(r"[^\W_]+", "".join(c for c in s if unicodedata.category(c) not in ("Mn", "Mc", "Me", "Cf")).casefold())


def brute_leaks(docs, items, n=12):
    out = set()
    for d, t in docs:
        w = plain_words(t)
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, p in items:
            v = plain_words(p)
            if any(tuple(v[k : k + n]) in own for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = "le Conseil de Béziers verse 1 200 euros au lot 7 pour œuvre ﬁnale É mois avant le terme fixé par l'acheteur Dupont".split()
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(8)]
    docs = []
    for d in range(60):
        w = [r.choice(vocabulary) for _ in range(40)]
        if d % 2:
            p = items[d % 8][1].split()
            k = r.randrange(11, 14)
            at = r.randrange(len(p) - k)
            w[10:10] = [x.upper() if d % 3 else "­".join(x) for x in p[at : at + k]]
        docs.append((d, r.choice([" ", "\n", ", ", " — "]).join(w)))
    docs += [(100, None), (101, ""), (102, items[0][1] * 50), (None, items[0][1])]
    c = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as th", "2 as doc", "3 as item_id")
    e = spark.createDataFrame([*items, (50, None), (51, "trop court")], "item_id long, passage string").selectExpr("*", "1 as text", "2 as item")
    got = set(map(tuple, leakage.leaked(c, "doc_id", "text", e, "item_id", "passage").collect()))
    assert got == brute_leaks([x for x in docs if x[0] is not None], items) and len(got) > 20
    assert leakage.leaked(c, "doc_id", "text", e.limit(0), "item_id", "passage").count() == 0
    assert leakage.leaked(c.limit(0), "doc_id", "text", e, "item_id", "passage").count() == 0


def test_many_items_and_names_take_the_joins(spark, monkeypatch):
    r = random.Random(8)
    vocabulary = "le conseil de Béziers verse Dupont 1 200 euros au lot 7 avant Martin terme fixé".split()
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(25))) for i in range(12)]
    docs = [(d, " ".join([*r.choices(vocabulary, k=9), *items[d % 12][1].split()[d % 9 : d % 9 + 14], "fin"])) for d in range(40)] + [(99, None)]
    c, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")

    def results():
        leaks = set(map(tuple, leakage.leaked(c, "doc_id", "text", e, "item_id", "passage").collect()))
        other = set(map(tuple, leakage.reparameterised(c, "doc_id", "text", e, "item_id", "passage", size=5).collect()))
        return leaks, other

    want = results()
    assert want[0] == brute_leaks(docs, items) and want[1]
    from tressage import runtime

    for bounds in ({"BROADCAST_ITEMS": 3}, {"BROADCAST_NAMES": 3}, {"BROADCAST_ITEMS": 3, "BROADCAST_NAMES": 0, "LEAST_BITS": 64, "MOST_BITS": 64}):
        for k, v in bounds.items():
            monkeypatch.setattr(leakage, k, v)
        monkeypatch.setattr(runtime, "HOT_FLOOR", 2)
        assert results() == want
        monkeypatch.undo()


def test_changed_slots_are_told_from_copies(spark):
    item = "selon le règlement quel candidat obtient la note quand on propose 170 euros puis 170 euros encore"
    docs = [(1, item), (2, item.replace("170", "88")), (3, item.replace("170", "88", 1)), (4, "autre chose")]
    c, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, passage string")
    assert [r.doc_id for r in leakage.leaked(c, "doc_id", "text", e, "item_id", "passage").collect() if r.doc_id == 1] == [1]
    got = {r.doc_id for r in leakage.reparameterised(c, "doc_id", "text", e, "item_id", "passage", size=17).collect()}
    assert got == {2}  # the third document changes one of two equal values only


def brute_reparameterised(docs, items, n):
    """Of texts without names and units: (doc, item) -> (windows, one_to_one)."""
    mark = lambda w: tuple("#" if any(c.isdigit() for c in x) else x for x in w)
    windows = lambda t: [tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)]
    held = {(i, v) for i, t in items for v in windows(t)}
    copies, out = {v for _, v in held}, {}
    for d, t in docs:
        for w in windows(t):
            best = {}
            for i, v in held:
                to = {(a, b) for a, b in zip(v, w) if any(c.isdigit() for c in a)}
                if w not in copies and to and mark(v) == mark(w) and len(to) == len({a for a, _ in to}):
                    best[i] = max(best.get(i, 0), int(len(to) == len({b for _, b in to})))
            for i, c in best.items():
                k, m = out.get((d, i), (0, 0))
                out[d, i] = (k + 1, m + c)
    return out


def test_every_item_of_a_template_is_tested(spark, monkeypatch):
    text = "candidat {} obtient {} puis {} encore"
    items = [(1, text.format(5, 5, 7)), (2, text.format(5, 6, 7)), (3, text.format(1, 2, 1)), (4, text.format(3, 3, 3) + " " + text.format(3, 4, 3))]
    docs = [(10, text.format(8, 9, 8)), (11, text.format(8, 8, 9)), (12, text.format(5, 6, 7)), (13, text.format(8, 8, 8) + " " + text.format(1, 2, 3)), (14, "rien")]
    c, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    want = brute_reparameterised(docs, items, 6)
    assert (10, 2) in want and (10, 3) in want and (10, 1) not in want  # the smallest item alone would lose the document
    assert want[10, 2] == (2, 0) and want[10, 3] == (2, 2)  # two values may become one, but not the other way round
    for most in (leakage.BROADCAST_ITEMS, 1):
        monkeypatch.setattr(leakage, "BROADCAST_ITEMS", most)
        got = {(r.doc_id, r.item_id): (r.windows, r.one_to_one) for r in leakage.reparameterised(c, "doc_id", "text", e, "item_id", "passage", size=6).collect()}
        assert got == want


# --- spans ---------------------------------------------------------------------------------------------------------


def brute_shared(docs, n):
    seen = {}
    for d, t in docs:
        for k in range(len(t or "") - n + 1):
            seen.setdefault(t[k : k + n], set()).add(d)
    out = {}
    for d, t in docs:
        mark = bytearray(len(t or ""))
        for k in range(len(t or "") - n + 1):
            if len(seen[t[k : k + n]]) > 1:
                mark[k : k + n] = b"\1" * n
        if any(mark):
            out[d] = sum(mark)
    return out


@pytest.mark.parametrize("n", [8, 21])
def test_shared_chars_against_brute_force(spark, n):
    r = random.Random(n)
    pool = ["".join(r.choice("abé🙂 ") for _ in range(r.randrange(n - 3, 3 * n))) for _ in range(12)]
    docs = [(d, "".join(r.choice(pool) if r.random() < 0.5 else "".join(r.choice("xyzwé") for _ in range(r.randrange(25))) for _ in range(r.randrange(6)))) for d in range(80)]
    docs += [(900, None), (901, ""), (902, "q" * 300), (903, pool[0] * 40), (904, docs[3][1]), (905, "r" * n + "s"), (906, "t" + "r" * n)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 as doc", "0 as at", "0 as shared_chars")
    got = {x.doc_id: x.shared_chars for x in spans.shared_chars(df, "doc_id", "text", n).collect()}
    assert got == brute_shared(docs, n)


def test_texts_longer_than_a_block(spark, monkeypatch):
    r = random.Random(11)
    docs = [(d, "".join(r.choice("abcdefgh") for _ in range(700))) for d in range(6)]
    docs += [(10, docs[0][1][100:400] + "x" * 90 + docs[1][1][:333]), (11, docs[2][1] + docs[3][1]), (12, docs[0][1][390:420])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_shared(docs, 21)
    rows = df.selectExpr("doc_id as doc", "text")
    monkeypatch.setattr(spans, "PIECE", 50)
    pieces = list(spans._pieces([1, 2], [docs[0][1], "y" * 20], [None, None], 21))
    assert sum(len(p[0]) for p in pieces) == 14 and max(int(p[3].sum()) for p in pieces) <= 70
    windows = {(1, int(x)) for p in pieces for t, s in zip(*spans._inside(p[2], p[3], 21)[::-1]) for x in [s - p[2][t] + p[1][t]]}
    assert windows == {(1, k) for k in range(680)}
    monkeypatch.undo()
    assert {x.doc_id: x.shared_chars for x in spans.shared_chars(df, "doc_id", "text", 21).collect()} == want and rows.count() == 9


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, "a" * 500), (2, None)], "doc_id long, text string")
    assert spans.shared_chars(df, "doc_id", "text").count() == 0 and spans.shared_chars(df.limit(0), "doc_id", "text").count() == 0


def test_window_hashes_depend_on_content_only():
    import numpy as np

    x = np.array([3, 1, 4, 1, 5, 3, 1, 4, 9] * 3, np.uint64)
    h = window_hashes(x, 3)
    assert h[0] == h[5] == h[9] and len(set(h.tolist())) == len({tuple(x[i : i + 3]) for i in range(len(h))})
    assert len(window_hashes(x[:2], 3)) == 0


# --- names ---------------------------------------------------------------------------------------------------------

BUYERS = {
    "town": ["Commune de Goufilcorbec", "Mairie de Goufilcorbec", "GOUFILCORBEC (COMMUNE DE)", "Goufilcorbec", "Gufilcorbec - Mairie", "72630 Ville de Goufilcorbec", "Monsieur le Maire de Goufilcorbec - Service marchés publics"],
    "welfare": ["CCAS de Goufilcorbec", "C.C.A.S. Goufilcorbec", "Centre communal d&#39;action sociale de Goufilcorbec"],
    "water": ["Syndicat intercommunal des eaux de Goufilcorbec", "S.I.E. Goufilcorbec", "Synd. eaux de Goueilcorbec"],
    "transport": ["Société d'économie mixte des transports de Goufilcorbec", "Semgoufilcorbec", "Goufilcorbec transports (Semgoufilcorbec)"],
    "river one": ["Commune de Corcadtevwen-en-Ormaie", "CNE DE CORCADTEVWEN EN ORMAIE", "Corcadtevwen en-Ormaie, Mairie de"],
    "river two": ["Commune de Corcadtevwen-en-Sarvette", "Ville de Corcadtevwen s/ Sarvette"],
    "school": ["Lycée des Ajoncs de Denfamnarmev-en-Tresque", "LycÃ©e Les Ajoncs - Denfamnarmev", "LGT des Ajoncs (Denfamnarmev-en-Tresque)"],
    "saint": ["Commune de Saint-Plogouvogvri", "Mairie de St. Plogouvogvri", "ST PLOGOUVOGVRI - MAIRIE"],
}
NOBODY = [None, "", "N/A", "-", "Acheteur public", "Voir DCE", "Non renseigné"]


def test_variants_of_each_buyer_are_linked_and_no_others(spark):
    rows = [(n,) for ns in BUYERS.values() for n in ns] * 2 + [(n,) for n in NOBODY]
    df = spark.createDataFrame(rows, "name string").selectExpr("*", "1 as entity", "2 as place")
    found = names.entities(df, "name")
    got = set(map(tuple, names.same_name_pairs(found).collect()))
    want = {(min(a, b), max(a, b)) for ns in BUYERS.values() for a in ns for b in ns if a != b}
    assert got == want
    assert not {r.name for r in found.collect()} & set(NOBODY)
    assert names.entities(df.limit(0), "name").count() == 0


def test_two_attested_places_one_letter_apart_stay_apart(spark):
    ways = ["Commune de {}", "Mairie de {}", "CCAS de {}", "{} - Mairie", "Ville de {}", "OPH de {}"]
    rows = [(w.format(t),) for w in ways for t in ("Filbecgou", "Filbergou")] + [("Ville de Filbecgouu",)]
    places = {r.name: r.place for r in names.entities(spark.createDataFrame(rows, "name string"), "name").collect()}
    assert set(places.values()) == {"filbecgou", "filbergou"} and places["Ville de Filbecgouu"] == "filbecgou"


def test_similarities_and_bands():
    assert names.alignment("abcd", "abdc") == 0.75 and names.alignment("", "") == 1.0
    assert names.monge_elkan("a b", "b a") == (1.0, 1.0) and names.monge_elkan("", "a") == (0.0, 0.0)
    b = names.bands_for()
    assert 1 - (1 - names.LEAST_SIMILARITY**names.ROWS_A_BAND) ** b >= names.RECALL > 1 - (1 - names.LEAST_SIMILARITY**names.ROWS_A_BAND) ** (b - 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcé 🙂", max_size=12), st.text(alphabet="abcé 🙂", max_size=12)), max_size=12))
def test_similarities_of_a_batch_equal_those_of_one(pairs):
    for (a, b), got in zip(pairs, names.monge_elkans(pairs).tolist()):
        whole, least = names.monge_elkan(a, b)
        assert (got[0] >= names.WHOLE - 1e-9 and got[1] >= names.TOKEN) == (whole >= names.WHOLE - 1e-9 and least >= names.TOKEN)
        if least >= names.TOKEN:
            assert got[1] == pytest.approx(least) and got[0] <= whole + 1e-9


SYLLABLES = "ber bra cad cor den dol fam fil gla gou hin jal kem kir lou mev nar plo quo rag sau tev vog wen xan zil".split()
CLEAN = {
    "municipality": "Commune de {}", "welfare": "Centre communal d'action sociale de {}", "intercommunal": "Communauté de communes de {}", "hospital": "Centre hospitalier de {}",
    "housing": "Office public de l'habitat de {}", "water": "Syndicat intercommunal des eaux de {}", "transport": "Société d'économie mixte des transports de {}",
}
OTHER = {
    "abbreviations": {"municipality": ["Cne {}", "Comm. de {}"], "welfare": ["CCAS {}", "Ctre comm. act. soc. {}", "C.C.A.S. de {}"], "intercommunal": ["Com. de communes {}", "Cté de cnes {}", "CC {}"], "hospital": ["CH {}", "Ctre hosp. {}", "Centre hosp. {}"], "housing": ["OPH {}", "Off. pub. habitat {}"], "water": ["SIE {}", "Synd. interc. des eaux {}"], "transport": ["Soc. éco. mixte transp. {}", "SEM transports {}"]},
    "reorderings": {"municipality": ["{} (Commune de)", "{}, Mairie de", "{} - Ville de"], "welfare": ["{} - action sociale, centre communal", "Action sociale - centre communal - {}", "{}, centre communal d'action sociale"], "intercommunal": ["{}, communauté de communes", "Communes de {} (communauté de)"], "hospital": ["{} - centre hospitalier", "Hospitalier (centre) de {}"], "housing": ["{}, office public de l'habitat", "Habitat de {} (office public)"], "water": ["Eaux de {}, syndicat intercommunal", "{} - syndicat des eaux"], "transport": ["Transports de {}, société d'économie mixte"]},
    "nicknames": {"municipality": ["Mairie de {}", "Monsieur le Maire de {}", "Hôtel de ville de {}", "{}"], "welfare": ["ccas de {}"], "intercommunal": ["Comcom {}", "CDC {}"], "hospital": ["Hôpital de {}", "Hôpital public {}"], "housing": ["{} Habitat"], "water": ["Eaux de {} (syndicat)"], "transport": ["Sem{}", "{} transports"]},
}


def test_recall_of_each_kind_of_variant(spark):
    """Measured recall by sort of variant, a slip being anywhere in the name, its title included; no wrong links."""
    r = random.Random(12)
    places = sorted({"".join(r.sample(SYLLABLES, 4)).capitalize() for _ in range(40)})
    truth, sort = {}, {}

    def put(name, who, how):
        if name not in truth:
            truth[name], sort[name] = who, how

    for p in places:
        for k, t in CLEAN.items():
            put(t.format(p), (p, k), "clean")
            for how, ways in OTHER.items():
                for w in ways[k]:
                    put(w.format(p), (p, k), how)
            for _ in range(3):
                n = r.choice([t, *OTHER["reorderings"][k][:1]]).format(p)
                i = r.choice([i for i in range(1, len(n) - 2) if n[i].isalpha() and n[i + 1].isalpha()])
                put(r.choice([n[:i] + n[i + 1] + n[i] + n[i + 2 :], n[:i] + n[i + 1 :], n[:i] + n[i] + n[i:], n[:i] + r.choice("aeiou") + n[i + 1 :]]), (p, k), "typos")
    found = {x.name: x.entity for x in names.entities(spark.createDataFrame([(n,) for n in truth], "name string"), "name").collect()}
    home = {truth[n]: found[n] for n in truth if sort[n] == "clean"}
    assert len(set(home.values())) == len(home)
    recall = {}
    for how in ("typos", *OTHER):
        of = [n for n in truth if sort[n] == how]
        recall[how] = sum(found.get(n) == home[truth[n]] for n in of) / len(of)
    print({h: round(v, 4) for h, v in recall.items()})
    back = {e: w for w, e in home.items()}
    wrong = [n for n in truth if found.get(n) in back and back[found[n]] != truth[n]]
    assert min(recall.values()) >= 0.9 and len(wrong) <= 0.005 * len(truth), (recall, wrong[:20], [n for n in truth if found.get(n) != home[truth[n]]][:60])


def test_misspelled_rivers_and_schools_and_repeated_syllables(spark):
    rows = {
        "a": ["Commune de Goufilcor-en-Ormaie", "Mairie de Goufilcor-en-Ormaie", "Ville de Goufilcor-en-Ormaie", "Cne de Goufilcor-en-Ormiae"],
        "b": ["Commune de Goufilcor-en-Sarvette", "Mairie de Goufilcor-en-Sarvette", "Ville de Goufilcor-en-Sarvette"],
        "c": ["Lycée des Ajoncs de Denfamnar", "Lycée Les Ajoncs - Denfamnar", "LGT des Ajoncs (Denfamnar)", "Lycée des Ajocns de Denfamnar"],
        "d": ["Commune de Tultultultul", "Mairie de Tultultultul", "Ville de Tultutlultul", "CNE TULTULTULUTL"],
        "e": ["SEM Transports Tevkir en Ormaie", "SEM Transports de Tevkir-en-Ormaie", "Semtevkir"],
        "f": ["Commune de Tevkir en Ormaie", "Ville de Tevkir-en-Ormaie"], "g": ["Commune de Tevkir en Orvelle", "Ville de Tevkir-en-Orvelle"],
        "h": ["Commune de Zilgoubra", "Ville de Zilgoubra", "Mairie de Zilgoubar", "Cne de Zilgoubar"],
    }
    df = spark.createDataFrame([(n,) for ns in rows.values() for n in ns], "name string")
    got = {}
    for x in names.entities(df, "name").collect():
        got.setdefault(x.entity, set()).add(x.name)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, rows.values()))


def test_pairs_of_a_large_entity_and_large_bands(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 3)
    rows = [(w.format(p),) for p in ("Goufilcor", "Denfamnar") for w in ("Commune de {}", "Mairie de {}", "{} - Mairie", "Ville de {}", "VILLE DE {}", "Cne {}", "{}", "{} (Commune de)")]
    found = names.entities(spark.createDataFrame(rows, "name string"), "name")
    assert names.same_name_pairs(found).count() == 2 * 28 and names.same_name_pairs(found).distinct().count() == 56


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_parsing_never_fails(name):
    names.parse_name(name)


def test_candidates_find_every_single_slip():
    """Measured recall of the bands on one-letter slips of names of the length at hand, also of repeated syllables."""
    r = random.Random(6)
    b = names.bands_for()
    missed = 0
    for k in range(300):
        w = "".join(r.choice("abcdefgilmnoprstuv") for _ in range(12)) if k % 3 else r.choice(SYLLABLES) * 4
        i = r.randrange(10)
        slip = r.choice([w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :]])
        missed += not (names.band_keys(w, b) == names.band_keys(slip, b)).any()
    assert missed <= 1
