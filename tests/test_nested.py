import json

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tressage.functions.jsonwalk import Numeral, PathNode, ordinal, places, scalar_type, triples
from tressage.operators.nested import NOTICE_TABLES, Flattener, TableSpec, flatten, notice_items, notice_rows

EFORMS = {"EFORMS": {"ContractAwardNotice": {
    "ext:UBLExtensions": {"x": {"efac:Organizations": {"efac:Organization": [{"efac:Company": [{"cac:PartyIdentification": {"cbc:ID": "ORG-2"}, "cac:PartyName": {"cbc:Name": "Alpha SA"}}]}, {"efac:Company": {"cac:PartyIdentification": {"cbc:ID": "ORG-3"}, "cac:PartyName": {"cbc:Name": "Beta SARL"}}}]},
        "efac:NoticeResult": {"efac:LotResult": [{"efac:TenderLot": {"cbc:ID": "LOT-0002"}, "efac:TenderingParty": {"efac:Tenderer": [{"cbc:ID": "ORG-3"}, {"cbc:ID": "ORG-2"}]}}]}}},
    "cac:ProcurementProject": {"cac:MainCommodityClassification": {"cbc:ItemClassificationCode": {"#text": "99999999"}}},
    "cac:ProcurementProjectLot": [
        {"cbc:ID": {"#text": "LOT-0001"}, "cac:ProcurementProject": {"cac:AdditionalCommodityClassification": [{"cbc:ItemClassificationCode": {"#text": "22222222-1"}}], "cac:MainCommodityClassification": {"cbc:ItemClassificationCode": {"#text": "11111111"}}}},
        {"cbc:ID": {"#text": "LOT-0002"}}]}}}
IDENTITE = {"IDENTITE": {"DENOMINATION": "x"}, "OBJET": {"LOTS": {"LOT": {"NUM": "7", "CPV": {"PRINCIPAL": "33333333", "SUPPLEMENTAIRE": ["44444444", "55555555"]}}}}, "ATTRIBUTION": {"DECISION": {"NUM_LOT": "7", "TITULAIRE": [{"DENOMINATION": "G"}, {"DENOMINATION": "H"}]}}}
MAPA = {"MAPA": {"initial": {"lots": {"lot": [{"numLot": 2, "cpv": [{"code": "12345678"}], "attribution": {"titulaire": {"nom": "Z"}}}, {"numLot": 1, "cpv": {"code": 3456789}}]}}}}


def found(payload, codes=None):
    return sorted(notice_items(Flattener(NOTICE_TABLES).tables(payload if payload is None or isinstance(payload, str) else json.dumps(payload)), codes))


def test_layouts():
    assert found(EFORMS) == [(1, "cpv", 1, "11111111"), (1, "cpv", 2, "22222222"), (2, "tenderer", 1, "Beta SARL"), (2, "tenderer", 2, "Alpha SA")]
    assert found(IDENTITE) == [(1, "cpv", 1, "33333333"), (1, "cpv", 2, "44444444"), (1, "cpv", 3, "55555555"), (1, "tenderer", 1, "G"), (1, "tenderer", 2, "H")]
    assert found(MAPA) == [(1, "cpv", 1, "12345678"), (1, "tenderer", 1, "Z"), (2, "cpv", 1, "03456789")]


def test_encodings_and_damage():
    text = json.dumps(MAPA)
    assert found(json.dumps(text)) == found(MAPA) == found("﻿" + text)
    assert found(text[:-3], '["11111111"]') == [(0, "cpv", 1, "11111111")]
    assert found(None) == found("") == found("null") == found('"x"') == []


def test_code_shapes():
    shapes = {'"72192000"': ["72192000"], '{"principal":"1111111","additionnels":["22222222-3"]}': ["22222222"], '[{"code":"33333333","principal":true}]': ["33333333"], '[["44444444"],["55555555"]]': ["44444444", "55555555"], "null": [], "[]": [], "": []}
    for shape, want in shapes.items():
        assert [r[3] for r in found(None, shape)] == want, shape


def walked(value, path=(), ords=()):
    """The triples of a value that the standard parser built, paths as keys and ordinals as (path, place)."""
    if isinstance(value, dict):
        return [t for k, v in value.items() for t in walked(v, (*path, k), ords)]
    if isinstance(value, list):
        return [t for i, v in enumerate(value, 1) for t in walked(v, path, (*ords, (path, i)))]
    return [(path, value, ords)]


def keys(node):
    return tuple(n.key for n in node.up())[::-1]


def streamed(text):
    found = triples(text, PathNode())
    return found if found is None else [(keys(n), v, tuple((keys(m), i) for m, i in places(o))) for n, v, o in found]


def parsed(text):
    value = text
    while isinstance(value, str) and not isinstance(value, Numeral):
        try:
            value = json.loads(value.lstrip("\ufeff"), parse_int=Numeral, parse_float=Numeral, parse_constant=Numeral)
        except ValueError:
            return None
    return walked(value) if isinstance(value, (dict, list)) else None


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20)


@settings(max_examples=500, deadline=None)
@given(json_values, st.sampled_from([None, 1]), st.booleans(), st.integers(0, 2), st.floats(0, 1), st.sampled_from(["", '"', "{", "}", "]", ",", ":", "x", "\\", "\n"]), st.integers(0, 1))
def test_streaming_equals_the_standard_parser_also_on_damage(value, indent, ascii_only, wraps, where, put, cut):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii_only)
    for _ in range(wraps):
        text = json.dumps(text)
    at = int(where * len(text))
    for t in (text, text[:at] + put + text[at + cut :]):
        assert streamed(t) == parsed(t)


def test_streaming_any_depth_and_any_number_of_encodings():
    n = 100_000
    deep = '{"a":[' * n + '"x"' + "]}" * n
    began = time.perf_counter()
    ((node, v, ords),) = triples(deep, PathNode())
    assert v == "x" and sum(1 for _ in node.up()) == n and ordinal(ords, node) == 1 and time.perf_counter() - began < 30
    assert triples(deep[:-1], PathNode()) is None and triples("[" * n, PathNode()) is None
    text = '{"a":1.50}'
    for _ in range(12):
        text = json.dumps(text)
    assert streamed(text) == [(("a",), "1.50", ())]
    assert streamed('{"a":1,"a":[2,{"b":3}]}') == [(("a",), "1", ()), (("a",), "2", ((("a",), 1),)), (("a", "b"), "3", ((("a",), 2),))]
    assert [scalar_type(v) for v in (None, "x", Numeral("1"), True, 2.5)] == [0, 1, 2, 4, 2]


def test_a_record_of_many_levels_gives_its_rows():
    n = 100_000
    lot = '{"lot":[{"numLot":7,"cpv":{"code":"12345678"}},{"numLot":8,"cpv":"23456789"}]}'
    got = found('{"MAPA":' + '{"x":' * n + '{"lots":' + lot + "}" + "}" * n + "}")
    assert got == [(1, "cpv", 1, "12345678"), (2, "cpv", 1, "23456789")]


def test_flatten_links_children(spark):
    specs = (TableSpec("parent", "p", {"name": "n"}), TableSpec("child", "p.c", {"v": "v"}, parents=("p",)))
    df = spark.createDataFrame([(1, '{"p":[{"n":"a","c":[{"v":1},{"v":2}]},{"n":"b","c":{"v":3}}]}'), (2, None), (3, "{")], "id long, j string")
    got = sorted((r.id, r.table_name, tuple(r.ordinals), tuple(sorted(r.fields.items()))) for r in flatten(df, "id", "j", specs).collect())
    assert [g[:3] for g in got] == [(1, "child", (1, 1)), (1, "child", (1, 2)), (1, "child", (2, 1)), (1, "parent", (1,)), (1, "parent", (2,))]


def test_notice_rows_once(spark):
    df = spark.createDataFrame([("n", json.dumps(MAPA), '["11111111"]', "q"), ("n", json.dumps(MAPA), '["11111111"]', "r"), (None, json.dumps(MAPA), None, "s")], "idweb string, donnees string, cpv_codes_json string, item string")
    assert notice_rows(df).count() == 4
    assert notice_rows(df.limit(0)).count() == 0


def brute(row):
    """Codes and tenderers by walking each layout by hand."""
    many = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    code = lambda v: str(v["#text"] if isinstance(v, dict) else v).strip()[:8]

    def at(o, *keys):
        for k in keys:
            o = o.get(k) if isinstance(o, dict) else None
        return o

    def load(text):
        try:
            v = json.loads(text)
            return json.loads(v) if isinstance(v, str) and v.startswith("{") else v
        except (TypeError, ValueError):
            return None

    def flat(x):
        if isinstance(x, dict):
            return [code(x["code"])] if "code" in x else [c for v in x.values() for c in flat(v)]
        return [c for v in x for c in flat(v)] if isinstance(x, list) else [code(x)] if isinstance(x, str) and x else []

    out = {(0, "cpv", i, c) for i, c in enumerate(flat(load(row.cpv_codes_json)), 1)}
    o = load(row.donnees)
    lots = []
    if isinstance(o, dict) and "EFORMS" in o:
        n = next(iter(o["EFORMS"].values()))
        e = at(n, "ext:UBLExtensions", "ext:UBLExtension", "ext:ExtensionContent", "efext:EformsExtension")
        orgs = {at(c, "cac:PartyIdentification", "cbc:ID"): at(c, "cac:PartyName", "cbc:Name") for g in many(at(e, "efac:Organizations", "efac:Organization")) for c in many(g.get("efac:Company"))}
        won = {}
        for r in many(at(e, "efac:NoticeResult", "efac:LotResult")):
            won.setdefault(at(r, "efac:TenderLot", "cbc:ID"), []).extend(orgs[t["cbc:ID"]] for t in many(at(r, "efac:TenderingParty", "efac:Tenderer")))
        for lot in many(n.get("cac:ProcurementProjectLot")):
            p = lot.get("cac:ProcurementProject", {})
            lots.append(([code(m["cbc:ItemClassificationCode"]) for k in ("Main", "Additional") for m in many(p.get(f"cac:{k}CommodityClassification"))], won.get(at(lot, "cbc:ID", "#text"), [])))
    elif isinstance(o, dict) and "OBJET" in o:
        won = {}
        for r in many(at(o, "ATTRIBUTION", "DECISION")):
            won.setdefault(r["NUM_LOT"], []).extend(t["DENOMINATION"] for t in many(r.get("TITULAIRE")))
        lots = [([code(c) for k in ("PRINCIPAL", "SUPPLEMENTAIRE") for c in many(at(lot, "CPV", k))], won.get(lot["NUM"], [])) for lot in many(at(o, "OBJET", "LOTS", "LOT"))]
    elif isinstance(o, dict):
        for lot in many(at(next(iter(o.values())), "initial", "lots", "lot")):
            c = lot.get("cpv")
            found = [c["principal"], *many(c.get("additionnel"))] if isinstance(c, dict) and "principal" in c else [x["code"] for x in many(c)]
            lots.append((list(map(code, found)), [t["nom"] for t in many(at(lot, "attribution", "titulaire"))]))
    for i, (cs, ts) in enumerate(lots, 1):
        out |= {(i, "cpv", k, c) for k, c in enumerate(cs, 1)} | {(i, "tenderer", k, t) for k, t in enumerate(ts, 1)}
    return {(row.idweb, *x) for x in out}


def test_against_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/notices_engineered.parquet")
    want = set().union(*map(brute, df.select("idweb", "donnees", "cpv_codes_json").collect()))
    got = [tuple(r) for r in notice_rows(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_an_award_of_several_lots_gives_its_tenderers_to_each():
    lots = {(1,): {"label": ["1"]}, (2,): {"label": ["2"]}, (3,): {"label": ["3"]}}
    tables = {"company": {}, "lot": lots, "award": {(1,): {"label": ["1", "3", "3"], "tenderer": ["A", "B"]}, (2,): {"label": ["2"], "tenderer": ["C"]}}}
    got = {(o, i, x) for o, entity, i, x in notice_items(tables, None) if entity == "tenderer"}
    assert got == {(1, 1, "A"), (1, 2, "B"), (2, 1, "C"), (3, 1, "A"), (3, 2, "B")}
