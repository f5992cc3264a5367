import json
from collections import defaultdict

from tressage.operators import drift

SCHEMA = "raw_source_file string, stream_no int, file_seq int, idweb string, donnees string, path string"


def rows(spark, *items):
    return spark.createDataFrame([(f"s{s}_{q}", s, q, k, v if v is None or isinstance(v, str) else json.dumps(v), "clash") for s, q, k, v in items], SCHEMA)


def found(df):
    return sorted(map(tuple, drift.changes(df).collect()))


def test_kinds_of_change(spark):
    df = rows(
        spark, (0, 1, "a", {"x": {"cp": 44, "old": "v", "b": True}}), (0, 1, "b", {"x": {"gone": 1}}),
        (0, 2, "a", {"x": {"cp": "44", "neu": "v", "b2": "oui"}}), (0, 2, "c", {"y": [{"z": 1}]}))
    assert found(df) == [
        ("s0_2", "added", "y.z", ""), ("s0_2", "removed", "x.gone", ""), ("s0_2", "renamed", "x.b", "x.b2"), ("s0_2", "renamed", "x.old", "x.neu"), ("s0_2", "retyped", "x.cp", "")]


def test_rename_needs_the_same_value_everywhere_and_a_shared_notice(spark):
    df = rows(spark, (0, 1, "a", {"p": 1}), (0, 1, "b", {"p": 2}), (0, 2, "a", {"q": 1}), (0, 2, "b", {"q": 3}), (1, 1, "a", {"p": 1}), (1, 2, "z", {"q": 1}), (1, 4, "z", {"r": 1}))
    assert found(df) == [("s0_2", "added", "q", ""), ("s0_2", "removed", "p", ""), ("s1_2", "added", "q", ""), ("s1_2", "removed", "p", "")]


def test_damaged_null_and_empty(spark):
    df = rows(spark, (0, 1, "a", {"p": 1}), (0, 2, "a", None), (0, 2, "b", "{"), (0, 3, "a", json.dumps(json.dumps({"p": None, "q": ""}))))
    assert found(df) == [("s0_2", "removed", "p", ""), ("s0_3", "added", "q", "")]
    assert found(df.limit(0)) == []


def test_union_and_unified(spark):
    df = rows(
        spark, (0, 1, "a", {"p": 1, "f": False, "n": 1, "big": 1, "L": ["x"], "l": 4}), (0, 2, "a", {"q": 1, "f": "non", "n": 2.5, "big": 10**19, "L": ["x", "y"]}),
        (0, 3, "a", {"r": 1, "f": True, "n": 7, "ok": True, "o": [{"v": 1}, {"v": None}, {"v": 3}]}), (0, 2, "b", None), (0, 3, "c", "{"), (1, 1, "a", {"q": 5}))
    union = {r.field_path: (r.union_type, r.types) for r in drift.union_schema(df).collect()}
    assert union == {
        "p": ("bigint", "number"), "q": ("bigint", "number"), "r": ("bigint", "number"), "f": ("string", "boolean,text"), "n": ("double", "number"), "big": ("double", "number"),
        "L": ("array<string>", "text"), "l": ("bigint", "number"), "ok": ("boolean", "boolean"), "o.v": ("array<bigint>", "number")}
    out = drift.unified(df, ["idweb", "stream_no", "file_seq"])
    assert out.schema["fields"].dataType.simpleString() == "struct<L:array<string>,big:double,f:string,l~2:bigint,n:double,o.v:array<bigint>,ok:boolean,q:bigint,r:bigint>"
    got = {(r.idweb, r.stream_no, r.file_seq): {k: v for k, v in r.fields.asDict().items() if v is not None} for r in out.collect()}
    assert got == {
        ("a", 0, 1): {"r": 1, "f": "non", "n": 1.0, "big": 1.0, "L": ["x"], "l~2": 4}, ("a", 0, 2): {"r": 1, "f": "non", "n": 2.5, "big": 1e19, "L": ["x", "y"]},
        ("a", 0, 3): {"r": 1, "f": "oui", "n": 7.0, "ok": True, "o.v": [1, 3]}, ("b", 0, 2): {}, ("c", 0, 3): {}, ("a", 1, 1): {"q": 5}}


def test_unified_of_nothing_and_of_null_files(spark):
    df = rows(spark, (0, 1, "a", {"p": 1}), (None, 1, "a", {"p": 1}), (0, None, "b", {"z": 1}))
    assert drift.unified(df.limit(0), ["idweb"]).count() == 0
    got = sorted(str((r.idweb, r.fields.p)) for r in drift.unified(df, ["idweb"]).collect())
    assert got == ["('a', 1)", "('a', None)", "('b', None)"]


def test_lists_beyond_the_broadcast_give_the_same(spark, monkeypatch):
    df = rows(spark, *[(s, q, k, {"x": {f"n{q}": k, "same": 1}}) for s in range(3) for q in range(1, 4) for k in "abc"])
    want, table = found(df), sorted(map(str, drift.unified(df, ["idweb", "file_seq"]).collect()))
    assert len([w for w in want if w[1] == "renamed"]) == 6
    monkeypatch.setattr(drift, "BROADCAST_PATHS", 1)
    assert found(df) == want and sorted(map(str, drift.unified(df, ["idweb", "file_seq"]).collect())) == table


def test_the_payload_is_read_once_for_renames_and_moves_nowhere(spark, data):
    df = spark.read.parquet(f"{data}/notices_engineered.parquet")
    from tressage.runtime import Scratch

    scratch, seen = Scratch(spark, "plan"), {}
    real = scratch.write

    def write(t, label="t"):
        seen[label] = t._jdf.queryExecution().executedPlan().toString()
        return real(t, label)

    scratch.write = write
    drift.changes(df, scratch=scratch).count()
    assert seen["values"].count("MapInArrow") == 1 and "BroadcastHashJoin" in seen["values"] and "MapInArrow" not in seen["renames"]
    assert not [x for x in seen["values"].splitlines() if "Exchange hashpartitioning" in x and "_p#" in x]


def test_unified_against_brute_force(spark, data):
    import pandas as pd

    df = spark.read.parquet(f"{data}/notices_engineered.parquet")
    t = pd.read_parquet(f"{data}/notices_engineered.parquet", columns=["idx", "stream_no", "file_seq", "raw_source_file", "donnees"]).drop_duplicates()
    renames = defaultdict(list)
    at = {f: (s, q) for s, q, f in zip(t.stream_no, t.file_seq, t.raw_source_file)}
    for f, kind, old, new in found(df):
        if kind == "renamed":
            renames[at[f][0]].append((at[f][1], old, new))

    def leaves(o, p=()):
        if isinstance(o, dict):
            return [x for k, v in o.items() for x in leaves(v, (*p, k))]
        return [x for v in o for x in leaves(v, p)] if isinstance(o, list) else [] if o is None else [(".".join(p), o)]

    records, kinds, many = [], defaultdict(set), set()
    for i, s, q, body in zip(t.idx, t.stream_no, t.file_seq, t.donnees):
        got = defaultdict(list)
        try:
            o = json.loads(body)
            while isinstance(o, str):
                o = json.loads(o)
        except (TypeError, ValueError):
            o = {}
        for p, v in leaves(o):
            for when, old, new in sorted(renames[s]):
                p = new if when > q and p == old else p
            got[p].append(v)
            kinds[p].add(type(v).__name__)
            many |= {p} if len(got[p]) > 1 else set()
        records.append((i, s, q, got))
    text = lambda v: {True: "oui", False: "non"}[v] if isinstance(v, bool) else str(v)
    want = sorted(str((i, s, q, sorted((p, ([text(v) for v in vs] if len(kinds[p]) > 1 else vs) if p in many else (text(vs[0]) if len(kinds[p]) > 1 else vs[0])) for p, vs in got.items()))) for i, s, q, got in records)
    out = drift.unified(df.dropDuplicates(["idx", "stream_no", "file_seq", "raw_source_file", "donnees"]), ["idx", "stream_no", "file_seq"])
    got = sorted(str((r.idx, r.stream_no, r.file_seq, sorted((k, v) for k, v in r.fields.asDict().items() if v is not None))) for r in out.collect())
    assert got == want and len(kinds) > 50


def test_against_brute_force(spark, data):
    import pandas as pd

    t = pd.read_parquet(f"{data}/notices_engineered.parquet")

    def leaves(o, p=()):
        if isinstance(o, dict):
            for k, v in o.items():
                yield from leaves(v, (*p, k))
        elif isinstance(o, list):
            for v in o:
                yield from leaves(v, p)
        elif o is not None:
            yield ".".join(p), o

    types, values, names = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(dict)), {}
    for s, q, f, k, body in zip(t.stream_no, t.file_seq, t.raw_source_file, t.idweb, t.donnees):
        names[s, q] = f
        try:
            o = json.loads(body, parse_int=lambda x: ("#", x), parse_float=lambda x: ("#", x))
            o = json.loads(o, parse_int=lambda x: ("#", x), parse_float=lambda x: ("#", x)) if isinstance(o, str) else o
        except (TypeError, ValueError):
            continue
        got = defaultdict(list)
        for p, v in leaves(o):
            types[s, q][p].add("n" if isinstance(v, tuple) else type(v).__name__)
            got[p].append(v[1] if isinstance(v, tuple) else {True: "oui", False: "non"}.get(v, v) if isinstance(v, bool) else v)
        for p, v in got.items():
            values[s, q][k][p] = v
    want = set()
    for (s, q), f in names.items():
        if (s, q - 1) not in names:
            continue
        a, b, used = types[s, q - 1], types[s, q], set()
        for g in a.keys() - b.keys():
            for n in b.keys() - a.keys():
                if g.rpartition(".")[0] == n.rpartition(".")[0]:
                    pairs = [(values[s, q - 1][k][g], values[s, q][k][n]) for k in values[s, q - 1].keys() & values[s, q].keys() if g in values[s, q - 1][k] and n in values[s, q][k]]
                    if pairs and all(x == y for x, y in pairs):
                        want.add((f, "renamed", g, n))
                        used |= {g, n}
        want |= {(f, "added", n, "") for n in b.keys() - a.keys() - used} | {(f, "removed", g, "") for g in a.keys() - b.keys() - used} | {(f, "retyped", p, "") for p in a.keys() & b.keys() if a[p] != b[p]}
    assert set(found(spark.read.parquet(f"{data}/notices_engineered.parquet"))) == want and want
