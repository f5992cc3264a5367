"""Deeply nested records into related flat tables with parent and child links.

Each record is streamed as (path, value, ordinals) triples (:mod:`tressage.functions.jsonwalk`); the object itself is
never built.  A :class:`TableSpec` names a repeated ancestor by its path; triples below it are grouped by the ordinals
of that ancestor and of the repeated ancestors above it, and pivoted into one row a group: the link to the parent
row is the parent's ordinals.  An object where other records have a list counts as a list of one.

Everything happens within the record, so flattening takes no shuffle; only telling repeated deliveries
apart does.  Paths are resolved once a task, not once a record, each from the path above it.

Defined results: null, damaged or incomplete JSON gives no rows; a JSON text encoded again as a string, however often,
is unwrapped; null values are absent; unknown paths are ignored; a key that comes twice in an object counts twice;
records may be of any depth and length.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonwalk import Numeral, PathNode, ordinal, stream, triples
from ..functions.text import CODE
from ..runtime import python_rows


class TableSpec(NamedTuple):
    """A flat table: rows are the occurrences of ``ancestor``, columns the scalars at paths relative to it.

    Paths are keys joined by dots; ``*`` stands for any one key and ``**`` for any number of them; several paths may be
    given.  ``parents`` are the repeated ancestors above, outermost first, whose ordinals link a row to its parent's row.
    """

    name: str
    ancestor: str | tuple[str, ...]
    columns: dict[str, str | tuple[str, ...]]
    parents: tuple[str, ...] = ()


class Paths:
    """A set of paths that is matched key by key: a state is the places reached so far in each of them."""

    def __init__(self, paths: str | tuple[str, ...]):
        self.paths = [tuple(p.split(".")) if p else () for p in ((paths,) if isinstance(paths, str) else paths)]
        self.start = self._open({(i, 0) for i in range(len(self.paths))})

    def _open(self, places: set) -> frozenset:
        out, todo = set(), list(places)
        while todo:
            i, k = todo.pop()
            out.add((i, k))
            if k < len(self.paths[i]) and self.paths[i][k] == "**":
                todo.append((i, k + 1))
        return frozenset(out)

    def step(self, state: frozenset, key: str) -> frozenset:
        if not state:
            return state
        out = set()
        for i, k in state:
            want = self.paths[i][k] if k < len(self.paths[i]) else None
            if want == "**":
                out.add((i, k))
            elif want is not None and want in ("*", key):
                out.add((i, k + 1))
        return self._open(out)

    def met(self, state: frozenset) -> bool:
        return any(k == len(self.paths[i]) for i, k in state)


class Flattener:
    """Pivots triples into the tables of the specs; one a task, as it keeps the path tree."""

    def __init__(self, specs: tuple[TableSpec, ...]):
        self.specs = [(s.name, Paths(s.ancestor), tuple(map(Paths, s.parents)), {c: Paths(p) for c, p in s.columns.items()}) for s in specs]
        self.root = PathNode()
        self.root.role = ((), tuple((a.start, tuple((p.start, None) for p in ps), (), None) for _, a, ps, _ in self.specs))

    def _below(self, node: PathNode, above: tuple) -> tuple:
        """The role of a path from that of the path above it: (table, column, nodes of the repeated ancestors outermost
        first) for each table it feeds, and what its own children need."""
        feeds, states = [], []
        for (name, ancestor, parents, columns), (state, ups, inside, chain) in zip(self.specs, above):
            state = ancestor.step(state, node.key)
            ups = tuple((t := p.step(q, node.key), node if p.met(t) else n) for p, (q, n) in zip(parents, ups))
            if ancestor.met(state):
                inside, chain = tuple(p.start for p in columns.values()), (*[n for _, n in ups if n is not None and n is not node], node)
            elif inside:
                inside = tuple(p.step(q, node.key) for p, q in zip(columns.values(), inside))
            feeds += [(name, c, chain) for (c, p), q in zip(columns.items(), inside) if p.met(q)]
            states.append((state, ups, inside, chain))
        return tuple(feeds), tuple(states)

    def _feeds(self, node: PathNode) -> tuple:
        todo = []
        while node.role is None:
            todo.append(node)
            node = node.parent
        role = node.role
        for node in reversed(todo):
            role = node.role = self._below(node, role[1])
        return role[0]

    def tables(self, text: str | None) -> dict[str, dict[tuple[int, ...], dict[str, list]]]:
        """table -> ordinals of the row (the parents' first) -> column -> values in document order."""
        out: dict[str, dict] = {name: {} for name, *_ in self.specs}
        for node, v, ords in triples(text, self.root) or ():
            if v is None:
                continue
            for name, column, above in (node.role or (self._feeds(node),))[0]:
                key = tuple([ordinal(ords, a) for a in above])
                out[name].setdefault(key, {}).setdefault(column, []).append(v)
        return out


def flatten(df: DataFrame, key: str, payload: str, specs: tuple[TableSpec, ...]) -> DataFrame:
    """(key, table_name, ordinals, fields): the rows of all tables of ``specs`` for every record, long form.

    ``ordinals`` are the place of the row and of its parents' rows, outermost first; ``fields`` maps a column to
    its values as text, in document order.
    """
    kind = dict(df.dtypes)[key]
    state: list[Flattener] = []

    def kernel(cols):
        if not state:
            state.append(Flattener(specs))
        keys, names, ords, fields = [], [], [], []
        for k, text in zip(cols["_k"], cols["_p"]):
            for name, rows in state[0].tables(text).items():
                for o, row in rows.items():
                    keys.append(k), names.append(name), ords.append(list(o))
                    fields.append([(c, [x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x) for x in v]) for c, v in row.items()])
        return {key: keys, "table_name": names, "ordinals": ords, "fields": fields}

    rows = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{payload}`").cast("string").alias("_p"))
    return python_rows(rows, kernel, f"`{key}` {kind}, table_name string, ordinals array<int>, fields map<string, array<string>>")


# --- procurement notices ---------------------------------------------------------------------------------------

def _or_text(*paths: str) -> tuple[str, ...]:
    """Paths whose scalar may stand in an object beside its attributes."""
    return tuple(x for p in paths for x in (p, f"{p}.#text"))


_CPV_CODE = "cbc:ItemClassificationCode"
_ORGANIZATION = "EFORMS.*.**.efac:Organizations.efac:Organization"

#: The five layouts: where lots, their codes and tenderers stand, and the tables that pointers lead to.
NOTICE_TABLES = (
    TableSpec("lot", ("EFORMS.*.cac:ProcurementProjectLot", "FNSimple.**.lots.lot", "MAPA.**.lots.lot", "DIVERS.**.lots.lot", "OBJET.LOTS.LOT"), {
        "label": (*_or_text("cbc:ID"), "numLot", "NUM"),
        "main": (*_or_text(f"cac:ProcurementProject.cac:MainCommodityClassification.{_CPV_CODE}"), "cpv.principal", "CPV.PRINCIPAL"),
        "further": (*_or_text(f"cac:ProcurementProject.cac:AdditionalCommodityClassification.{_CPV_CODE}"), "cpv.additionnel", "CPV.SUPPLEMENTAIRE", "cpv.code", "cpv", "CPV"),
        "tenderer": ("attribution.titulaire", "attribution.titulaire.nom"),
    }),
    TableSpec("award", ("EFORMS.*.**.efac:NoticeResult.efac:LotResult", "ATTRIBUTION.DECISION"), {
        "label": (*_or_text("efac:TenderLot.cbc:ID"), "NUM_LOT"),
        "pointer": _or_text("efac:TenderingParty.efac:Tenderer.cbc:ID"),
        "tenderer": ("TITULAIRE", "TITULAIRE.DENOMINATION"),
    }),
    TableSpec("company", f"{_ORGANIZATION}.efac:Company", {
        "label": _or_text("cac:PartyIdentification.cbc:ID"),
        "name": _or_text("cac:PartyName.cbc:Name"),
    }, parents=(_ORGANIZATION,)),
)

_code = re.compile(CODE)


def _codes(values) -> list[str]:
    """The eight digits of each code; a code that lost its leading zero as a number gets it back."""
    out = []
    for v in values:
        m = _code.search(v.zfill(8) if isinstance(v, Numeral) and v.isdigit() else str(v))
        if m:
            out.append(m.group(1))
    return out


def _label(v) -> str:
    return str(v).strip()


def _notice_codes(text: str | None) -> list[str]:
    """The codes of ``cpv_codes_json`` in any of its shapes, as they stand."""
    if not text or not text.strip():
        return []
    try:
        values = [v for _, v, _ in stream(text, PathNode())]
    except ValueError:
        return _code.findall(text)
    if len(values) == 1 and isinstance(values[0], str) and not isinstance(values[0], Numeral):
        return _code.findall(values[0])
    return _codes([v for v in values if v is not None and not isinstance(v, bool)])


def notice_items(tables: dict, codes_json: str | None) -> list[tuple[int, str, int, str]]:
    """(lot_ord, entity, item_ord, item) of one notice from its flat tables."""
    out = [(0, "cpv", i, c) for i, c in enumerate(_notice_codes(codes_json), 1)]
    names = {}
    for row in tables["company"].values():
        for label in row.get("label", ())[:1]:
            names.setdefault(_label(label), row.get("name", [None])[0])
    lots, place = tables["lot"], {}
    tenderers: dict[int, list[str]] = {}
    for (o, *_), row in lots.items():
        for label in row.get("label", ())[:1]:
            place.setdefault(_label(label), o)
        for i, c in enumerate(_codes(row.get("main", [])) + _codes(row.get("further", [])), 1):
            out.append((o, "cpv", i, c))
        if "tenderer" in row:
            tenderers.setdefault(o, []).extend(row["tenderer"])
    for row in tables["award"].values():
        found = [*row.get("tenderer", ()), *[names.get(_label(p)) for p in row.get("pointer", ())]]
        for o in dict.fromkeys(place.get(_label(label)) if label is not None else (1 if len(lots) == 1 else None) for label in row.get("label", [None])):
            if o is not None:
                tenderers.setdefault(o, []).extend(found)
    for o, found in tenderers.items():
        kept = [x for t in found if t is not None and (x := str(t).strip())]
        out.extend((o, "tenderer", i, t) for i, t in enumerate(kept, 1))
    return out


def notice_rows(df: DataFrame, key: str = "idweb", payload: str = "donnees", codes: str = "cpv_codes_json") -> DataFrame:
    """(key, lot_ord, entity, item_ord, item): codes and tenderers of each notice, once however often delivered.

    ``lot_ord`` is 0 for the codes of the whole notice.  Null keys are dropped.
    """
    state: list[Flattener] = []

    def kernel(cols):
        if not state:
            state.append(Flattener(NOTICE_TABLES))
        out = {"_k": [], "lot_ord": [], "entity": [], "item_ord": [], "item": []}
        add = [out[c].append for c in out]
        for k, text, extra in zip(cols["_k"], cols["_p"], cols["_c"]):
            for row in set(notice_items(state[0].tables(text), extra)):
                for f, v in zip(add, (k, *row)):
                    f(v)
        return out

    rows = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("string").alias("_k"), F.col(f"`{payload}`").cast("string").alias("_p"), F.col(f"`{codes}`").cast("string").alias("_c"))
    flat = python_rows(rows, kernel, "_k string, lot_ord int, entity string, item_ord int, item string")
    return flat.dropDuplicates().withColumnRenamed("_k", key)
