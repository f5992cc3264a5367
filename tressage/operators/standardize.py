"""Notices in five nested layouts into one typed row; what cannot be told for certain stays empty.

The payload is streamed once as (path, value, ordinals) triples in document order; fields are chosen by the ends of
paths, and everything after that is expressions.

Defined results: null or damaged payloads give empty fields and null numbers; two different identifiers of one notice
give none; two different durations give null and "conflict"; values repeat once, in document order.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.jsonwalk import PathNode, places, triples
from ..runtime import python_rows

_FIELDS = {
    "names": r"(?:.*\.)?(?:nomOfficiel|nomOrganisme|organisme\.nom|IDENTITE\.DENOMINATION|cac:PartyName\.cbc:Name(?:\.#text)?)",
    "identifiers": r"(?:.*\.)?(?:codeIdentificationNational|codeIdentNational|CODE_IDENT_NATIONAL|cac:PartyLegalEntity\.cbc:CompanyID(?:\.#text)?)",
    "postcodes": r"(?:.*\.)?(?:organisme\.(?:cp|codePostal)|adr\.cp|IDENTITE\.CP|cbc:PostalZone(?:\.#text)?)",
    "references": r"OBJET\.REF_MARCHE|(?:FNSimple|MAPA|DIVERS|DSP)\..*(?:numeroReference|refDossier)|EFORMS\.[^.]+\.cbc:ContractFolderID(?:\.#text)?",
    "principal": r"(?:.*\.)?(?:cpv\.principal|CPV\.PRINCIPAL|cac:MainCommodityClassification\.cbc:ItemClassificationCode(?:\.#text)?)",
    "codes": r"(?:.*\.)?(?:(?:cpv|CPV)(?:\.[^.]+)?|cac:(?:Main|Additional)CommodityClassification\.cbc:ItemClassificationCode(?:\.#text)?)",
    "titles": r"(?i)(?:.*\.)?(?:intitule|title|cbc:name(?:\.#text)?)",
    "descriptions": r"(?i)(?:.*\.)?(?:description[^.]*|objet_?complet|texteLibre|corps|cbc:description(?:\.#text)?|cbc:summary(?:\.#text)?)",
    "months": r"(?i)(?:.*\.)?(?:duree_?mois|duree)",
    "amounts": r"(?i)(?:.*\.)?(?:valeur(?:Estimee)?|montant|cbc:EstimatedAmount(?:\.#text)?)",
}
_CPV = re.compile(text.CODE)
#: Fields whose texts are compatibility composed where they are read.
COMPOSED = ("references", "titles", "descriptions")
#: The most amounts kept of a notice.
MOST_AMOUNTS = 50


def _lists(df: DataFrame, key: str, payload: str) -> DataFrame:
    patterns = {k: re.compile(p) for k, p in _FIELDS.items()}
    root: list[PathNode] = []
    kind = dict(df.dtypes)[key]

    def kernel(cols):
        if not root:
            root.append(PathNode())
        out: dict[str, list] = {key: [], "layout": [], **{k: [] for k in patterns}}
        for k, body in zip(cols["_k"], cols["_p"]):
            found = triples(body, root[0])
            got: dict[str, list[str]] = {f: [] for f in patterns}
            own: set[str | None] = set()
            parties: list[tuple] = []
            for node, v, ords in found or ():
                if v is None:
                    continue
                if node.role is None:
                    node.role = (tuple(f for f, p in patterns.items() if p.fullmatch(node.text)), node.text.endswith("cac:ContractingParty.cac:Party.cac:PartyIdentification.cbc:ID"), "efac:Company" in node.text, node.text.endswith("efac:Company.cac:PartyIdentification.cbc:ID"))
                fields, contracting, company, label = node.role
                s = ("true" if v else "false") if isinstance(v, bool) else str(v).strip()
                if contracting:
                    own.add(s)
                if label:
                    parties.append((places(ords), s))
                for f in fields:
                    if s and (f not in ("names", "identifiers", "postcodes") or not company):
                        got[f].append(s)
                    elif s:
                        parties.append((places(ords), f, s))
            ids = {p[0]: p[1] for p in parties if len(p) == 2}
            for p in parties:  # organisations of a table count if they are a contracting party
                if len(p) == 3 and any(ids.get(p[0][:i]) in own for i in range(len(p[0]) + 1)):
                    got[p[1]].append(p[2])
            out[key].append(k)
            out["layout"].append([*found[0][0].up()][-1].key if found and found[0][0].parent is not None else None)
            for f, vs in got.items():
                vs = [c for x in vs for c in _CPV.findall(x.zfill(8) if x.isdigit() else x)] if f in ("codes", "principal") else vs
                if f in COMPOSED:
                    vs = [unicodedata.normalize("NFKC", x) for x in vs]
                out[f].append(list(dict.fromkeys([x.casefold() for x in vs] if f == "references" else vs)))
        return out

    rows = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{payload}`").cast("string").alias("_p"))
    return python_rows(rows, kernel, f"`{key}` {kind}, layout string, " + ", ".join(f"{f} array<string>" for f in patterns))


def standardise(df: DataFrame, key: str = "idx", payload: str = "donnees") -> DataFrame:
    """One typed row a record: layout, buyer (name, identifier, postcode, department, key), codes, text, reference, duration, amounts."""
    r = _lists(df, key, payload)
    one = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1)).otherwise("")
    sirens = F.array_distinct(F.filter(F.transform("identifiers", lambda v: text.buyer_identifier(v)["siren"]), lambda v: v != ""))
    departments = F.array_distinct(F.filter(F.transform("postcodes", text.postcode_department), lambda v: v != ""))
    numbers = lambda c: F.filter(F.transform(c, text.numeral), lambda v: v.isNotNull())
    months = F.array_distinct(F.transform(F.filter(numbers("months"), lambda v: (v > 0) & (v <= 240)), lambda v: F.round(v, 2)))
    amounts = F.slice(F.array_distinct(F.filter(numbers("amounts"), lambda v: (v >= 0) & (v <= 1e11))), 1, MOST_AMOUNTS)
    lines = F.array_distinct(F.transform(F.concat("titles", "descriptions"), text.squeeze))
    r = r.withColumns({"_s": sirens, "_d": departments, "_m": months, "_n": F.coalesce(F.get("names", F.lit(0)), F.lit(""))})
    reference = F.coalesce(F.get(F.filter(F.transform("references", lambda v: text.reference_key(v, composed=True)), lambda v: v != ""), F.lit(0)), F.lit(""))
    return r.select(
        key, "layout", F.col("_n").alias("buyer_name"), F.when(F.size("_s") == 1, F.col("_s")[0]).otherwise("").alias("buyer_siren"), (F.size("_s") > 1).alias("identifier_conflict"),
        F.when(F.size("_d") == 1, F.col("_d")[0]).otherwise("").alias("buyer_department"), one("postcodes").alias("buyer_postcode"),
        F.when(F.size("_s") == 1, F.concat(F.lit("siren:"), F.col("_s")[0])).when(F.col("_n") != "", F.concat(F.lit("name:"), text.name_key(F.col("_n")))).otherwise("").alias("buyer_key"),
        F.coalesce(F.get("principal", F.lit(0)), F.get("codes", F.lit(0)), F.lit("")).alias("main_code"), F.col("codes").alias("all_codes"), reference.alias("reference"),
        F.concat_ws("\n", lines).alias("notice_text"), text.name_key(F.concat_ws(" ", lines)).rlike(r"\b(accord cadre|framework agreement)\b").alias("framework_flag"),
        F.when(F.size("_m") == 1, F.col("_m")[0]).alias("duration_months"), F.when(F.size("_m") == 1, "typed_consensus").when(F.size("_m") > 1, "conflict").otherwise("unresolved").alias("duration_quality"), amounts.alias("amounts"))
