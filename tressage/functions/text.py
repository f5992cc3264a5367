"""Text expressions; all stay inside whole-stage codegen.  Null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for nothing.
EMPTY_MARKS = ("", "none", "null", "nan", "<na>", "[]", "{}")
#: Legal-form words that carry no identity when buyers are compared.
GENERIC_BUYER = r"\b(commune de|ville de|mairie de|departement de|departement|region|conseil regional|conseil departemental)\b"
#: Words of associations of municipalities that the superseded key drops.
ASSOCIATION = r"\b(metropole|communaute de communes|communaute d agglomeration|communaute urbaine)\b"
#: Fixed value: what people type where a reference is missing.
REFERENCE_NOISE = (
    r"(?i)^(sans objet|neant|n/?a|non renseigne|aucun|fra|dce|voir( dce)?|cf\.?|org\s*[0-9]+|tpo\s*[0-9]+|"
    r"default[_ ]value[_ ]change[_ ]me|documents?( de| du)? march[eé]|https?\b.*|www\b.*)$"
)
#: Fixed value: an eight-digit code with an optional check digit.
CODE = r"(?<![0-9])([0-9]{8})(?:-[0-9])?(?![0-9])"
#: Fixed value: a notice's number.
NOTICE_ID = r"(?<![0-9])([0-9]{2}-[0-9]+)(?![0-9])"
#: Fixed value: a number as people write it.
NUMERAL = r"-?[0-9]+(?:[\s ][0-9]{3})*(?:[.,][0-9]+)?"


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Every letter below U+0250 whose canonical decomposition is a plain letter and marks, and that letter."""
    pairs = []
    for i in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(i), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def is_blank(x: Column) -> Column:
    """Null, or only white space, or a mark of emptiness."""
    return x.isNull() | F.lower(F.trim(x)).isin(*EMPTY_MARKS)


def without_accents(x: Column) -> Column:
    a, b = _accents()
    return F.regexp_replace(F.translate(x, a, b), r"\p{M}+", "")


def trimmed(x: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


#: What compatibility composition or case folding may change beyond lower case: marks, forms and signs.
_COMPATIBLE = "[^\u0000-\u017f]|[\u00a8\u00aa\u00af\u00b2-\u00b5\u00b8-\u00ba\u00bc-\u00be\u00df\u0130\u0132\u0133\u013f\u0140\u0149\u017f]"


def compatible(x: Column, fold: bool = False) -> Column:
    """Compatibility composed (NFKC), and case folded if asked; other texts never leave the JVM."""
    import pandas as pd

    def compose(v):
        made = [None if t is None else unicodedata.normalize("NFKC", t) for t in v]
        return pd.Series([t and t.casefold() for t in made] if fold else made, dtype=object)

    compose.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.coalesce(F.pandas_udf(compose, "string")(F.when(x.rlike(_COMPATIBLE), x)), F.lower(x) if fold else x)


def name_key(x: Column) -> Column:
    """Compatibility composed and case folded words of letters, digits and underscores separated by one space; accents stay."""
    return word_key(compatible(x, fold=True))


def word_key(x: Column) -> Column:
    """Words of letters, digits and underscores of a composed and folded text, separated by one space."""
    return F.trim(F.regexp_replace(x, r"(?U)[^\w]+", " "))


def document_text(x: Column) -> Column:
    """Compatibility composed, white space of any kind squeezed to one blank."""
    return squeeze(compatible(x))


def archived_key(x: Column) -> Column:
    """The blocking key also without the words of associations of municipalities; superseded, and in no other key."""
    return F.trim(F.regexp_replace(F.regexp_replace(blocking_key(x), ASSOCIATION, " "), " +", " "))


def text_key(x: Column) -> Column:
    """Lower case ASCII words separated by one space; accents are removed."""
    return F.trim(F.regexp_replace(without_accents(F.lower(x)), "[^a-z0-9]+", " "))


def blocking_key(x: Column) -> Column:
    """The text key without generic words of public bodies."""
    return F.trim(F.regexp_replace(F.regexp_replace(text_key(x), GENERIC_BUYER, " "), " +", " "))


def reference_key(x: Column, composed: bool = False) -> Column:
    """The name key, or empty if it is shorter than three characters or says nothing; ``composed``: see :func:`word_key`."""
    k = word_key(x) if composed else name_key(x)
    return F.when((F.length(k) < 3) | k.rlike(REFERENCE_NOISE), F.lit("")).otherwise(k)


def name_tokens(x: Column) -> Column:
    """Distinct words of four characters or more that are not numbers."""
    return F.array_distinct(F.filter(F.split(x, " "), lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct values; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def codes(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(CODE), F.lit(1)))


def notice_ids(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(NOTICE_ID), F.lit(1)))


def prefixes(c: Column, n: int) -> Column:
    return F.sort_array(F.array_distinct(F.transform(c, lambda v: F.substring(v, 1, n))))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_valid(x: Column) -> Column:
    """Nine or fourteen digits whose Luhn sum holds."""
    d = digits(x)
    return F.length(d).isin(9, 14) & F.call_function("luhn_check", d)


def buyer_identifier(x: Column) -> Column:
    """struct(siret, siren, kind) of a valid identifier; blanks otherwise."""
    d, ok = digits(x), F.coalesce(luhn_valid(x), F.lit(False))
    long_, short = ok & (F.length(d) == 14), ok & (F.length(d) == 9)
    return F.struct(
        F.when(long_, d).otherwise("").alias("siret"), F.when(long_, F.substring(d, 1, 9)).when(short, d).otherwise("").alias("siren"),
        F.when(long_, "siret").when(short, "siren").otherwise("").alias("kind"))


def postcode_department(x: Column) -> Column:
    """The department of a five-digit postcode, overseas and Corsican ones included; empty otherwise."""
    p = F.trim(x)
    return (
        F.when(~p.rlike("^[0-9]{5}$") | p.isNull(), F.lit(""))
        .when(F.substring(p, 1, 3).isin("971", "972", "973", "974", "976"), F.substring(p, 1, 3))
        .when(F.substring(p, 1, 2) == "20", F.lit("2A/2B"))
        .otherwise(F.substring(p, 1, 2))
    )


def department_code(x: Column) -> Column:
    """2A or 2B, or the first run of digits, padded to two."""
    t = F.upper(F.regexp_replace(F.trim(x), "[\"']", ""))
    run = F.regexp_extract(t, "([0-9]+)", 1)
    return F.when(t.isin("2A", "2B"), t).when(run == "", F.lit("")).otherwise(F.when(run.cast("int") < 100, F.lpad(run.cast("int").cast("string"), 2, "0")).otherwise(run.cast("int").cast("string")))


def numeral(x: Column) -> Column:
    """The first number in a text, with a decimal comma or point and spaces between thousands."""
    m = F.regexp_extract(F.regexp_replace(x, " ", " "), NUMERAL, 0)
    return F.when(m == "", F.lit(None).cast("double")).otherwise(F.regexp_replace(F.regexp_replace(m, r"\s", ""), ",", ".").try_cast("double"))


#: Words of a municipality, and of an association of them.
TOWN_WORDS, UNION_WORDS = r"\b(commune|ville|mairie)\b", "metropole|métropole|communaute|communauté|agglomeration|agglomération|epci"


def legal_family(x: Column) -> Column:
    t = F.coalesce(x, F.lit(""))
    town = t.rlike(f"(?iu){TOWN_WORDS}")
    union = t.rlike(rf"(?iu)(?<![\p{{L}}])({UNION_WORDS})(?![\p{{L}}])")
    return F.when(town & union, "mixed_label").when(town, "municipal").when(union, "intercommunal").otherwise("other")


def keyword_hits(x: Column, words: list[str]) -> Column:
    """Sorted distinct keywords that occur as whole words or phrases of a text key."""
    padded = F.concat(F.lit(" "), x, F.lit(" "))
    found = F.array(*[F.when(F.contains(padded, F.lit(f" {w} ")), F.lit(w)) for w in words])
    return F.sort_array(F.array_compact(found))
