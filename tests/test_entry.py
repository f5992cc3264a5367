import os
import re
import unicodedata

import __spark_entry__ as entry
import duckdb
import pytest

from tressage.functions import scores, text

from pyspark.sql import functions as F


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    return con


def plain(v):
    """A value as text: doubles to six places, arrays by their elements."""
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_rows_agree_with_sql(spark, data, duck, name):
    """Row for row and value for value, in any order."""
    got, rel = entry.queries()[name](spark, data), duck.sql(entry.oracle_sql()[name])
    columns = sorted(rel.columns)
    assert sorted(got.columns) == columns
    found = sorted(str([plain(v) for v in r]) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    want = sorted(str([plain(v) for v in r]) for r in rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert found == want


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ville de  Béziers ", "00135792400012", "20090", "12 345,50 €"), (None, None, None, None), ("", "x", "97412", "")], "a string, b string, c string, d string")
    got = df.select(text.text_key(F.col("a")), text.blocking_key(F.col("a")), text.buyer_identifier(F.col("b"))["kind"], text.postcode_department(F.col("c")), text.numeral(F.col("d")), text.is_blank(F.col("a"))).collect()
    assert tuple(got[0])[:2] == ("ville de beziers", "beziers") and got[0][3] == "2A/2B" and got[0][4] == 12345.5 and got[0][5] is False
    assert got[1][5] is True and got[2][3] == "974" and got[2][4] is None


def test_scores_leave_out_what_is_not_observable(spark):
    df = spark.createDataFrame([(1.0, 0.0, None, float("nan")), (None, None, None, None), (2.0, 1.0, 1.0, 1.0)], "b double, t double, c double, m double")
    parts = {"buyer": F.col("b"), "text": F.col("t"), "cpv": F.col("c"), "time": F.col("m")}
    got = [tuple(r) for r in df.select(F.round(scores.weighted_score(parts), 4), scores.completeness(*parts.values()), scores.level(F.col("t"), *scores.TEXT_LEVELS)).collect()]
    assert got == [(66.6667, 2, "text<0.05"), (None, 0, "missing"), (100.0, 4, "text>=0.50")]


def test_keys_are_composed_and_folded(spark):
    df = spark.createDataFrame([("ﬁnances Straße É",), ("e\u0301cole",), ("Ville ①",), (None,), ("déjà vu",), ("İ",)], "a string")
    got = [r.k for r in df.select(text.name_key(F.col("a")).alias("k")).collect()]
    want = [None if v is None else " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", v).casefold())) for (v,) in df.collect()]
    assert got[:5] == want[:5] and got[0] == "finances strasse é"
    assert df.select(text.document_text(F.lit("a\u00a0\u2003b ½"))).first()[0] == "a b 1⁄2"
    assert df.select(text.archived_key(F.lit("Communauté de communes de Bru Métropole"))).first()[0] == "de bru"


def test_approximate_counts_are_close(spark, data):
    rows = entry.queries()["approximate_distinct"](spark, data).collect()
    assert len(rows) == 5 and all(r.close for r in rows)
