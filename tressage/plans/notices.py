"""Notice records: flat tables from nested payloads, drifting schemas, several values in a cell."""

from __future__ import annotations

from ..operators import cells, drift, nested
from ..runtime import table
from .registry import Registry

Q = Registry()


@Q.query()
def p2_found(spark, d):
    return nested.notice_rows(table(spark, d, "notices_engineered"))


@Q.query()
def p4_found(spark, d):
    return drift.changes(table(spark, d, "notices_engineered"))


@Q.query()
def p4_union_schema(spark, d):
    return drift.union_schema(table(spark, d, "notices_engineered"))


@Q.query()
def p4_unified(spark, d):
    return drift.unified(table(spark, d, "notices_engineered"), ["idx", "idweb", "stream_no", "file_seq", "raw_source_file"])


@Q.query()
def p2_tables(spark, d):
    """The flat tables of every distinct payload, long form, with the ordinals that link rows to their parents."""
    return nested.flatten(table(spark, d, "notices_engineered").select("idx", "donnees").distinct(), "idx", "donnees", nested.NOTICE_TABLES)


@Q.query()
def p6_found(spark, d):
    fields = ["code_departement", "descripteur_code", "type_marche"]
    return cells.split_cells(table(spark, d, "notices_engineered"), "idweb", fields).drop("flags")


@Q.query()
def p6_all_values(spark, d):
    """Every value of the packed fields, single ones and error flags included."""
    fields = ["code_departement", "descripteur_code", "type_marche"]
    return cells.split_cells(table(spark, d, "notices_engineered"), "idweb", fields, several_only=False)
