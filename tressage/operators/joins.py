"""Joins with a contract on the cardinality of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_by(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, failing when it runs if a key occurs twice; the window shares its partitioning with a join on the keys."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ok = F.when(n > 1, F.raise_error(F.concat(F.lit(f"{what}: repeated key "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))).otherwise(F.lit(True))
    return df.withColumn("_ok", ok.cast("boolean")).where("_ok").drop("_ok")


def asserted_join(left: DataFrame, right: DataFrame, keys: list[str], relation: str = "many_to_one", how: str = "inner") -> DataFrame:
    """A join that fails if the sides are not related as told: one_to_one, many_to_one, one_to_many."""
    if relation in ("one_to_one", "one_to_many"):
        left = unique_by(left, keys, "left side")
    if relation in ("one_to_one", "many_to_one"):
        right = unique_by(right, keys, "right side")
    return left.join(right, keys, how)
