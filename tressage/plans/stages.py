"""A pipeline as declared stages: names, inputs, a builder and checks that must hold; and the I/O and stream queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import standardize
from ..runtime import Scratch, table
from ..sources import files
from ..streaming import events
from .registry import Registry

Q = Registry()


class Stage(NamedTuple):
    name: str
    inputs: tuple[str, ...]
    build: Callable[[dict[str, DataFrame]], DataFrame]
    checks: dict[str, Callable[[DataFrame], object]] = {}


def run_stages(spark: SparkSession, stages: list[Stage], sources: dict[str, DataFrame], folder: str, force: bool = False) -> tuple[dict[str, DataFrame], list[tuple]]:
    """Builds each stage once into ``folder`` and evaluates its checks; complete stages are reused unless forced.

    A failed check raises after it is recorded, so that nothing is built upon it.
    """
    done, log = dict(sources), []
    jvm = spark.sparkContext._jvm
    for s in stages:
        path = f"{folder}/{s.name}"
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        complete = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        if force or not complete:
            files.write_parquet(s.build({i: done[i] for i in s.inputs}), path, overwrite=True)
        done[s.name] = spark.read.parquet(path)
        for name, check in s.checks.items():
            ok = bool(done[s.name].agg(check(done[s.name]).alias("ok")).first().ok)
            log.append((s.name, name, ok, "reused" if complete and not force else "built"))
            if not ok:
                raise ValueError(f"stage {s.name}: {name} does not hold")
    return done, log


_STAGES = [
    Stage("awards", ("orders",), lambda t: t["orders"].where("o_orderstatus = 'F'"), {"unique": lambda d: F.count_distinct("o_orderkey") == F.count(F.lit(1)), "priced": lambda d: F.bool_and(F.col("o_totalprice") > 0)}),
    Stage("by_customer", ("awards", "customer"), lambda t: t["awards"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n")), {"unique": lambda d: F.count_distinct("c_custkey") == F.count(F.lit(1))}),
]


@Q.query("SELECT * FROM (VALUES ('awards', 'priced', true), ('awards', 'unique', true), ('by_customer', 'unique', true)) t(stage, name, ok)")
def stage_checks(spark, d):
    scratch = Scratch(spark, "stages")
    _, log = run_stages(spark, _STAGES, {t: table(spark, d, t) for t in ("orders", "customer")}, scratch.root)
    return spark.createDataFrame([x[:3] for x in log], "stage string, name string, ok boolean")


@Q.query("SELECT idweb, nomacheteur, donnees FROM notices_engineered")
def read_jsonl_strict(spark, d):
    path = f"{Scratch(spark, 'jsonl').root}/notices"
    table(spark, d, "notices_engineered").select("idweb", "nomacheteur", "donnees").write.json(path)
    return files.read_jsonl(spark, path, files.all_strings(["idweb", "nomacheteur", "donnees"]))


@Q.query("SELECT idweb, coalesce(objet, '') AS objet, coalesce(descripteur_code, '') AS descripteur_code FROM notices_engineered")
def csv_roundtrip(spark, d):
    path = f"{Scratch(spark, 'csv').root}/notices"
    files.write_csv(table(spark, d, "notices_engineered").select("idweb", "objet", "descripteur_code"), path)
    return files.read_csv_text(spark, path, ["idweb", "objet", "descripteur_code"])


@Q.query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def partitioned_roundtrip(spark, d):
    path = f"{Scratch(spark, 'years').root}/orders"
    files.write_parquet(table(spark, d, "orders").withColumn("year", F.year("o_orderdate")), path, by=["year"])
    return spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@Q.query("SELECT CAST(y AS INT) AS year, count(o_orderkey) AS n, 1::BIGINT AS schemas FROM (SELECT unnest(generate_series(1993, 2003)) AS y) LEFT JOIN orders ON year(o_orderdate) = y GROUP BY 1")
def yearly_files(spark, d):
    """A folder of files a year, also for years without orders, all of one schema."""
    path = f"{Scratch(spark, 'yearly').root}/orders"
    files.write_years(table(spark, d, "orders").withColumn("year", F.year("o_orderdate")), path, "year", range(1993, 2004))
    f = files.footers(spark, path).select(F.regexp_extract("folder", "year=([0-9]+)", 1).cast("int").alias("year"), "rows", "columns")
    return f.groupBy("year").agg(F.sum("rows").alias("n"), F.count_distinct("columns").alias("schemas"))


@Q.query("SELECT 'all' AS part, count(*) AS n FROM orders UNION ALL SELECT 'large', count(*) FROM orders WHERE o_totalprice > 400000")
def fan_out(spark, d):
    root = Scratch(spark, "fan").root
    files.write_several(table(spark, d, "orders"), {f"{root}/all": None, f"{root}/large": F.col("o_totalprice") > 400000})
    count = lambda p: spark.read.parquet(f"{root}/{p}").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"))
    return count("all").unionByName(count("large"))


@Q.query("SELECT 1::BIGINT AS schemas, count(*) AS rows FROM orders")
def footer_inspection(spark, d):
    path = f"{Scratch(spark, 'footers').root}/orders"
    files.write_parquet(table(spark, d, "orders").repartition(4), path)
    return files.footers(spark, path).agg(F.count_distinct("columns").alias("schemas"), F.sum("rows").alias("rows"))


@Q.query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(donnees)) AS key FROM notices_engineered WHERE json_valid(donnees) AND json_type(donnees) = 'OBJECT') WHERE key NOT IN ('EFORMS', 'FNSimple', 'MAPA') GROUP BY 1")
def schema_drift(spark, d):
    n = table(spark, d, "notices_engineered").where(F.try_parse_json("donnees").isNotNull())
    return files.unexpected_keys(n, "donnees", ["EFORMS", "FNSimple", "MAPA"])


@Q.query()
def standardised_notices(spark, d):
    return standardize.standardise(table(spark, d, "notices_engineered").dropDuplicates(["idx", "donnees"]))


@Q.query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    s = events.window_counts(events.open_stream(spark, d, "events"), "ts", "event_type", "value")
    return events.run_to_end(s, "update", "windows", ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@Q.query("""
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, d):
    s = events.sessions(events.open_stream(spark, d, "events"), "ts", "user_id")
    t = events.run_to_end(s, "complete", "sessions")
    return t.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@Q.query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_totals(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@Q.query("SELECT label, count(*) AS n, round(avg(list_dot_product(embedding, embedding)), 4) AS mean_norm2 FROM embeddings GROUP BY 1")
def embedding_norms(spark, d):
    e = table(spark, d, "embeddings")
    dot = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(dot), 4).alias("mean_norm2"))


