"""Readers and writers with explicit contracts; all are plain Spark sources, so pruning and pushdown apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def all_strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; a malformed line fails the job; blank lines are skipped; nested values asked for as strings
    keep their JSON text."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Every field as text, quoted line breaks kept; an empty field is an empty string, not null."""
    df = spark.read.schema(all_strings(names)).options(header="true", multiLine="true", quote='"', escape='"', mode="FAILFAST", enforceSchema="false", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return df.na.fill("")


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, overwrite: bool = False) -> None:
    """zstd Parquet, all or nothing by the commit protocol; refuses to replace unless asked."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_years(df: DataFrame, path: str, year: str, years) -> None:
    """Files of one schema a year, an empty one where a year of ``years`` has no rows; rows of other years are refused."""
    spark, wanted = df.sparkSession, sorted(years)
    strange = df.where(~F.coalesce(F.col(year).isin(*wanted), F.lit(False))).limit(1).count()
    if strange:
        raise ValueError("rows outside the years")
    write_parquet(df, path, by=[year])
    there = {r[0] for r in spark.read.parquet(path).select(year).distinct().collect()} if df.head(1) else set()  # one row a year
    empty = spark.createDataFrame([], df.drop(year).schema).coalesce(1)
    for y in wanted:
        if y not in there:
            write_parquet(empty, f"{path}/{year}={y}")


def read_columns(spark: SparkSession, path: str, columns: list[str], rows: int | None = None) -> DataFrame:
    """The named columns of a CSV file with a header, all as text, and the first rows only if asked."""
    head = spark.read.options(header="true", quote='"', escape='"', multiLine="true").csv(path).select(*[F.col(f"`{c}`") for c in columns])
    return head if rows is None else head.limit(rows)


def read_json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Files that are one JSON document each, however many lines it has; a damaged one fails the job."""
    reader = spark.read.option("multiLine", "true").option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header; nested columns become compact JSON cells, null becomes empty."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
    flat = df.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in nested}) if nested else df
    flat.write.mode("overwrite" if overwrite else "errorifexists").options(header="true", quote='"', escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def write_several(df: DataFrame, outputs: dict[str, object], overwrite: bool = False) -> None:
    """One pass over ``df``, several outputs: path -> condition (None: all rows)."""
    kept = df.persist()
    try:
        for path, condition in outputs.items():
            write_parquet(kept if condition is None else kept.where(condition), path, overwrite=overwrite)
    finally:
        kept.unpersist()


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, columns, folder) of each Parquet file below a folder, from footers read in parallel, data untouched."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(p)
                f = pq.ParquetFile(fs.open_input_file(name))
                rows.append((p.rsplit("/", 1)[-1], f.metadata.num_rows, ",".join(f"{x.name}:{x.type}" for x in f.schema_arrow), p.rsplit("/", 1)[0]))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["file", "rows", "columns", "folder"])

    return files.mapInArrow(run, "file string, rows long, columns string, folder string")


def unexpected_keys(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """(key, n): top-level JSON keys of a text column that are not expected, and how often they occur."""
    keys = df.select(F.explode(F.json_object_keys(column)).alias("key")).where(~F.col("key").isin(*expected) if expected else F.lit(True))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
