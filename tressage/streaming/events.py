"""The windowed operators over unbounded input, with watermarks; the batch queries give the same once input ends."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..runtime import Scratch


def open_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if os.path.isdir(f"{folder}/{name}.parquet") or "://" in folder:
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def window_counts(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n, total) of tumbling windows; rows later than the watermark are dropped by a stream."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = timed.groupBy(F.window("_ts", width).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), key, "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, session_start, session_end, n) of runs of events with pauses shorter than the gap."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = timed.groupBy(F.session_window("_ts", gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys).drop("_ts")


def run_to_end(stream: DataFrame, mode: str = "append", label: str = "stream", keys: list[str] | None = None) -> DataFrame:
    """Everything the input holds now, through the stream's own operators, as a table in the shared folder.

    "update" writes each batch's changed rows with the batch's number and keeps the last of each of ``keys``, so the
    watermark frees the state of what it has passed; "append" gives what the watermark has closed; "complete" holds the
    whole state, for operators that know no other way to show what is still open.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark, label)
    out = f"{scratch.root}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    elif mode == "update":
        writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/_batch={n}"))
    else:
        writer = writer.format("parquet").option("path", out)
    query = writer.start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    found = spark.read.schema(StructType([*stream.schema, StructField("_batch", IntegerType())])).option("basePath", out).parquet(out)
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "_batch").alias("x"))
    return last.select(*keys, "x.*").select(*stream.columns)
