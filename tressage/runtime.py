"""Shared plumbing: scratch tables that outlive executors, and joins on keys that may be hot."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT_SHARE, so there are at most HOT_SHARE hot keys
#: whatever the size of the input; that is the proven bound for broadcasting what belongs to them.
HOT_SHARE = 1000
HOT_FLOOR = 20_000

_shipped: set[str] = set()
_left_behind: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; a local one only if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tressage-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once an application, so that they need no installation of it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = Path(__file__).parent
    held = Path(tempfile.mkdtemp(prefix="tressage-code-")) / f"{here.name}-{sc.applicationId}.zip"
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(held))


class Scratch:
    """Intermediate tables as compressed Parquet in the shared folder.

    A written table cuts the lineage, survives the loss of executors and is far smaller than a row
    checkpoint.  ``drop`` frees a table that has been superseded; the rest goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/tressage-{label}-{uuid.uuid4().hex[:12]}", 0
        _left_behind.append((spark, self.root))

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is the cluster's to clear
        pass


@atexit.register
def _clear() -> None:
    for spark, path in _left_behind:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Keys of ``counts`` that hold more than ``max(HOT_FLOOR, total / HOT_SHARE)`` rows: at most HOT_SHARE keys."""
    return counts.where(F.col(n) > max(HOT_FLOOR, total // HOT_SHARE)).select(*keys)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``left`` join ``right`` (one row a key) where a few keys may hold most of ``left``.

    Rows of hot keys stay where they are and meet the at most HOT_SHARE matching rows of ``right`` by
    broadcast; all others are joined by a shuffle.  ``hot`` comes from :func:`hot_keys`; None: no hot keys.
    """
    if hot is None:
        return left.join(right, keys, how)
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    tagged = left.join(mark, keys, "left")
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    return (
        tagged.where(F.col("_hot").isNull()).drop("_hot").join(right, keys, how)
        .unionByName(tagged.where(F.col("_hot")).drop("_hot").join(few, keys, how))
    )


def ranged(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` sorted into ranges of ``order`` by many tasks and written with ``_range``, the number of the range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.write(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(ranges: DataFrame, order: list[Column], sums: dict[str, Column], reverse: bool = False) -> DataFrame:
    """Adds to rows of :func:`ranged` the running sums over all rows in ``order``, no task seeing more than a range.

    A running sum is the one within the range plus the totals of the ranges before it, of which there are as many as
    shuffle partitions.  Ties are in one range and are summed row by row, so order must be total for exact ties.
    ``reverse``: ``order`` runs against the order of the ranges.
    """
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.desc("_range") if reverse else F.asc("_range")
    before = Window.partitionBy(F.lit(1)).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = ranges.groupBy("_range").agg(*[F.sum(c).alias(f"_{o}") for o, c in sums.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{o}").over(before), F.lit(0)).alias(f"_{o}") for o in sums])
    j = ranges.withColumns({o: F.sum(c).over(within) for o, c in sums.items()}).join(F.broadcast(totals), "_range")
    return j.select(*ranges.columns, *[(F.col(o) + F.col(f"_{o}")).alias(o) for o in sums])


def python_rows(df: DataFrame, kernel, schema) -> DataFrame:
    """``mapInArrow`` with a kernel from dict of columns (lists) to dict of columns, one batch at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches):
        for b in batches:
            got = kernel({name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)

