import pytest
from pyspark.sql import functions as F

from tressage.operators import joins
from tressage.runtime import Scratch, hot_keys, shared_folder, skew_join
from tressage.sources import files
from tressage.streaming import events


def test_jsonl_is_strict(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": "1", "b": {"x": [1, 2]}}\n\n{"a": null}\n')
    bad.write_text('{"a": "1"}\n{"a": \n')
    got = [tuple(r) for r in files.read_jsonl(spark, str(good), files.all_strings(["a", "b"])).collect()]
    assert got == [("1", '{"x": [1, 2]}'), (None, None)]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad), files.all_strings(["a"])).collect()


def test_csv_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 'say "x"\nnext, line', None), ("", "0012", "é")], "p string, q string, r string")
    files.write_csv(df, str(tmp_path / "c"))
    got = sorted(map(tuple, files.read_csv_text(spark, str(tmp_path / "c"), ["p", "q", "r"]).collect()))
    assert got == [("", "0012", "é"), (" a ", 'say "x"\nnext, line', "")]
    nested = spark.createDataFrame([(1, [1, 2])], "k int, v array<int>")
    files.write_csv(nested, str(tmp_path / "n"))
    assert files.read_csv_text(spark, str(tmp_path / "n"), ["k", "v"]).first().v == "[1,2]"


def test_writers_refuse_to_replace(spark, tmp_path):
    df = spark.range(10).withColumn("y", F.col("id") % 2)
    files.write_parquet(df, str(tmp_path / "p"), by=["y"])
    with pytest.raises(Exception):
        files.write_parquet(df, str(tmp_path / "p"))
    files.write_parquet(df.limit(3), str(tmp_path / "p"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    files.write_several(df, {str(tmp_path / "all"): None, str(tmp_path / "odd"): F.col("y") == 1})
    assert spark.read.parquet(str(tmp_path / "odd")).count() == 5
    found = files.footers(spark, "file://" + str(tmp_path / "all")).agg(F.sum("rows").alias("n"), F.count_distinct("columns").alias("s")).first()
    assert (found.n, found.s) == (10, 1)


def test_unexpected_keys(spark):
    df = spark.createDataFrame([('{"a":1,"b":2}',), ('{"b":3}',), ("x",), (None,)], "j string")
    assert list(map(tuple, files.unexpected_keys(df, "j", ["a"]).collect())) == [("b", 2)]


def test_asserted_joins_fail_on_repeats(spark):
    left, right = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.asserted_join(left, right, ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        joins.asserted_join(left, right, ["k"], "one_to_one").collect()
    with pytest.raises(Exception, match="repeated key"):
        joins.asserted_join(right, left, ["k"]).collect()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_skew_join_equals_a_join(spark, how):
    left = spark.range(1000).select((F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 50)).alias("k"), "id")
    right = spark.range(0, 40, 2).select(F.col("id").alias("k"), F.col("id").alias("v"))
    hot = spark.createDataFrame([(0,), (7,)], "k long")
    a, b = skew_join(left, right, ["k"], hot, how), left.join(right, "k", how)
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert hot_keys(counts, ["k"], "n", 1000).count() == 0


def test_scratch_tables_live_in_the_shared_folder(spark):
    s = Scratch(spark, "test")
    t = s.write(spark.range(5), "five")
    assert t.count() == 5 and s.root.startswith(shared_folder(spark))
    s.drop(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._scratch_path).count()


def test_streams_drop_repeats(spark, data):
    s = events.first_seen(events.open_stream(spark, data, "events"), "ts", ["event_id"])
    got = events.run_to_end(s, "append", "first")
    assert got.count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_asserted_join_keeps_every_row_of_the_left_side(spark, data):
    from tressage import plans

    li = spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert plans.queries()["asserted_join"](spark, data).count() == li


def test_years_without_rows_have_a_file_of_the_same_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2001), (2, "b", 2003)], "id long, x string, year int")
    files.write_years(df, f"file://{tmp_path}/y", "year", range(2001, 2004))
    f = files.footers(spark, f"file://{tmp_path}/y").collect()
    assert {x.folder.rsplit("=")[-1]: x.rows for x in f} == {"2001": 1, "2002": 0, "2003": 1} and len({x.columns for x in f}) == 1
    with pytest.raises(ValueError):
        files.write_years(df, f"file://{tmp_path}/z", "year", range(2001, 2003))


def test_documents_and_columns(spark, tmp_path):
    (tmp_path / "d.json").write_text('{\n "a": {"b": [1, 2]},\n "c": "x"\n}')
    assert files.read_json_document(spark, f"file://{tmp_path}/d.json").first().a.b == [1, 2]
    (tmp_path / "e.csv").write_text('a,b,c\n1,"x\ny",3\n4,z,6\n')
    got = files.read_columns(spark, f"file://{tmp_path}/e.csv", ["c", "b"])
    assert [tuple(r) for r in got.collect()] == [("3", "x\ny"), ("6", "z")] and files.read_columns(spark, f"file://{tmp_path}/e.csv", ["a"], 1).count() == 1


def test_command_line(spark, data, tmp_path, capsys):
    from tressage.__main__ import main

    assert main(["list"]) == 0 and "km_by_segment" in capsys.readouterr().out.split()
    args = ["run", "size_histogram", "--data", data, "--out", f"file://{tmp_path}"]
    assert main(args, spark) == 0 and main(args, spark) == 0 and main([*args, "--force"], spark) == 0
    assert capsys.readouterr().out.split("\n")[:3] == ["size_histogram: written", "size_histogram: complete", "size_histogram: written"]
    assert spark.read.parquet(f"file://{tmp_path}/size_histogram").count() > 1 and main(["run", "no_such", "--data", data, "--out", "x"], spark) == 2


def test_a_window_stream_frees_what_its_watermark_has_passed(spark, tmp_path):
    import datetime as dt

    from tressage.runtime import Scratch
    from tressage.streaming import events

    start = dt.datetime(2024, 1, 1)
    for k in range(4):
        rows = [(start + dt.timedelta(hours=10 * k, minutes=i), "ab"[i % 2], 1.0) for i in range(90)]
        spark.createDataFrame(rows, "ts timestamp, kind string, value double").coalesce(1).write.parquet(f"file://{tmp_path}/e.parquet/part{k}")
    schema = "ts timestamp, kind string, value double"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"file://{tmp_path}/e.parquet")
    got = {(r.window_start, r.kind): r.n for r in events.run_to_end(events.window_counts(stream, "ts", "kind", "value"), "update", "w", ["window_start", "kind"]).collect()}
    batch = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/e.parquet")
    want = {(r.h, r.kind): r.n for r in batch.groupBy(F.date_trunc("hour", "ts").alias("h"), "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want and len(got) == 16
