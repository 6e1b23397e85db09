"""Sources, sinks, markup and the streaming limiter."""

import pytest
from pyspark.sql import functions as F

from inkwell.sources import files
from inkwell.sources.markup import read
from inkwell.streaming.quota import rate_limit_stream, rate_limited


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿s,t\n甲,\"一\n二\"\n乙,三\n".encode())
    got = sorted(files.read_csv(spark, str(tmp_path / "a.csv"), "s string, t string").collect(), key=lambda r: r["source_row"])
    assert [(r["s"], r["t"], r["source_row"]) for r in got] == [("甲", "一\n二", 1), ("乙", "三", 2)]
    (tmp_path / "b.csv").write_text("x,t\n1,2\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "b.csv"), "s string, t string")


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n[oops\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()
    assert [r["_corrupt"] for r in files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int", strict=False).filter("_corrupt IS NOT NULL").collect()] == ["[oops"]
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json_array(spark, str(tmp_path / "c.json"), "a int").count() == 2


def test_table_with_manifest(spark, tmp_path):
    df = spark.range(10).withColumn("b", F.col("id") * 2)
    path = str(tmp_path / "t")
    files.write_table(df, path)
    assert files.compatible(df.orderBy(F.desc("id")), path) == [] and files.compatible(df.filter("id > 1"), path) == ["rows", "digest"]
    with pytest.raises(Exception):  # noqa: B017
        files.write_table(df, path)


def test_insert_or_verify(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "k int, v string")
    insert, same, conflict = files.insert_or_verify(old, new, "k")
    assert [[r["k"] for r in x.collect()] for x in (insert, same, conflict)] == [[3], [2], [1]]
    done = spark.createDataFrame([(0, 4)], "start long, end long")
    assert sorted((r["start"], r["end"]) for r in files.missing_shards(done, 10, 4).collect()) == [(4, 8), (8, 10)]


def test_blocks():
    got = read("<html><nav><p>no</p></nav><h1 id=a class='x y'>T &amp; U</h1><p>a <b>b</b></p><script>var t='<p>';</script><p> </p></html>")
    assert [(b["tag"], b["text"], b["anchor"], b["classes"]) for b in got] == [("h1", "T & U", "a", ["x", "y"]), ("p", "a b", None, [])]


REQUESTS = [(i, f"c{i % 2}", f"2024-01-01 00:00:{i:02d}") for i in range(12)]


def test_rate_limit_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(REQUESTS, "event_id long, client string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {r["event_id"]: r["accepted"] for r in rate_limited(df, 2, 5).collect()}
    assert [batch[i] for i in range(0, 12, 2)] == [True, True, False, True, True, False]
    df.write.parquet(str(tmp_path / "in"))
    stream = rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 5)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["event_id"]: r["accepted"] for r in spark.table("limited").collect()} == batch
