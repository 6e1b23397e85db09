"""Shards that a broken-off run takes up again, and gates between stored artefacts."""

import pytest
from pyspark.sql import functions as F

from inkwell.sources import shards


def _data(spark, path):
    return sorted((r["shard"], r["id"], r["w"]) for r in spark.read.parquet(f"{path}/data").collect())


def test_a_run_taken_up_again_equals_one_run(spark, tmp_path):
    rows = spark.range(0, 95).withColumn("v", F.col("id") * 3)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    compute = lambda df: df.withColumn("w", F.col("v") + 1).drop("v")
    one = shards.write_shards(rows, "id", whole, 10, {"model": "m"}, compute)
    assert one.count() == 10
    assert sorted(r["shard"] for r in shards.write_shards(rows, "id", broken, 10, {"model": "m"}, compute, most=3).collect()) == [0, 1, 2]

    def fails(df):
        return df.select("id", "shard", F.when(F.col("id") < 70, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("w"))

    with pytest.raises(Exception, match="lost"):
        shards.write_shards(rows, "id", broken, 10, {"model": "m"}, fails)
    with pytest.raises(ValueError, match="shard 3: 5 of 10"):
        shards.write_shards(rows, "id", broken, 10, {"model": "m"}, lambda df: compute(df).filter("id % 2 = 0"))
    assert shards.manifest(spark, broken).count() == 3  # what was not read back whole is not in it
    seen = []

    def watched(df):
        seen.append(df.count())
        return compute(df)

    two = shards.write_shards(rows, "id", broken, 10, {"model": "m"}, watched)
    assert seen == [65] and _data(spark, broken) == _data(spark, whole)
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, one.collect()))
    shards.write_shards(rows, "id", broken, 10, {"model": "m"}, watched)
    assert seen == [65]
    more = shards.write_shards(spark.range(0, 120).withColumn("v", F.col("id") * 3), "id", broken, 10, {"model": "m"}, watched)
    assert more.count() == 12 and seen == [65, 20]


def test_drift_nulls_and_damage(spark, tmp_path):
    path = str(tmp_path / "s")
    shards.write_shards(spark.range(30), "id", path, 10, {"model": "m", "form": "unit"})
    with pytest.raises(ValueError, match="form: unit then, raw now; size: 10 then, 20 now"):
        shards.write_shards(spark.range(30), "id", path, 20, {"model": "m", "form": "raw"})
    with pytest.raises(ValueError, match="without id"):
        shards.write_shards(spark.sql("SELECT CAST(NULL AS BIGINT) AS id"), "id", str(tmp_path / "n"), 10, {})
    assert shards.write_shards(spark.range(0), "id", str(tmp_path / "e"), 10, {}).count() == 0
    assert shards.damaged(spark, path, "id").count() == 0
    spark.range(10, 19).withColumn("shard", F.lit(1)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/data")
    spark.range(50, 51).withColumn("shard", F.lit(5)).write.mode("append").partitionBy("shard").parquet(f"{path}/data")
    assert sorted(r["shard"] for r in shards.damaged(spark, path, "id").collect()) == [1, 5]


def test_gate_tells_all_mismatches(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    corpus = spark.range(5)
    corpus.write.parquet(f"{a}/members")
    facts = shards.corpus_facts(corpus)
    shards.sign(spark, a, facts | {"rows:members": 5, "dimensions": 8})
    shards.sign(spark, b, facts | {"rows:postings": 3, "dimensions": 16})
    shards.gate(spark, {"lists": a}, facts | {"dimensions": 8})
    assert shards.mismatches(spark, {"lists": a, "postings": b, "vectors": c}, {"dimensions": 8, "model": "m"}) == [
        "lists: model is not stated, wanted m", "postings: dimensions is 16, lists has 8", "postings: rows:postings is no table, signed 3",
        "postings: dimensions is 16, wanted 8", "postings: model is not stated, wanted m", "vectors: no signature",
    ]
    with pytest.raises(ValueError, match="corpus_digest.*corpus_rows is 5, wanted 6"):
        shards.gate(spark, {"lists": a}, shards.corpus_facts(spark.range(6)))
