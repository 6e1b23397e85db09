"""Trees of documents: node rows from paths with deterministic ids and one order of all, parents, and an upsert that is read back."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.files import insert_or_verify
from inkwell.sources.tables import cut, shared_dir


def node_id(path: Column) -> Column:
    return F.sha2(F.to_json(path), 256)


def node_rows(leaves: DataFrame, path: str = "path") -> DataFrame:
    """node_id, parent_id, level, name, path, leaves: a row for each prefix of the paths (arrays of names, not empty), from level 1.

    A node's id is the SHA-256 of its path, so trees of different runs and parts of a table agree. Leaves that
    share a path are counted at each of its nodes; null and empty paths are in no tree.
    """
    every = leaves.filter(F.size(path) > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(F.col(path), 1, n))).alias("path"))
    nodes = every.groupBy("path").agg(F.count("*").alias("leaves"))
    up = F.slice("path", 1, F.size("path") - 1)
    return nodes.select(node_id(F.col("path")).alias("node_id"), F.when(F.size("path") > 1, node_id(up)).alias("parent_id"), F.size("path").alias("level"), F.element_at("path", -1).alias("name"), "path", "leaves")


def ordered(df: DataFrame, by: list[str], out: str = "sort_order") -> DataFrame:
    """df with the place of each row in the order of all, from 1: sorted by ranges, each range counts on from the rows of those before it."""
    held = cut(df.orderBy(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = held.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first")).orderBy("_part").collect()  # a row a task
    start, rows = 0, []
    for r in counts:
        rows.append((r["_part"], r["_first"], start))
        start += r["n"]
    spark = df.sparkSession
    starts = spark.createDataFrame(rows, "_part int, _first long, _start long")
    return held.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + F.col("_at") - F.col("_first") + 1).alias(out))


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent and grandparent: their names, null where there is none."""
    up = nodes.select("node_id", "parent_id", "name")
    one = up.toDF("parent_id", "_up", "parent")
    two = up.toDF("_up", "_top", "grandparent")
    return nodes.join(one, "parent_id", "left").join(two, "_up", "left").drop("_up", "_top")


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str) -> tuple[int, int]:
    """(rows put in, rows that were there and equal). Rows of `new` whose key is in the table at `path` must equal it in every
    column, else nothing is written and the call is an error; the table is read again and must hold every row of `new` once."""
    new = cut(new)
    twice = new.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} is given twice")
    try:
        held = spark.read.parquet(path).select(*new.columns)
    except AnalysisException:  # no such table yet
        held = None
    added, same, conflict = insert_or_verify(held, new, key) if held is not None else (new, new.limit(0), new.limit(0))
    bad = conflict.limit(1).collect()
    if bad:
        raise ValueError(f"{key} {bad[0][key]} differs from the row that is there")
    counts = added.count(), same.count()
    if counts[0]:
        added.write.mode("append").parquet(path)
    back = spark.read.parquet(path).select(*new.columns) if held is not None or counts[0] else new
    left, there, _ = insert_or_verify(back, new, key)
    if left.limit(1).count() or there.count() != sum(counts):
        raise ValueError(f"{path} does not hold what was written")
    return counts


def scratch(spark: SparkSession) -> str:
    """A new name for a table in the shared folder."""
    return f"{shared_dir(spark)}/inkwell/{uuid.uuid4().hex}"
