"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.plans.ship import ship

#: A word between the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with this package at hand on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def masked(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> tuple[DataFrame, list[str]]:
    """df with the columns that are not in `keep` under names that clash with nothing, and all its columns' names then.
    `.toDF(*df.columns)` on them gives the old names back."""
    names = [c if c in keep else f"_col_{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), names


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset on one machine, a temporary one, set from then on. On a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = held or tempfile.mkdtemp(prefix="inkwell-")
        if not held:
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Rows without an id are numbered from here.
UNNAMED = 2**63 - 2**60


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc: the id as a number; each row without one has a number of its own, after all ids.

    Those rows are in the order of their texts' MD5; equal texts are dealt by place, so no copy meets its
    likes in one task. The numbers are written, so every reader sees the same ones.
    """
    own = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("doc"))
    last, without = own.agg(F.max("doc"), F.count_if(F.col("doc").isNull())).first()
    never_null = ["doc_id", "text", F.coalesce("doc", F.lit(UNNAMED)).alias("doc")]  # else a filter in one join keeps exchanges apart
    if not without:
        return own.select(*never_null)
    if last is not None and last >= UNNAMED:
        raise ValueError(f"doc_id {last}: ids from {UNNAMED} on are those of rows without one")
    unnamed = own.filter("doc IS NULL").drop("doc").withColumn("_hash", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).withColumn("_at", F.monotonically_increasing_id())
    unnamed = written(unnamed.orderBy("_hash", "_at").withColumn("doc", F.lit(UNNAMED) + F.monotonically_increasing_id()).drop("_hash", "_at"))
    return own.filter("doc IS NOT NULL").union(unnamed).select(*never_null)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it holds more than a MOST_HOT-th of all rows (and HOT rows): there are at most MOST_HOT such keys.
MOST_HOT, HOT = 1 << 16, 1 << 10


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The hot keys of rows, as a written table of at most MOST_HOT rows."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return written(counts.filter(F.col("_rows") > max(HOT, rows.count() // MOST_HOT)).select(*keys))


def joined(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows join facts on `keys`, where facts has one row for each key and rows may hold any share of theirs under one:
    facts of hot keys, a bounded number, are broadcast; the rest is joined as usual. Keys must not be null."""
    hot = hot_keys(rows, keys) if hot is None else hot
    told = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    few = facts.join(F.broadcast(hot), keys, "left_semi")
    many = told.filter("_hot IS NULL").drop("_hot").join(facts, keys, how)
    return told.filter("_hot").drop("_hot").join(F.broadcast(few), keys, how).unionByName(many)


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str, position: str | None = None) -> DataFrame:
    """Exclusive running sum of `value` within `keys` along (bucket, *order), without gathering a key in one task.

    Sums by (keys, bucket) are laid end to end in a window that sees one row a
    bucket; each bucket then counts on from its own start. `bucket` must ascend
    with the wanted order and holds a bounded share of a key's rows. `position`
    names a column for the row's number within its bucket, from 0.
    Keys must not be null.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, bucket, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out_df = df.withColumn("_inner", F.coalesce(F.sum(value).over(before), F.lit(0)))
    if position:
        out_df = out_df.withColumn(position, F.row_number().over(inside) - 1)
    return out_df.join(starts, [*keys, bucket]).withColumn(out, F.col("_start") + F.col("_inner")).drop("_start", "_inner")
