"""File sources and sinks: checked CSV, JSON lines, JSON arrays, atomic tables with manifests, insert-or-verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """CSV with a header that must equal the schema, quoted line ends, UTF-8 with or without a mark; ragged rows are errors.

    Adds source_file and source_row (logical records of a file, from 1, in the file's order).
    """
    names = [f.name for f in StructType.fromDDL(schema).fields]
    # The first line of a file is the first of the block that starts it.
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"))
    heads = lines.filter("at = 0").groupBy("f").agg(F.min_by("value", "i").alias("head")).withColumn("head", F.regexp_replace("head", "^\ufeff|\r$", ""))
    bad = heads.filter(F.col("head") != ",".join(names)).limit(1).collect()
    if bad:
        raise ValueError(f"header of {bad[0]['f']}: {bad[0]['head']}")
    rows = spark.read.option("header", True).option("multiLine", True).option("mode", "FAILFAST").option("escape", '"').option("encoding", "UTF-8").schema(schema).csv(paths)
    # With multiLine a file is read by one task from its start, so ids ascend with its records.
    rows = rows.withColumn("source_file", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id())
    first = rows.groupBy("source_file").agg(F.min("_id").alias("_first"))
    return rows.join(F.broadcast(first), "source_file").withColumn("source_row", F.col("_id") - F.col("_first") + 1).select(*names, "source_file", "source_row")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. Lines that are not objects of the schema are errors, or in `_corrupt` if not strict."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if strict:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.select("r.*")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document that is an array of objects."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, a digest of the rows that does not depend on their order)."""
    r = df.select(F.xxhash64(F.to_json(F.struct(*df.columns))).alias("h")).agg(F.count("*"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return r[0], int(r[1])


def write_table(df: DataFrame, path: str, partition: list[str] | None = None) -> DataFrame:
    """Write once (an existing table is an error) beside a manifest of rows and digest, which is read back and compared."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    back = df.sparkSession.read.parquet(path).select(df.columns)
    n, digest = fingerprint(back)
    manifest = df.sparkSession.createDataFrame([(n, str(digest), ",".join(df.columns))], "n long, digest string, columns string")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}.manifest")
    return back


def compatible(df: DataFrame, path: str) -> list[str]:
    """What differs between df and the manifest of a written table; empty if nothing."""
    held = df.sparkSession.read.json(f"{path}.manifest").first()
    n, digest = fingerprint(df)
    return [name for name, ok in (("rows", held["n"] == n), ("digest", held["digest"] == str(digest)), ("columns", held["columns"] == ",".join(df.columns))) if not ok]


def insert_or_verify(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to insert, already there and equal, in conflict), by null-safe comparison of all other columns."""
    rest = [c for c in new.columns if c != key]
    there = existing.select(F.col(key), F.struct(*rest).alias("_old"))
    met = new.select(F.col(key), F.struct(*rest).alias("_new")).join(there, key, "left")
    same = F.col("_new").eqNullSafe(F.col("_old"))
    pick = lambda cond: met.filter(cond).select(key, "_new.*")
    return pick(F.col("_old").isNull()), pick(F.col("_old").isNotNull() & same), pick(F.col("_old").isNotNull() & ~same)


def missing_shards(done: DataFrame, total: int, size: int) -> DataFrame:
    """start, end of the shards of `size` rows out of `total` that the manifest `done` (start, end) lacks."""
    spark = done.sparkSession
    every = spark.range(0, total, size).select(F.col("id").alias("start"), F.least(F.col("id") + size, F.lit(total)).alias("end"))
    return every.join(done, ["start", "end"], "left_anti")
