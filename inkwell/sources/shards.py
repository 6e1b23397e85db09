"""A sink in shards that a broken-off run takes up again, and signatures that stored artefacts must share before a search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from inkwell.sources.files import fingerprint

MANIFEST = "shard long, first_row long, last_row long, rows long, digest string"
FACTS = "fact string, value string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at `path`, empty where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _facts(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["fact"]: r["value"] for r in _read(spark, path, FACTS).collect()}  # a few rows, as sign() wrote them


def sign(spark: SparkSession, path: str, facts: dict[str, object]) -> None:
    """Facts of the artefact at `path`, as a table beside it; a second signature is an error."""
    rows = [(k, str(v)) for k, v in sorted(facts.items())]
    spark.createDataFrame(rows, FACTS).coalesce(1).write.mode("errorifexists").parquet(f"{path}/signature")


def mismatches(spark: SparkSession, artefacts: dict[str, str], wanted: dict[str, object]) -> list[str]:
    """All that is wrong with artefacts (name -> path): those without a signature, facts that differ from the wanted ones or are
    not stated, facts on which two artefacts differ, and tables (`rows:<table>`) of another number of rows than was signed."""
    out, said = [], {}
    for name, path in artefacts.items():
        facts = _facts(spark, f"{path}/signature")
        if not facts:
            out.append(f"{name}: no signature")
            continue
        for fact, value in sorted(facts.items()):
            if fact.startswith("rows:"):
                try:
                    n = spark.read.parquet(f"{path}/{fact[5:]}").count()
                except AnalysisException:
                    n = "no table"
                if str(n) != value:
                    out.append(f"{name}: {fact} is {n}, signed {value}")
            else:
                other, first = said.setdefault(fact, (name, value))
                if value != first:
                    out.append(f"{name}: {fact} is {value}, {other} has {first}")
        out += [f"{name}: {fact} is {facts.get(fact, 'not stated')}, wanted {value}" for fact, value in sorted(wanted.items()) if facts.get(fact) != str(value)]
    return out


def gate(spark: SparkSession, artefacts: dict[str, str], wanted: dict[str, object]) -> None:
    """An error that names all mismatches, if there is one."""
    wrong = mismatches(spark, artefacts, wanted)
    if wrong:
        raise ValueError("; ".join(wrong))


def corpus_facts(df: DataFrame) -> dict[str, object]:
    """Rows and digest of the table that an index is made of."""
    n, digest = fingerprint(df)
    return {"corpus_rows": n, "corpus_digest": digest}


def _told(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """shard, first_row, last_row, rows, digest of each shard; the digest does not depend on the order of rows."""
    digest = F.sum(F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(38,0)")).cast("string")
    return df.groupBy("shard").agg(F.min(row).cast("long").alias("first_row"), F.max(row).cast("long").alias("last_row"), F.count("*").alias("rows"), digest.alias("digest"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/manifest", MANIFEST)


def _overwrite(df: DataFrame, path: str) -> None:
    """The shards of df in place of those that stand there under the same numbers; the others stay."""
    df.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def write_shards(rows: DataFrame, row: str, path: str, size: int, parameters: dict[str, object], compute: Callable[[DataFrame], DataFrame] = lambda df: df, most: int | None = None) -> DataFrame:
    """Write the shards of `rows` that the manifest at `path` lacks, and return the manifest.

    A shard holds the rows of `size` consecutive numbers in `row`, so it is the same in every run. `compute` makes the written
    columns of the rows (an embedding, say) and must keep each row's number; it sees only the rows of missing shards. A shard enters
    the manifest after it was read back with as many rows as went in; one that was broken off before is written again in its place.
    `size` and `parameters` are kept from the first run, and others are an error, which names all that drifted. `most` ends a run
    after so many shards, smallest first. Rows without a number are an error; rows of equal numbers lie in one shard.
    """
    spark = rows.sparkSession
    facts = {k: str(v) for k, v in ({"size": size} | parameters).items()}
    held = _facts(spark, f"{path}/signature")
    if not held:
        sign(spark, path, facts)
    drift = [f"{k}: {held.get(k)} then, {facts.get(k)} now" for k in sorted(held.keys() | facts) if held.get(k) != facts.get(k)] if held else []
    if drift:
        raise ValueError("parameters drifted: " + "; ".join(drift))
    if rows.filter(F.col(row).isNull()).limit(1).count():
        raise ValueError(f"rows without {row}")
    dealt = rows.withColumn("shard", F.floor(F.col(row) / F.lit(size)).cast("long"))
    missing = dealt.groupBy("shard").agg(F.count("*").alias("went_in")).join(manifest(spark, path), "shard", "left_anti")
    missing = missing.orderBy("shard").limit(most) if most is not None else missing
    wanted = f"{path}/wanted"
    missing.write.mode("overwrite").parquet(wanted)  # the run's list, which does not change while the manifest does
    missing = spark.read.schema("shard long, went_in long").parquet(wanted)
    if not missing.limit(1).count():
        return manifest(spark, path)
    made = compute(dealt.join(missing.select("shard"), "shard", "left_semi"))
    columns = [c for c in made.columns if c != "shard"]
    _overwrite(made, f"{path}/data")
    back = spark.read.schema(made.schema).parquet(f"{path}/data").join(missing, "shard")
    told = _told(back, row, columns).join(missing, "shard", "right")
    short = told.filter(~F.col("rows").eqNullSafe(F.col("went_in"))).orderBy("shard").limit(5).collect()
    if short:
        raise ValueError("rows lost or added: " + ", ".join(f"shard {r['shard']}: {r['rows']} of {r['went_in']}" for r in short))
    _overwrite(told.drop("went_in"), f"{path}/manifest")
    return manifest(spark, path)


def damaged(spark: SparkSession, path: str, row: str) -> DataFrame:
    """shard: those whose data differ from the manifest, are gone, or are in no manifest."""
    data = spark.read.parquet(f"{path}/data").withColumn("shard", F.col("shard").cast("long"))
    now = _told(data, row, [c for c in data.columns if c != "shard"]).select("shard", F.struct("first_row", "last_row", "rows", "digest").alias("now"))
    then = manifest(spark, path).select("shard", F.struct("first_row", "last_row", "rows", "digest").alias("then"))
    differ: Column = ~F.col("now").eqNullSafe(F.col("then"))
    return now.join(then, "shard", "full_outer").filter(differ).select("shard")
