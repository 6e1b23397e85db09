"""The corpus pipeline: five stages over the documents table.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents.

Defined results for odd rows are those of the operators. In the pipeline, a document
without a letter goes at the first stage (so do null and empty texts), rows that share an id
stand or fall together at near duplicates and in the mix, where each is repeated as often as the
one of them that is taken most, and a null id is no near duplicate of anything. Long texts are read
whole by every stage. Of equal texts the smallest id stays; ties in the mix go by the hash of the id, then by
the id, then by size. An empty table gives an empty result; further columns stay as they are up
to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, langid, mixing, near_dup, sharding
from inkwell.llm.common import masked, table, written

#: A document whose best language has a smaller mean probability is in none of the learned languages.
MIN_LANGUAGE = 0.4
SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    own, names = masked(docs)
    judged = langid.predict(own, langid.train(own), names)
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE)).select(names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    copies = near_dup.link(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    own, names = masked(docs)
    return decontaminate.contamination(own, table(spark, sf_dir, "benchmark")).filter(F.size("ranges") == 0).select(names).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Blocks of a source are taken in turn, so all but
    the document at a source's last cut are taken a whole number of times; that one is rounded."""
    own, names = masked(docs)
    taken = mixing.mix(own).groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)).cast("int").alias("_times"))
    taken = taken.filter("_times > 0").withColumnRenamed("doc_id", "_id")
    met = own.join(taken, own["doc_id"].eqNullSafe(taken["_id"]))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(names).toDF(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of each document."""
    return sharding.shard(docs, SHARDS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("contaminated", contaminated), ("mixed", mixed), ("sharded", sharded)]

#: Three stages have no SQL; tests/llm/test_pipeline.py holds all rows of run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
