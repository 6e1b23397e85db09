"""Order of era labels: which of two labels is surely earlier, surely later, the same or overlapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The labels in the order of their starts, and the groups of labels that overlap.
STARTS = [
    ["先秦"], ["秦"], ["汉"], ["魏晋"], ["魏晋末南北朝初"], ["南北朝"], ["隋"], ["隋末唐初"], ["唐"], ["唐末宋初"], ["辽"], ["宋"], ["宋末金初"],
    ["金"], ["金末元初"], ["宋末元初"], ["元"], ["元末明初"], ["明"], ["明末清初"], ["清"], ["清末民国初", "清末近现代初"], ["近现代"],
    ["民国末当代初", "近现代末当代初"], ["当代"],
]
OVERLAPS = [
    ["先秦", "秦"], ["秦", "汉"], ["汉", "魏晋"], ["魏晋", "魏晋末南北朝初", "南北朝"], ["南北朝", "隋"], ["隋", "隋末唐初", "唐"], ["唐", "唐末宋初"],
    ["唐末宋初", "辽", "宋"], ["辽", "宋", "宋末金初", "金"], ["宋", "金", "金末元初"], ["宋", "宋末元初", "金末元初", "元"], ["元", "元末明初", "明"],
    ["明", "明末清初", "清"], ["清", "清末民国初", "清末近现代初", "近现代"], ["近现代", "民国末当代初", "近现代末当代初", "当代"],
]
#: The same with the labels of the driver's tables.
TOY_STARTS, TOY_OVERLAPS = [["en"], ["fr"], ["de"], ["es"]], [["fr", "de"]]


def relations(starts=None, overlaps=None) -> list[tuple[str, str, str, bool]]:
    """(candidate, target, status, prior) for all pairs of labels; prior is the strict legacy choice."""
    starts, overlaps = starts or STARTS, overlaps or OVERLAPS
    at = {label: i for i, group in enumerate(starts) for label in group}
    shared = {(a, b) for group in overlaps for a in group for b in group}
    out = []
    for a in at:
        for b in at:
            status = "same_dynasty" if a == b else "overlapping" if (a, b) in shared else "clearly_earlier" if at[a] < at[b] else "clearly_later"
            prior = status == "clearly_earlier" or (status == "overlapping" and "末" in a and "初" in a and at[a] < at[b])
            out.append((a, b, status, prior))
    return out


def lookup(spark: SparkSession, starts=None, overlaps=None) -> DataFrame:
    return spark.createDataFrame(relations(starts, overlaps), "candidate string, target string, status string, prior boolean")


def classified(df: DataFrame, candidate: str, target: str, pairs: DataFrame) -> DataFrame:
    """df with chronology_status; labels that are null or not known are `unknown`. The lookup has a row a pair of labels."""
    met = df.join(F.broadcast(pairs.select(F.col("candidate").alias(candidate), F.col("target").alias(target), "status")), [candidate, target], "left")
    return met.withColumn("chronology_status", F.coalesce("status", F.lit("unknown"))).drop("status")


def rejection(self_hit: Column) -> Column:
    """A work's own hit goes before anything else; only what is surely later is rejected besides."""
    return F.when(self_hit, F.lit("self_hit")).when(F.col("chronology_status") == "clearly_later", F.lit("clearly_later"))


def dominant(df: DataFrame, keys: list[str], label: str, known: list[str]) -> DataFrame:
    """keys, dominant: the most frequent known label of each group; null if there is a tie."""
    counts = df.filter(F.col(label).isin(known)).groupBy(*keys, label).agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.collect_list(F.struct("n", label)).alias("all"), F.max("n").alias("most"))
    best = F.filter("all", lambda x: x["n"] == F.col("most"))
    return top.select(*keys, F.when(F.size(best) == 1, best[0][label]).alias("dominant"))
