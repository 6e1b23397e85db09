"""Ranks, top-k, fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.sources.tables import cut

RRF_K = 60


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1. Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def first_per_work(hits: DataFrame, lists: list[str], work: str = "work_id") -> DataFrame:
    """Of each list and work the best-ranked hit."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*lists, work).orderBy("rank"))).filter("_n = 1").drop("_n")


def rrf(hits: DataFrame, query: list[str], lists: list[str], work: str = "work_id", k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion: a list gives 1 / (k + rank) for the best hit of each work.

    query: columns that name a question; lists: those that name a list within it.
    Returns query, work, rrf_score, best_rank, support, rank: by score, then best rank, then work.
    """
    once = first_per_work(hits, [*query, *lists], work)
    # Sums of doubles depend on their order, so contributions are added in the order of their ranks.
    shares = F.transform(F.array_sort(F.collect_list("rank")), lambda r: F.lit(1.0) / (F.lit(k) + r))
    fused = once.groupBy(*query, work).agg(F.round(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), 9).alias("rrf_score"), F.min("rank").cast("int").alias("best_rank"), F.count("*").alias("support"))
    order = [F.desc("rrf_score"), F.col("best_rank"), F.col(work)]
    return top_k_per_group(fused, query, order, limit) if limit else fused.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(*order)))


def renumbered(hits: DataFrame, keys: list[str], rank: str = "rank", to: str = "rank") -> DataFrame:
    """Ranks made contiguous again after a filter."""
    return hits.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(rank)))


def evidence(hits: DataFrame, query: list[str], work: str = "work_id") -> DataFrame:
    """The best evidence of each work: least by (rank, channel, text)."""
    return hits.groupBy(*query, work).agg(F.min(F.struct("rank", "channel", "text")).alias("e")).select(*query, work, F.col("e.rank").alias("evidence_rank"), F.col("e.channel").alias("evidence_channel"), F.col("e.text").alias("evidence_text"))


def evenly_spaced(size: int, n: int) -> list[int]:
    """Distinct row numbers floor(i * (n - 1) / (size - 1))."""
    if n <= 0 or size <= 0:
        return []
    return sorted({i * (n - 1) // max(1, size - 1) for i in range(size)}) if size > 1 else [0]


def placed(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """df with each row's place in an order, from 0. Rows are sorted over all tasks and written with their number within the
    task; the one window that is not partitioned sees a row for each task."""
    at = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    task, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ahead = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = at.groupBy(task.alias("_task")).agg(F.count("*").alias("_n")).select("_task", F.coalesce(ahead, F.lit(0)).alias("_start"))
    return at.withColumn("_task", task).join(F.broadcast(starts), "_task").withColumn(place, F.col("_start") + inside).select(*df.columns, place)


def reranked(hits: DataFrame, query: list[str], score: str, rank: str = "rank", work: str = "work_id") -> DataFrame:
    """hits with final_rank and `reranked`: by falling score where every score of the list is finite, else the ranks that were there.

    A list with a missing, NaN or infinite score is one whose scorer failed: none of it moves. Ties keep the earlier rank.
    """
    whole = Window.partitionBy(*query)
    fine = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    out = hits.withColumn("reranked", F.min(F.coalesce(fine, F.lit(False))).over(whole))
    order = F.when(F.col("reranked"), -F.col(score)).otherwise(0.0)
    return out.withColumn("final_rank", F.row_number().over(whole.orderBy(order, rank, work)))
