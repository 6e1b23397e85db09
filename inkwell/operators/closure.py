"""Fixpoints over link tables: alias chains and reachable nodes. Rounds are joins; each is cut from its lineage by checkpoint()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources.tables import shared_dir


def _cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def resolved(pairs: DataFrame, name: str, alias_of: str) -> DataFrame:
    """name, target, steps: the end of each chain of aliases. Chains double in a round; a cycle is an error."""
    hop = _cut(pairs.select(F.col(name).alias("name"), F.col(alias_of).alias("target"), F.lit(1).alias("steps")))
    if hop.filter("name = target").limit(1).count():
        raise ValueError("an alias of itself")
    rounds, most = 0, hop.count().bit_length() + 1
    while True:
        far = hop.select(F.col("name").alias("target"), F.col("target").alias("next"), F.col("steps").alias("more"))
        step = _cut(hop.join(far, "target", "left").select("name", F.coalesce("next", "target").alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        if not step.filter("moved").limit(1).count():
            return step.drop("moved")
        rounds += 1
        if rounds > most:
            raise ValueError("aliases form a cycle")
        hop = step.drop("moved")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, depth: what the links (a, b) reach from `start` (node), with the fewest steps. Nodes seen before are left out, so cycles end."""
    seen = frontier = _cut(start.select("node", F.lit(0).alias("depth")))
    while frontier.limit(1).count():
        new = frontier.join(edges.select(F.col("a").alias("node"), "b"), "node").select(F.col("b").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = _cut(new.join(seen, "node", "left_anti"))
        seen = seen.union(frontier)
    return seen
