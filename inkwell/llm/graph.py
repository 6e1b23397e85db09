"""Connected components of a link table, for graphs too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import hot_keys, joined, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> v, component: the smallest vertex that v reaches; vertices without a link do not appear.

    Smallest labels spread over the links, and each round a vertex also takes the
    label of its label, so the rounds are logarithmic in the diameter for chains.
    A round in which no neighbour has a smaller label ends it: equal labels along every link are final.
    Every round is a written table; nothing is gathered on the driver but a count. The links of
    the head of a star, and the vertices that carry one label, meet its row by broadcast (`joined`).
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    heads = hot_keys(both, ["b"])
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")))
    while True:
        near = joined(both, labels.select(F.col("a").alias("b"), "l"), ["b"], hot=heads).groupBy("a").agg(F.min("l").alias("near"))
        step = written(labels.join(near, "a").select("a", F.col("l").alias("old"), F.least("l", "near").alias("l")))
        if not step.filter("l <> old").limit(1).count():
            return step.select(F.col("a").alias("v"), F.col("l").alias("component"))
        jump = step.select(F.col("a").alias("l"), F.col("l").alias("far"))
        labels = written(joined(step, jump, ["l"], "left").select("a", F.least("l", F.coalesce("far", "l")).alias("l")))


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """components() of the links that gave `found` and of `links` (a, b) together.

    Only links between different components are followed, from component to component, so the work
    of the rounds grows with what is new and not with what is connected already.
    """
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(found.select(F.col("v").alias(end), F.col("component").alias(f"_{end}")), end, "left")
    between = written(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b").distinct())
    if not between.limit(1).count():
        return found
    grown = components(between)
    known = found.join(grown.select(F.col("v").alias("component"), F.col("component").alias("_new")), "component", "left").select("v", F.coalesce("_new", "component").alias("component"))
    return written(known.union(grown.join(found, "v", "left_anti").select("v", "component")))
