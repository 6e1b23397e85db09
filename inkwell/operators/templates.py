"""Templates of markup: blocks grouped by their shape, and what changes between neighbouring blocks.

Blocks are rows of key, ordinal, tag, classes, anchor, text, as `sources.markup.blocks` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a template, templates that are always kept, and the count up to which a template is rare.
SAMPLES, HEAD, RARE = 5, 10, 3


def signature() -> Column:
    """Tag, sorted classes and whether there is an anchor, as JSON."""
    return F.to_json(F.struct("tag", F.array_sort("classes").alias("classes"), F.col("anchor").isNotNull().alias("anchored")))


def catalogue(blocks: DataFrame, key: str, samples: int = SAMPLES) -> DataFrame:
    """template, n, pages, leading (before the first heading of second level or without one), after_heading, before_heading and samples.

    Samples are `samples` places (page, ordinal) at most: the first ones of the template on the pages with the least hashes, in order;
    all places where there are no more. No more than `samples` pages of a template travel for them.
    """
    page = Window.partitionBy(key).orderBy("ordinal")
    heading = lambda c: F.coalesce(c.rlike("^h[1-6]$"), F.lit(False))
    seen = F.max(F.when(F.col("tag") == "h2", 1).otherwise(0)).over(page.rowsBetween(Window.unboundedPreceding, 0))
    b = blocks.select(key, "ordinal", signature().alias("template"), (seen == 0).alias("_lead"), heading(F.lag("tag").over(page)).alias("_after"), heading(F.lead("tag").over(page)).alias("_before"))
    per = b.groupBy("template", key).agg(F.count("*").alias("_n"), *[F.count_if(c).alias(c) for c in ("_lead", "_after", "_before")], F.sort_array(F.collect_list("ordinal")).alias("_at"))
    sizes = per.groupBy("template").agg(F.sum("_n").alias("n"), F.count("*").alias("pages"), F.sum("_lead").alias("leading"), F.sum("_after").alias("after_heading"), F.sum("_before").alias("before_heading"))
    few = per.withColumn("_turn", F.row_number().over(Window.partitionBy("template").orderBy(F.xxhash64(key), key))).filter(F.col("_turn") <= samples)
    chosen = few.select("template", F.col(key).alias("page"), F.explode(F.slice("_at", 1, samples)).alias("ordinal"))
    each = chosen.groupBy("template").agg(F.slice(F.array_sort(F.collect_list(F.struct("page", "ordinal"))), 1, samples).alias("samples"))
    return sizes.join(each, "template")


def kept(catalogued: DataFrame, head: int = HEAD, rare: int = RARE) -> DataFrame:
    """The `head` most frequent templates (ties by template) and all with at most `rare` blocks."""
    top = catalogued.orderBy(F.desc("n"), "template").limit(head).select("template", F.lit(True).alias("frequent"))
    out = catalogued.join(F.broadcast(top), "template", "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    return out.filter(F.col("frequent") | (F.col("n") <= rare))


def transitions(blocks: DataFrame, key: str, marker: str) -> DataFrame:
    """The first paragraph of each page that begins with the marker before a paragraph that does not: its columns and next_text."""
    page = Window.partitionBy(key).orderBy("ordinal")
    b = blocks.withColumn("next_tag", F.lead("tag").over(page)).withColumn("next_text", F.lead("text").over(page))
    hit = b.filter((F.col("tag") == "p") & F.col("text").rlike(marker) & (F.col("next_tag") == "p") & ~F.col("next_text").rlike(marker))
    return hit.withColumn("_n", F.row_number().over(page)).filter("_n = 1").drop("_n", "next_tag")
