"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slot n of the schedule is the golden-ratio point frac(n * phi), mapped through
the cumulative targets of the sources to one source. The slots of a source are
ranked; its r-th slot takes its block r modulo the number of its blocks. Blocks
hold equal numbers of words: the documents of a source lie end to end in a
shuffled order (by MD5 of the id) and are cut every `block` words, so a document
may belong to several blocks and be taken in part. A word is taken once for
each slot that takes its block.

Where blocks hold several words, a source of fewer than FINE of them is too coarse
for that: the schedule gives it some slots more or less, and its last block is a
part. Such a source takes its target by words: of its words end to end, the first
ones once more than the others, so that the sum is its target, rounded.

Nothing gathers a source in one task: running totals go through 4,096 hash
buckets a source, and slots through runs of consecutive numbers.

Defined results: a null text counts as empty; a null source is a source of its
own, after all others; documents without words take part with 0 taken; an empty
table gives an empty result; repeated rows count one by one; a text longer than a
block lies in several and is taken in part; documents whose ids have one hash (equal
ids) lie in the order of their sizes, and equal sizes are alike in every column;
sources that their caps bind equally are capped in code point order; columns beyond
doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import WORD, running_total, table, written

PHI = 0.6180339887498949
#: A source gives no more than so many times its size.
MOST = 3
#: Sources at most; more raise an error.
MAX_SOURCES = 1 << 20
#: Slots at least (for as long as a block has a word or more), and words of a block at most.
MIN_SLOTS, MAX_BLOCK = 1 << 17, 1 << 20
#: Blocks of a source at least for which the schedule is near enough to its target; a block of one word always is.
FINE = 1 << 10
#: Weights by the place of a source in code point order.
WEIGHTS = (5, 2, 1)
#: Cells that the unit interval is cut into for the join of points and sources, and consecutive slots ranked together.
CELLS, RUN = 1024, 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (never null, in the order of sources), size in words, hash and bucket."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", key.alias("key"), size.alias("size"), digest.alias("hash")).withColumn("bucket", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int"))


def targets(sources: DataFrame, weight: Column | None = None) -> DataFrame:
    """key, source_size -> and weight, target: shares of the whole by weight, none above MOST times its source.

    The level L that the uncapped sources share (weight * L each) is found by
    capping the sources in ascending order of MOST * size / weight. One row a source,
    at most MAX_SOURCES of them, so the windows over all sources see a bounded number of rows.
    """
    order = Window.orderBy("key")
    if weight is None:
        weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    out = sources.withColumn("weight", weight.cast("long")).withColumn("cap", MOST * F.col("source_size"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    ahead, everything = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    out = (
        out.withColumn("_cap", F.coalesce(F.sum("cap").over(ahead), F.lit(0)))
        .withColumn("_weight", F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_level", (F.col("_total") - F.col("_cap")) / (F.col("_weights") - F.col("_weight")))
    )
    # The first source that its level does not cap fixes the level for itself and all after it; the levels fall from there on.
    out = out.withColumn("_level", F.max(F.when(F.col("weight") * F.col("_level") <= F.col("cap"), F.col("_level"))).over(everything))
    return out.select("key", "source_size", "weight", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("_level"), F.col("cap").cast("double"))).alias("target"))


def coarse(block: int) -> Column:
    """Whether a source takes its target by words and not by blocks."""
    return F.lit(block > 1) & (F.col("source_size") < FINE * block)


def schedule(goals: DataFrame, slots: int, block: int) -> DataFrame:
    """key, block number, times: how often the schedule takes each block. goals: targets() with rows of bounded number (sources)."""
    spark = goals.sparkSession
    ahead = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("target").over(Window.partitionBy())
    held = goals.filter("source_size > 0").withColumn("lo", F.coalesce(F.sum("target").over(ahead), F.lit(0.0)) / total).withColumn("hi", F.lead("lo").over(Window.orderBy("key")))
    held = held.select("key", "source_size", "lo", F.coalesce("hi", F.lit(2.0)).alias("hi"))
    cells = held.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    points = spark.range(slots).withColumn("x", F.col("id") * PHI - F.floor(F.col("id") * PHI)).withColumn("cell", F.floor(F.col("x") * CELLS)).withColumn("run", F.floor(F.col("id") / RUN))
    mapped = points.join(cells, "cell").filter("lo <= x AND x < hi").filter(~coarse(block)).select("key", "source_size", "id", "run", F.lit(1).cast("long").alias("one"))
    ranked = running_total(mapped, ["key"], "run", [F.col("id")], "one", "rank")
    blocks = F.ceil(F.col("source_size") / block)
    return ranked.withColumn("blocks", blocks).filter(F.col("rank") < MOST * F.col("blocks")).groupBy("key", (F.col("rank") % F.col("blocks")).alias("number")).agg(F.count("*").alias("times"))


def mix(docs: DataFrame, min_slots: int = MIN_SLOTS, max_block: int = MAX_BLOCK) -> DataFrame:
    """doc_id, source key, size, source_size, target, taken; one row a document."""
    base = written(sized(docs))
    sources = base.groupBy("key").agg(F.sum("size").alias("source_size"))
    total, many = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    if many > MAX_SOURCES:
        raise ValueError(f"{many} sources: at most {MAX_SOURCES} can be mixed")
    block = max(1, min(max_block, total // min_slots))
    goals = written(targets(sources))
    takes = schedule(goals, -(-total // block), block)
    laid = running_total(base, ["key"], "bucket", [F.col("hash"), F.col("doc_id"), F.col("size")], "size", "start", "place")
    numbers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    pieces = laid.filter("size > 0").withColumn("number", F.explode(numbers))
    shared = F.least(F.col("start") + F.col("size"), (F.col("number") + 1) * block) - F.greatest(F.col("start"), F.col("number") * block)
    row = ["key", "bucket", "place"]
    taken = pieces.withColumn("words", shared).join(takes, ["key", "number"]).groupBy(*row).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    goal, all_words = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    whole = F.floor(goal / all_words)
    once_more = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), goal - whole * all_words) - F.col("start"))
    words = F.when(coarse(block), F.col("size") * whole + once_more).otherwise(F.coalesce("taken", F.lit(0)))
    return laid.join(taken, row, "left").join(goals, "key").select("doc_id", "key", "size", "source_size", "target", words.cast("long").alias("taken"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("key")


#: From the contract: capping is iterated (every source above its cap is set to it and the rest reshared) until none is above.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS hash FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total, count(*) OVER () AS n FROM s),
it AS (SELECT 0::BIGINT AS k, max(total)::DOUBLE / sum(weight) AS level FROM w
       UNION ALL
       SELECT k + 1, (max(total) - coalesce(sum(cap) FILTER (weight * level > cap), 0))::DOUBLE / sum(weight) FILTER (weight * level <= cap)
       FROM it, w WHERE k < n GROUP BY k),
m AS (SELECT arg_max(level, k) AS level FROM it),
g AS (SELECT key, source_size, least(cap::DOUBLE, weight * m.level) AS target, total FROM w, m),
b AS (SELECT greatest(1, least({MAX_BLOCK}, max(total) // {MIN_SLOTS}))::BIGINT AS block, max(total)::BIGINT AS total FROM g),
h AS (SELECT key, source_size, coalesce(sum(target) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(target) OVER () AS lo
      FROM g WHERE source_size > 0),
h2 AS (SELECT key, source_size, lo, coalesce(lead(lo) OVER (ORDER BY key), 2) AS hi FROM h),
p AS (SELECT n, n * {PHI!r}::DOUBLE - floor(n * {PHI!r}::DOUBLE) AS x FROM (SELECT unnest(range((total + block - 1) // block)) AS n FROM b)),
r AS (SELECT key, source_size, row_number() OVER (PARTITION BY key ORDER BY n) - 1 AS rnk FROM p JOIN h2 ON lo <= x AND x < hi),
t AS (SELECT key, rnk % ((source_size + block - 1) // block) AS number, count(*) AS times FROM r, b
      WHERE rnk < {MOST} * ((source_size + block - 1) // block) GROUP BY ALL),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY key ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
             row_number() OVER () AS rid FROM d),
e AS (SELECT rid, key, start, size, unnest(range(start // block, (start + size - 1) // block + 1)) AS number FROM o, b WHERE size > 0),
k AS (SELECT rid, sum((least(start + size, (number + 1) * block) - greatest(start, number * block)) * times) AS taken
      FROM e JOIN t USING (key, number), b GROUP BY rid),
f AS (SELECT o.*, source_size, target, taken, block > 1 AND source_size < {FINE} * block AS coarse, round(target)::BIGINT AS goal, greatest(source_size, 1) AS words
      FROM o JOIN g USING (key) LEFT JOIN k USING (rid), b)
SELECT doc_id, size, source_size, target,
       CASE WHEN coarse THEN size * (goal // words) + greatest(0, least(start + size, goal % words) - start) ELSE coalesce(taken, 0) END::BIGINT AS taken FROM f
"""
