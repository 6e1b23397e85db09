"""Audit of five document filters that are applied in any order, with exact duplicates by partition refinement.

A: under 100 words. B: fewer than 80 % of the words are distinct. C: over 10 % of the code points are A-Z.
D: one of `#$%&*|`. E: the text is that of a smaller doc_id, table-wide, whether that one is removed or not.

Duplicates: all rows are one class, which is split by code-point length, then by the hash of each next block of the
text (256 code points, then four times as many each time). Rows that are alone in their class leave at once and are
no duplicates. Where no block is left, the full texts of the remaining classes are compared: a class whose rows
hold one text marks every id but the least; a class of several texts (a collision of hashes) is told apart by text.
Blocks are hashed in the one pass that counts words; the rounds move ids, keys and masks, never texts. A class may
hold any share of the rows: counts are combined before they are shuffled, and hot keys meet their count by broadcast.

Each row then is a mask of five bits. Rows are counted by part and mask, and all 120 orders of the filters are
read off those 32 counts a part, so nothing but counts is ever multiplied by the orders.

Defined results: a null text is empty (0 words: A fails, B to D hold) and is the duplicate of any other empty text;
a row without doc_id is no duplicate of any row, nor any of it; rows that share an id and a text do not make each
other duplicates; a null lang is the part ''; several labels of one id count once if any of them is 1; very long
texts are read whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import HOT, MOST_HOT, UPPER, WORD, joined, table, written

LETTERS = "ABCDE"
#: Code points of the first block; each later one has four times as many, the last all that is left.
FIRST, BLOCKS = 256, 12
#: Classes whose keys are broadcast to find their texts; more are met by a shuffle.
MAX_BROADCAST = 1_000_000


def failing(text: Column) -> Column:
    """Bits 0 to 3: whether filters A to D remove the text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, points = F.size(words), F.char_length(text)
    tests = (n < 100, F.size(F.array_distinct(words)) * 100 < n * 80, (points - F.char_length(F.translate(text, UPPER, ""))) * 100 > points * 10, text.rlike(r"[#$%&*|]"))
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("int")


def block_hashes(text: Column, first: int, bits: int) -> Column:
    """The hash of each successive block; as many as the text has. `bits` of a hash count (64 but in tests)."""
    out, start = [], 0
    for i in range(BLOCKS):
        size = first * 4**i if i < BLOCKS - 1 else 2**31 - 1 - start
        out.append(F.when(F.char_length(text) > start, F.shiftrightunsigned(F.xxhash64(F.substring(text, start + 1, size)), 64 - bits)))
        start += size
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _next(key: Column, block: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, block), 64 - bits)


def refined(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """rows (key, blocks, ...) -> (rows that are alone in their class, rows in company of the same length and blocks)."""
    alone, done, at, total = [], [], 0, None
    while True:
        counts = written(rows.groupBy("key").agg(F.count("*").alias("_c")))
        total = counts.agg(F.sum("_c")).first()[0] or 0 if total is None else total
        hot = counts.filter(F.col("_c") > max(HOT, total // MOST_HOT)).select("key")
        told = written(joined(rows, counts, ["key"], hot=hot))
        alone.append(told.filter("_c = 1").drop("_c"))
        company = told.filter("_c > 1").drop("_c")
        done.append(company.filter(F.size("blocks") <= at))
        rows = company.filter(F.size("blocks") > at).withColumn("key", _next(F.col("key"), F.get("blocks", F.lit(at)), bits))
        at += 1
        if not rows.limit(1).count():
            break
    return reduce(DataFrame.unionByName, alone), reduce(DataFrame.unionByName, done)


def duplicates(docs: DataFrame, carried: list[str], first: int = FIRST, bits: int = 64) -> DataFrame:
    """The columns `carried` and `copy`: whether the row's text is that of a row with a smaller doc_id. docs: doc_id, text (not null), carried."""
    # `last` is the key of a text after all its blocks, `key` that of the round.
    fold = F.aggregate(F.col("blocks"), F.col("key"), lambda k, b: _next(k, b, bits))
    hashed = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", *carried, F.char_length("text").cast("long").alias("key"), block_hashes(F.col("text"), first, bits).alias("blocks")).withColumn("last", fold)
    unnamed = docs.filter("doc_id IS NULL").select(*carried, F.lit(False).alias("copy"))
    alone, company = refined(written(hashed.drop("text")), bits)
    keys = written(company.select("last").distinct())
    # The texts of the remaining classes are read again and compared; copies are folded where they are read.
    texts = hashed.select("doc_id", "text", *carried, "last").join(F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys, "last", "left_semi")
    one = written(texts.groupBy("last", "text").agg(F.min("doc_id").alias("least")).groupBy("last").agg(F.count("*").alias("texts"), F.min("least").alias("least")))
    several = one.filter("texts > 1").select("last")
    mixed = several.limit(1).count()
    alone = alone.join(several, "last", "left_anti") if mixed else alone  # told apart by text below
    marked = joined(company, one.filter("texts = 1").select("last", "least"), ["last"]).select(*carried, (F.col("doc_id") > F.col("least")).alias("copy"))
    out = unnamed.unionByName(alone.select(*carried, F.lit(False).alias("copy"))).unionByName(marked)
    if mixed:  # different texts of one length and equal hashes
        held = texts.join(several, "last", "left_semi")
        told = held.join(held.groupBy("last", "text").agg(F.min("doc_id").alias("least")), ["last", "text"])
        out = out.unionByName(told.select(*carried, (F.col("doc_id") > F.col("least")).alias("copy")))
    return out


def masks(docs: DataFrame, labels: DataFrame, first: int = FIRST, bits: int = 64) -> DataFrame:
    """part, mask (bits of A to E), n, good, toxic: documents by the filters that they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text")).withColumn("mask", failing(F.col("text")))
    told = duplicates(rows.withColumn("id", F.col("doc_id")), ["id", "part", "mask"], first, bits)
    told = told.select("id", "part", (F.col("mask") + F.when(F.col("copy"), 16).otherwise(0)).alias("mask"))
    own = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    return told.join(own, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """counts by part and mask -> a row for each part, order of the filters and step."""
    per = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 at most
    steps = [{"filter_order": "".join(p), "step": i + 1, "bit": 1 << LETTERS.index(c), "before": sum(1 << LETTERS.index(x) for x in p[:i])} for p in permutations(LETTERS) for i, c in enumerate(p)]
    rows = per.select("part", "m", F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")))
    fails = lambda x: x["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda x: x["mask"].bitwiseAND(F.col("before")) != 0
    total = lambda test, of="n", times=None: F.aggregate(F.filter("m", test), F.lit(0).cast("long"), lambda a, x: a + x[of] * (times(x) if times else F.lit(1)))
    removed = lambda x: fails(x) & ~gone(x)
    # Of the 120 orders, one in as many as the mask has bits meets this filter before the mask's others.
    share = lambda x: (F.lit(120) / F.bit_count(x["mask"])).cast("long")
    return rows.select(
        "part", "filter_order", "step", total(lambda x: ~gone(x) & ~fails(x)).alias("kept"), total(removed).alias("removed"), total(lambda x: fails(x) & gone(x)).alias("redundant"), total(lambda x: x["mask"] == F.col("bit")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), total(fails, "n", share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, first: int = FIRST, bits: int = 64) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(masks(docs, labels, first, bits))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT
 + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
 sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
 sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
