"""Nested payloads of providers as flat evidence: schemas, flattening, unique names, permitted items, one schema for two generations.

A payload is one JSON text; what is taken from it stays within its row, so nothing here is larger than a payload. Parts that are
missing or of another kind read as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The schemas of payloads.
REFERENCES = "struct<Sentences:array<struct<Clause:string,References:array<struct<Clause:string,Title:string,Author:string,Dynasty:string,WritingId:bigint>>>>>"
ALLUSIONS = "array<struct<Explains:array<struct<Explain:string>>,Quotes:array<struct<Content:string,Book:string>>>>"
CATEGORIES = "struct<Categories:array<struct<Id:string,Name:string,Chars:array<struct<Char:string>>,PingShuiCategories:array<struct<Id:string,Chars:array<struct<Char:string>>>>>>>"
#: Fields of a piece of evidence, in their order.
EVIDENCE = ["anchor", "type", "text", "title", "author", "url", "provider", "status", "metadata"]


def given(c: Column) -> Column:
    """The text, null if it is empty."""
    return F.when(c != "", c)


def references(payloads: DataFrame, key: str, query: str, payload: str) -> DataFrame:
    """key and evidence: a row for each reference with a clause, under the clause of its sentence, else under the query."""
    each = payloads.select(key, query, F.inline(F.from_json(payload, REFERENCES)["Sentences"])).select(key, F.coalesce(given(F.col("Clause")), F.col(query)).alias("anchor"), F.explode("References").alias("r")).filter(given(F.col("r.Clause")).isNotNull())
    return each.select(key, "anchor", F.lit("reference").alias("type"), F.col("r.Clause").alias("text"), F.col("r.Title").alias("title"), F.col("r.Author").alias("author"), F.lit("candidate").alias("status"), F.create_map(F.lit("dynasty"), F.col("r.Dynasty"), F.lit("writing_id"), F.col("r.WritingId").cast("string")).alias("metadata"))


def allusions(payloads: DataFrame, key: str, query: str, payload: str, labels: tuple[str, str] = ("meaning: ", "quote: ")) -> DataFrame:
    """key and evidence: the first meaning and the first quotation of each entry, as lines; entries with neither go."""
    each = payloads.select(key, F.col(query).alias("anchor"), F.inline(F.from_json(payload, ALLUSIONS)))
    first = lambda c: F.try_element_at(c, F.lit(1))
    meaning, quote = given(first(F.col("Explains"))["Explain"]), given(first(F.col("Quotes"))["Content"])
    text = F.concat_ws("\n", F.concat(F.lit(labels[0]), meaning), F.concat(F.lit(labels[1]), quote))
    return each.select(key, "anchor", F.lit("allusion").alias("type"), text.alias("text"), given(first(F.col("Quotes"))["Book"]).alias("title"), F.lit("candidate").alias("status")).filter("text <> ''")


def evidence(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """key and all fields of evidence, of several providers; fields that a provider lacks are null."""
    out = None
    for provider, df in parts.items():
        df = df.withColumn("provider", F.lit(provider))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(key, *[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in EVIDENCE])


def categories(payloads: DataFrame, key: str, payload: str, character: Column, sample: int = 70) -> DataFrame:
    """key, id, name, n, sample, present: the characters of each category, its own before those of its groups, and whether `character` is one."""
    each = payloads.select(key, character.alias("_c"), F.inline(F.from_json(payload, CATEGORIES)["Categories"]))
    none = F.array().cast("array<struct<Char:string>>")
    members = F.concat(F.coalesce("Chars", none), F.flatten(F.transform(F.coalesce("PingShuiCategories", F.array().cast("array<struct<Id:string,Chars:array<struct<Char:string>>>>")), lambda g: F.coalesce(g["Chars"], none))))
    each = each.withColumn("m", F.filter(F.transform(members, lambda x: x["Char"]), lambda c: c.isNotNull()))
    return each.select(key, F.col("Id").alias("id"), F.col("Name").alias("name"), F.size("m").alias("n"), F.slice("m", 1, sample).alias("sample"), F.coalesce(F.array_contains("m", F.col("_c")), F.lit(False)).alias("present"))


def unique_name(entries: DataFrame, asked: DataFrame, most: int = 7) -> DataFrame:
    """asked, status, id, candidates: entries (id, name, aliases) whose name or alias is what is asked (asked, distinct): `ok` with one
    entry, `candidates` with several (the first `most` ids, counted in n), `no_hit` with none."""
    names = entries.select("id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("asked")).filter("asked IS NOT NULL")
    met = asked.join(names, "asked", "left")
    place = F.row_number().over(Window.partitionBy("asked").orderBy("id"))
    counts = met.groupBy("asked").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    few = met.withColumn("place", place).filter(F.col("place") <= most).groupBy("asked").agg(F.sort_array(F.collect_list("id")).alias("candidates"))
    status = F.when(F.col("n") == 0, "no_hit").when(F.col("n") == 1, "ok").otherwise("candidates")
    return counts.join(few, "asked").select("asked", "n", status.alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"), "candidates")


def permitted(requests: DataFrame, shown: DataFrame, scope: list[str], item: str, at: str) -> DataFrame:
    """requests with `permitted`: whether the item was shown in the same scope before. What was shown is reduced to its first time first."""
    first = shown.filter(F.col(item).isNotNull()).groupBy(*scope, item).agg(F.min(at).alias("_first"))
    return requests.join(first, [*scope, item], "left").withColumn("permitted", F.coalesce(F.col("_first") < F.col(at), F.lit(False))).drop("_first")


def unified(methods: Column, moves: Column) -> tuple[Column, Column]:
    """(methods, origin): a record of either generation in the form of the later one; each move is a method with one piece of evidence.
    A record with both or neither has origin `ambiguous` and null methods. Nothing that a generation lacks is made up."""
    newer, older = F.coalesce(F.size(methods), F.lit(0)) > 0, F.coalesce(F.size(moves), F.lit(0)) > 0
    as_method = lambda m: F.struct(m["method_code"].alias("code"), m["analysis"].alias("argument_path"), F.array(F.struct(m["paragraph"].alias("paragraph"), m["exact_quote"].alias("quote"), m["char_start"].alias("char_start"))).alias("evidence"))
    origin = F.when(newer & ~older, "later").when(older & ~newer, "earlier").otherwise("ambiguous")
    return F.when(newer & ~older, methods).when(older & ~newer, F.transform(moves, as_method)), origin


def ordered_urls(results: DataFrame, keys: list[str], order: list[Column], url: str, keep: Column, most: int = 5) -> DataFrame:
    """The first `most` distinct urls of each key that fit, in the order given, numbered from 1 as `rank`."""
    once = results.filter(keep).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, url).orderBy(*order))).filter("_n = 1").drop("_n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)
