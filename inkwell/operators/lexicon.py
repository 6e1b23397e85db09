"""Lookup of terms in a lexicon: by headword or variant, else by an inverted index of short character grams.

A term that stands inside an entry's text has all its grams there, so one of them, the rarest, gives the candidates,
which are then compared with the whole term. Grams of 1 to SIZE characters are kept, so terms of any length are met exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.ranking import top_k_per_group

SIZE = 3


def _grams(text: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, size))


def grams(entries: DataFrame, key: str = "id", text: str = "text", size: int = SIZE) -> DataFrame:
    """gram, key: the distinct grams of 1 to `size` characters of each text. Keep it as a table (`sources.files.write_table`)."""
    every = F.flatten(F.array(*[F.when(F.char_length(text) >= n, _grams(F.col(text), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(1, size + 1)]))
    return entries.filter(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(every)).alias("gram"))


def holding(terms: DataFrame, entries: DataFrame, postings: DataFrame, key: str = "id", text: str = "text", size: int = SIZE) -> DataFrame:
    """term, key: entries whose text holds the term; terms: term (not empty, distinct). postings: grams() of the entries."""
    own = terms.select("term", F.explode(F.array_distinct(_grams(F.col("term"), F.least(F.char_length("term"), F.lit(size))))).alias("gram"))
    many = postings.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no entry has counts 0, so the term's rarest gram then leads to none.
    rarest = own.join(many, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).filter("g.n > 0").select("term", F.col("g.gram").alias("gram"))
    return rarest.join(postings, "gram").join(entries.select(key, text), key).filter(F.contains(F.col(text), F.col("term"))).select("term", key)


def lookup(terms: DataFrame, entries: DataFrame, postings: DataFrame, k: int, key: str = "id") -> DataFrame:
    """term, tier, rank, key: for each distinct term the entries whose headword or one of whose variants it is (tier 0), and only where
    there is none those whose text holds it (tier 1); the first k by key. entries: key, headword, variants, text. Null and empty terms have no hits."""
    asked = terms.select("term").filter("term <> ''").distinct()
    names = entries.select(key, F.explode(F.array_distinct(F.concat(F.array("headword"), F.coalesce("variants", F.array().cast("array<string>"))))).alias("term")).filter("term IS NOT NULL")
    exact = asked.join(names, "term").withColumn("tier", F.lit(0))
    inside = holding(asked.join(names.select("term").distinct(), "term", "left_anti"), entries, postings, key).withColumn("tier", F.lit(1))
    return top_k_per_group(exact.select("term", "tier", key).unionByName(inside.select("term", "tier", key)), ["term"], [F.col(key)], k).select("term", "tier", "rank", key)
