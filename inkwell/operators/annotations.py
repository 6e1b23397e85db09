"""Annotated texts: classes of notes, marks with their offsets, placeholders and their forms, fields of records.

Offsets are code points, from 0, with the end exclusive. Marks of one text are put in order within a group of that
text; no group is larger than a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.closure import resolved

#: Rows of a map of forms that are broadcast; a larger map is joined by shuffle.
MAX_BROADCAST = 100_000
EDGES = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def headword(note: Column, marker: str, colon: str, forbidden: str, most: int = 12) -> Column:
    """What stands before the first of the `colon` characters, after a leading marker: 1 to `most` characters, none of
    `forbidden` among them; else null."""
    head = trimmed(F.regexp_extract(trimmed(F.regexp_replace(note, f"^(?:{marker})", "")), f"^([^{colon}]*)[{colon}]", 1))
    return F.when(F.char_length(head).between(1, most) & ~head.rlike(f"[{forbidden}]"), head)


def structure(note: Column, head: Column, cross_reference: str, source: str, long: int) -> Column:
    """Class of a note, by the first rule that fits: cross_reference, headword_colon, long_source_note, quoted_source, other."""
    return F.when(note.rlike(cross_reference), "cross_reference").when(head.isNotNull(), "headword_colon").when(F.char_length(note) >= long, "long_source_note").when(note.rlike(source), "quoted_source").otherwise("other")


def source_hint(c: Column, pattern: str) -> Column:
    """The source that ends a text, or null."""
    found = F.regexp_extract(c, pattern, 0)
    return F.when(found != "", found)


def _pieces(column: Column, pattern: str) -> tuple[Column, Column]:
    """(texts between the matches, the matches); there is one more of the first."""
    return F.split(column, pattern, -1), F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def marks(texts: DataFrame, key: str, column: Column, pattern: str) -> DataFrame:
    """key, ordinal, gap, start, end, quote: every match, `gap` being the length of the text since the match before.
    `key` names one text each. The pattern must not match the empty text."""
    parts, found = _pieces(column, pattern)
    rows = texts.select(key, F.posexplode(F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.struct(F.char_length(p).alias("gap"), m.alias("quote")))).alias("ordinal", "m")).select(key, "ordinal", "m.gap", "m.quote")
    end = F.sum(F.col("gap") + F.char_length("quote")).over(Window.partitionBy(key).orderBy("ordinal"))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("quote")).select(key, "ordinal", "gap", "start", "end", "quote")


def forms(glyphs: DataFrame) -> DataFrame:
    """quote, form: the glyph map (src, form, same_as) with its aliases followed; a cycle of aliases is an error, and an
    alias of nothing has no form."""
    ends = resolved(glyphs.filter("same_as IS NOT NULL").select("src", "same_as"), "src", "same_as").select(F.col("name").alias("src"), "target")
    own = glyphs.filter("same_as IS NULL").select("src", "form")
    return own.withColumnRenamed("src", "quote").union(ends.join(own.select(F.col("src").alias("target"), "form"), "target", "left").select(F.col("src").alias("quote"), "form"))


def placed(texts: DataFrame, key: str, column: Column, pattern: str, known: DataFrame) -> DataFrame:
    """marks() with form, to_start, to_end: their place once each mark with a form (quote, form) has been put in its form.
    Marks without a form stay as they are."""
    small = known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    met = marks(texts, key, column, pattern).join(F.broadcast(known) if small else known, "quote", "left")
    out = F.char_length(F.coalesce("form", "quote"))
    to_end = F.sum(F.col("gap") + out).over(Window.partitionBy(key).orderBy("ordinal"))
    return met.withColumn("to_end", to_end).withColumn("to_start", F.col("to_end") - out)


def rendered(texts: DataFrame, key: str, column: Column, pattern: str, known: DataFrame) -> DataFrame:
    """key, rendered, unresolved, marks, verified: each text with its marks put in their forms, the marks at their new
    places, and whether the rendered text has what it should at each of them."""
    at = placed(texts, key, column, pattern, known)
    mine = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end", "quote", "form", "to_start", "to_end"))).alias("marks"))
    parts, _ = _pieces(F.col("_text"), pattern)
    out = F.transform(F.coalesce("marks", F.array().cast(mine.schema["marks"].dataType)), lambda m: F.coalesce(m["form"], m["quote"]))
    full = texts.select(key, column.alias("_text")).join(mine, key, "left").withColumn("rendered", F.array_join(F.zip_with(parts, out, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""))
    right = F.forall("marks", lambda m: F.substring(F.col("rendered"), m["to_start"] + 1, m["to_end"] - m["to_start"]) == F.coalesce(m["form"], m["quote"]))
    return full.select(key, "rendered", F.coalesce(F.size(F.filter("marks", lambda m: m["form"].isNull())), F.lit(0)).alias("unresolved"), "marks", F.coalesce(right, F.lit(True)).alias("verified"))


def missing_sites(at: DataFrame, key: str) -> DataFrame:
    """quote, key, n: marks without a form, by text."""
    return at.filter("form IS NULL").groupBy("quote", key).agg(F.count("*").alias("n"))


def holding(df: DataFrame, key: str, scalars: list[str], lists: list[str], mark: str) -> DataFrame:
    """key, field, place, text: the values of scalar and list fields that hold the mark."""
    row = lambda f, place, text: F.struct(F.lit(f).alias("field"), place.alias("place"), text.alias("text"))

    def placed_rows(f: str) -> Column:
        return F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), lambda x, i: row(f, i, x))

    every = F.concat(*[F.array(row(f, F.lit(0), F.col(f))) for f in scalars], *[placed_rows(f) for f in lists])
    every = F.filter(every, lambda x: F.contains(x["text"], F.lit(mark)))
    return df.select(key, F.inline(every))


def in_conflict(new: Column, old: Column) -> Column:
    """Whether both fields are given and differ."""
    return F.coalesce(new != old, F.lit(False))


def coalesced(new: Column, old: Column, what: Column) -> Column:
    """The field under its new name, else under its old one; a conflict is an error."""
    return F.when(in_conflict(new, old), F.raise_error(F.concat(F.lit("fields in conflict: "), what.cast("string")))).otherwise(F.coalesce(new, old))


def digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields by name, each with its length, so that no two lists of fields read alike; null is `-`."""
    part = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-")), F.lit(";"))
    return F.sha2(F.concat(*[part(n, fields[n].cast("string")) for n in sorted(fields)]), 256)


def answer_signal(answer: Column, author: Column, anchors: Column) -> Column:
    """struct<author, hits, signal>: whether the answer names the author, which anchors it holds, and both."""
    named = F.coalesce(F.contains(answer, author), F.lit(False))
    hits = F.filter(anchors, lambda a: F.contains(answer, a))
    return F.struct(named.alias("author"), hits.alias("hits"), (named & (F.size(hits) > 0)).alias("signal"))


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: keys of more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def code_point(form: Column) -> Column:
    """The character of a `U+XXXX` form; null for other texts, surrogates, the replacement character and code points that do not exist."""
    n = F.conv(F.regexp_extract(form, r"^U\+([0-9A-Fa-f]{4,6})$", 1), 16, 10).cast("long")
    byte = lambda high, shift, low=0x3F: F.lit(high) + F.shiftright(n, shift).bitwiseAND(low)
    encoded = F.when(n < 0x80, F.format_string("%02X", n)).when(n < 0x800, F.format_string("%02X%02X", byte(0xC0, 6, 0x1F), byte(0x80, 0))).when(n < 0x10000, F.format_string("%02X%02X%02X", byte(0xE0, 12, 0x0F), byte(0x80, 6), byte(0x80, 0))).otherwise(F.format_string("%02X%02X%02X%02X", byte(0xF0, 18, 0x07), byte(0x80, 12), byte(0x80, 6), byte(0x80, 0)))
    sound = (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF) & (n != 0xFFFD)
    return F.when(sound, F.decode(F.unhex(encoded), "UTF-8"))


def is_description(c: Column) -> Column:
    """Whether a text is an ideographic description: three characters or more, the first one an operator of description."""
    return (F.char_length(c) >= 3) & c.rlike(r"^[\x{2FF0}-\x{2FFF}]")


def code_points_before(c: Column, units: Column) -> Column:
    """The code-point offset of a UTF-16 offset: characters that end at it or before."""
    step = lambda acc, ch: F.struct((acc["u"] + F.when(ch.rlike(r"[\x{10000}-\x{10FFFF}]"), 2).otherwise(1)).alias("u"), (acc["n"] + F.when(acc["u"] + F.when(ch.rlike(r"[\x{10000}-\x{10FFFF}]"), 2).otherwise(1) <= units, 1).otherwise(0)).alias("n"))
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.struct(F.lit(0).alias("u"), F.lit(0).alias("n")), step)["n"]
