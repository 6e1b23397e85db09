"""Text functions as Column expressions.

Every rule takes its alphabet, so that the same code serves classical Chinese
(CJK) and Latin text. Offsets are code points, from 0, with the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space; `\\s` alone is ASCII in Java.
SPACE = r"(?U)\s+"
LETTERS = r"[\p{L}\p{N}]+"
OTHER = r"[^\p{L}\p{N}]"


@dataclass(frozen=True)
class Marks:
    """Characters inside a regex class: ends of sentences, ends of clauses, marks that close after an end."""

    sentence: str
    clause: str
    closing: str


# Punctuation of the two alphabets.
CJK = Marks(sentence="。！？!?", clause="，,；;。！？!?", closing="”’」』】）》")
LATIN = Marks(sentence=".!?", clause=",;:.!?", closing="\"')")


def squeeze(c: Column) -> Column:
    """White space removed."""
    return F.regexp_replace(c, SPACE, "")


def fingerprint(c: Column) -> Column:
    """SHA-256 of the text without white space."""
    return F.sha2(squeeze(c), 256)


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, OTHER, "")


def runs(c: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(c, F.lit(LETTERS), F.lit(0))


def ngrams(c: Column, low: int = 2, high: int = 3) -> Column:
    """Character n-grams within runs, with repeats: by run, then n, then place."""
    def of(run: Column) -> Column:
        grams = lambda n: F.transform(F.sequence(F.lit(1), F.char_length(run) - n + 1), lambda i: F.substring(run, i, n))
        return F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.char_length(run))), lambda n: F.when(F.char_length(run) >= n, grams(n)).otherwise(F.array().cast("array<string>"))))

    return F.flatten(F.transform(F.filter(runs(c), lambda r: F.char_length(r) >= low), of))


def words(c: Column) -> Column:
    """Lower-cased words of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def spans(c: Column, ends: str, closing: str) -> Column:
    """array<struct<start,end,text>>: the text cut after runs of end marks and the closing marks that follow,
    trimmed; spans without any character but spaces and marks are left out."""
    pieces = F.regexp_extract_all(c, F.lit(f"[^{ends}]*[{ends}]+[{closing}]*|[^{ends}]+$"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def add(acc: Column, piece: Column) -> Column:
        left = F.regexp_replace(piece, r"^(?U)\s+", "")
        text = F.regexp_replace(left, r"(?U)\s+$", "")
        begin = acc["at"] + F.char_length(piece) - F.char_length(left)
        span = F.struct(begin.alias("start"), (begin + F.char_length(text)).alias("end"), text.alias("text"))
        keep = text.rlike(rf"(?U)[^\s{ends}{closing}]")
        return F.struct((acc["at"] + F.char_length(piece)).alias("at"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, add)["out"]


def sentences(c: Column, marks: Marks = LATIN) -> Column:
    return spans(c, marks.sentence, marks.closing)


def sentence_texts(c: Column, marks: Marks = LATIN) -> Column:
    """The texts of sentences() without their places: no state goes from one to the next, so this is linear."""
    pieces = F.regexp_extract_all(c, F.lit(f"[^{marks.sentence}]*[{marks.sentence}]+[{marks.closing}]*|[^{marks.sentence}]+$"), F.lit(0))
    trimmed = F.transform(pieces, lambda x: F.regexp_replace(F.regexp_replace(x, r"^(?U)\s+", ""), r"(?U)\s+$", ""))
    return F.filter(trimmed, lambda x: x.rlike(rf"(?U)[^\s{marks.sentence}{marks.closing}]"))


def clauses(c: Column, marks: Marks = LATIN) -> Column:
    return spans(c, marks.clause, marks.closing)


def unit_count(c: Column, marks: Marks = LATIN) -> Column:
    """Estimate of the sentences: non-blank parts between end marks."""
    return F.size(F.filter(F.split(c, f"[{marks.sentence}]+"), lambda x: F.trim(x) != ""))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, the ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def excerpt(c: Column, n: int) -> Column:
    """The first n characters of the collapsed text, with an ellipsis if cut."""
    flat = collapse(c)
    return F.when(F.char_length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def snippet(c: Column, needle: Column, width: int) -> Column:
    """A window around the first match: from a quarter of the width before it if it lies beyond half the width."""
    at = F.instr(c, needle)
    begin = F.when(at - 1 > width // 2, at - 1 - width // 4).otherwise(F.lit(0))
    cut = F.substring(c, begin + 1, F.lit(width))
    return F.concat(F.when(begin > 0, F.lit("…")).otherwise(F.lit("")), cut, F.when(begin + width < F.char_length(c), F.lit("…")).otherwise(F.lit("")))


def same_hit(a: Column, b: Column, least: int = 6) -> Column:
    """Whether one text holds the other, both without white space and of `least` characters or more."""
    x, y = squeeze(a), squeeze(b)
    return (F.least(F.char_length(x), F.char_length(y)) >= least) & (F.contains(x, y) | F.contains(y, x))


def punctuation_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\p{P}+|[^\p{P}]+"), F.lit(0))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: code points and one more for each beyond the basic plane."""
    return F.char_length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def citations(c: Column) -> Column:
    """Distinct numbers in square brackets, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


def plain_markup(c: Column) -> Column:
    """Wiki markup removed: comments, references, templates, link targets, headings, emphasis, entities of a space."""
    steps = [(r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", ""), (r"\{\{[^{}]*\}\}", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"), (r"'{2,}", ""), (r"<[^>]+>", ""), (r"&nbsp;", " ")]
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)
