"""Notes, marks, placeholders and fields over documents, pages, labels and conversations.

A line of a document is read as a note of it. The tables are in Latin letters, so a comma stands for the colon after a headword.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import annotations as A
from inkwell.sources.tables import table

MARKER = r"\s*\[\d+\]"
FORBIDDEN = r".!?\"()"
CROSS = r"(?i)\b(?:see|voir|siehe|cf)\b"
SOURCE = r"\([^()]{0,80}\)[.!?]?\s*$"
LONG = 120
# The marks of titles and what they stand for; `***` is an alias, `$$$` an alias of nothing, `###` has no form.
MARKS = r"%%%|[*]{3}|###|[$]{3}"
GLYPHS = [("%%%", "‰", None), ("***", None, "%%%"), ("$$$", None, "@@@")]
TITLE = "(?s)<title>(.*?)</title>"
ANCHOR = '<a href="[^"]*">([^<]*)</a>'


def _notes(spark, d) -> DataFrame:
    """doc_id, line, note, body: the lines of each document, and its first line."""
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    return docs.select("doc_id", F.element_at("lines", 1).alias("body"), F.posexplode("lines").alias("line", "note")).filter("line > 0")


def note_structure(spark, d):
    """Notes of each document by class, with their headwords and those that the first line holds."""
    n = _notes(spark, d).withColumn("head", A.headword(F.col("note"), MARKER, ",", FORBIDDEN)).withColumn("structure", A.structure(F.col("note"), F.col("head"), CROSS, SOURCE, LONG))
    return n.groupBy("doc_id", "structure").agg(F.count("*").alias("n"), F.count("head").alias("headwords"), F.count_if(F.contains("body", F.col("head"))).alias("in_body"))


NOTE_STRUCTURE = r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), n AS (SELECT doc_id, p[1] AS body, unnest(p[2:]) AS note FROM l),
h AS (SELECT *, trim(regexp_replace(note, '^\s*\[\d+\]', ''), E' \n\t\r') AS t FROM n), g AS (SELECT *, CASE WHEN strpos(t, ',') > 0 THEN trim(left(t, strpos(t, ',') - 1), E' \n\t\r') END AS x FROM h),
k AS (SELECT *, CASE WHEN length(x) BETWEEN 1 AND 12 AND NOT regexp_matches(x, '[.!?"()]') THEN x END AS head FROM g)
SELECT doc_id, CASE WHEN regexp_matches(note, '(?i)\b(?:see|voir|siehe|cf)\b') THEN 'cross_reference' WHEN head IS NOT NULL THEN 'headword_colon' WHEN length(note) >= 120 THEN 'long_source_note'
 WHEN regexp_matches(note, '\([^()]{0,80}\)[.!?]?\s*$') THEN 'quoted_source' ELSE 'other' END AS structure, count(*) AS n, count(head) AS headwords, count(*) FILTER (contains(body, head)) AS in_body FROM k GROUP BY 1, 2"""


def source_hints(spark, d):
    """Sentences that end in a source in brackets, with the source."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("place", "s")).select("doc_id", "place", A.source_hint(F.col("s.text"), SOURCE).alias("hint"))
    return s.filter("hint IS NOT NULL")


SOURCE_HINTS = r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]+["'')]*|[^.!?]+$'), lambda x: trim(x, E' \n\t\r')), lambda x: regexp_matches(x, '[^\s.!?"'')]')) AS s FROM documents),
u AS (SELECT doc_id, unnest(s) AS t, (generate_subscripts(s, 1) - 1)::INT AS place FROM s)
SELECT doc_id, place, regexp_extract(t, '\([^()]{0,80}\)[.!?]?\s*$') AS hint FROM u WHERE regexp_matches(t, '\([^()]{0,80}\)[.!?]?\s*$')"""


def _titles(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", TITLE, 1).alias("title"))


def _forms(spark) -> DataFrame:
    return A.forms(spark.createDataFrame(GLYPHS, "src string, form string, same_as string"))


def gap_marks(spark, d):
    """Marks of each title: their places in it, and in the title once marks that have a form stand in it."""
    return A.placed(_titles(spark, d), "page_id", F.col("title"), MARKS, _forms(spark)).select("page_id", "ordinal", "start", "end", "quote", "form", "to_start", "to_end")


TITLES_SQL = r"""t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
f AS (SELECT * FROM (VALUES ('%%%', '‰'), ('***', '‰'), ('$$$', NULL)) v(quote, form)),
m AS (SELECT page_id, unnest(q) AS quote, unnest(p[:len(q)]) AS part, generate_subscripts(q, 1) AS i FROM (SELECT page_id, regexp_extract_all(title, '%%%|[*]{3}|###|[$]{3}') AS q, regexp_split_to_array(title, '%%%|[*]{3}|###|[$]{3}') AS p FROM t))"""
GAP_MARKS = f"""WITH {TITLES_SQL}, r AS (SELECT page_id, i, quote, form, sum(length(part) + length(quote)) OVER w AS e, sum(length(part) + length(coalesce(form, quote))) OVER w AS te FROM m LEFT JOIN f USING (quote) WINDOW w AS (PARTITION BY page_id ORDER BY i))
SELECT page_id, (i - 1)::INT AS ordinal, (e - length(quote))::BIGINT AS start, e::BIGINT AS "end", quote, form, (te - length(coalesce(form, quote)))::BIGINT AS to_start, te::BIGINT AS to_end FROM r"""


def glyph_titles(spark, d):
    """Titles with their marks in the forms of the map; marks left as they are; whether every mark is found at its new place."""
    return A.rendered(_titles(spark, d), "page_id", F.col("title"), MARKS, _forms(spark)).select("page_id", "rendered", "unresolved", "verified")


GLYPH_TITLES = r"""WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, regexp_replace(title, '%%%|[*]{3}', '‰', 'g') AS rendered, len(regexp_extract_all(title, '###|[$]{3}'))::INT AS unresolved, length(regexp_replace(title, '%%%|[*]{3}', '‰', 'g')) = length(title) - 2 * len(regexp_extract_all(title, '%%%|[*]{3}')) AS verified FROM t"""


def missing_forms(spark, d):
    """Marks without a form, by page."""
    return A.missing_sites(A.placed(_titles(spark, d), "page_id", F.col("title"), MARKS, _forms(spark)), "page_id")


MISSING_FORMS = f"WITH {TITLES_SQL} SELECT quote, page_id, count(*) AS n FROM m LEFT JOIN f USING (quote) WHERE form IS NULL GROUP BY ALL"


def unresolved_fields(spark, d):
    """Titles and link texts of pages that still hold a mark without a form."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("html", TITLE, 1).alias("title"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("links"))
    return A.holding(p, "page_id", ["title"], ["links"], "###")


UNRESOLVED_FIELDS = """WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS links FROM pages)
SELECT page_id, 'title' AS field, 0 AS place, title AS text FROM p WHERE contains(title, '###')
UNION ALL SELECT * FROM (SELECT page_id, 'links', (generate_subscripts(links, 1) - 1)::INT, unnest(links) AS text FROM p) WHERE contains(text, '###')"""


def legacy_fields(spark, d):
    """Language of a page under its new name (of the markup), else its old one (of the path), pages in conflict, and a digest of both."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("a"), F.regexp_extract("url", r"^\w+://[^/]+/(\w\w)/", 1).alias("b"))
    p = p.select("page_id", F.nullif("a", F.lit("")).alias("new"), F.nullif("b", F.lit("")).alias("old"))
    clash = A.in_conflict(F.col("new"), F.col("old"))
    return p.select("page_id", clash.alias("conflict"), F.when(~clash, A.coalesced(F.col("new"), F.when(~clash, F.col("old")), F.col("page_id"))).alias("lang"), A.digest({"new": F.col("new"), "old": F.col("old")}).alias("digest"))


LEGACY_FIELDS = r"""WITH p AS (SELECT page_id, nullif(regexp_extract(html, '<html lang="(\w+)"', 1), '') AS new, nullif(regexp_extract(url, '^\w+://[^/]+/(\w\w)/', 1), '') AS old FROM pages)
SELECT page_id, coalesce(new <> old, false) AS conflict, CASE WHEN NOT coalesce(new <> old, false) THEN coalesce(new, old) END AS lang,
 sha256('new=' || coalesce(length(new) || ':' || new, '-') || ';old=' || coalesce(length(old) || ':' || old, '-') || ';') AS digest FROM p"""


def answer_signals(spark, d):
    """Assistant turns against the user turn before them: whether its first word is named, which of its other long words are."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    asked = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.filter(F.array_distinct(F.split("text", "[ \n.,!?]+")), lambda w: F.char_length(w) >= 5).alias("w"))
    met = c.filter("role = 'assistant'").join(asked, ["conv_id", "turn"]).withColumn("s", A.answer_signal(F.col("text"), F.try_element_at("w", F.lit(1)), F.slice("w", 2, 1000000)))
    return met.groupBy("conv_id", "turn").agg(F.max("s.author").alias("named"), F.sum(F.size("s.hits")).alias("hits"), F.max("s.signal").alias("signal"))


ANSWER_SIGNALS = r"""WITH u AS (SELECT conv_id, turn + 1 AS turn, regexp_split_to_array(text, '[ \n.,!?]+') AS r FROM conversations WHERE role = 'user'),
x AS (SELECT DISTINCT conv_id, turn, min(i) AS i, w FROM (SELECT conv_id, turn, unnest(r) AS w, generate_subscripts(r, 1) AS i FROM u) WHERE length(w) >= 5 GROUP BY conv_id, turn, w),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND (conv_id, turn) IN (SELECT (conv_id, turn) FROM u)),
y AS (SELECT a.conv_id, a.turn, coalesce(contains(a.text, w), false) AS hit, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY i) AS n FROM a LEFT JOIN x USING (conv_id, turn))
SELECT conv_id, turn, bool_or(hit AND n = 1) AS named, count(*) FILTER (hit AND n > 1) AS hits, bool_or(hit AND n = 1) AND count(*) FILTER (hit AND n > 1) > 0 AS signal FROM y GROUP BY ALL"""


def evaluation_set(spark, d):
    """Labelled documents that are of quality, not toxic and in the corpus, and how many labels their id has."""
    l = table(spark, d, "labels")
    many = A.duplicated(l, ["doc_id"]).withColumnRenamed("n", "labels")
    kept = l.filter("quality >= 1 AND toxic = 0").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    return kept.join(many, "doc_id", "left").select("doc_id", "quality", F.coalesce("labels", F.lit(1)).alias("labels"))


EVALUATION_SET = """SELECT doc_id, quality, labels FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS labels FROM labels) WHERE quality >= 1 AND toxic = 0 AND doc_id IN (SELECT doc_id FROM documents)"""


def gold_quotes(spark, d):
    """Labelled documents against the corpus: whether the document is there and has the benchmark item of its number, white space aside."""
    gold = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(table(spark, d, "benchmark").select("item_id", T.squeeze(F.col("text")).alias("quote")), "item_id")
    met = gold.join(table(spark, d, "documents").select("doc_id", "text", F.lit(True).alias("there")), "doc_id", "left")
    status = F.when(F.col("there").isNull(), "no_section").when(F.contains(T.squeeze(F.col("text")), F.col("quote")), "ok").otherwise("not_contained")
    return met.groupBy("item_id", status.alias("status")).agg(F.count("*").alias("n"))


GOLD_QUOTES = r"""SELECT b.item_id, CASE WHEN d.doc_id IS NULL THEN 'no_section' WHEN contains(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g')) THEN 'ok' ELSE 'not_contained' END AS status, count(*) AS n
FROM labels l JOIN benchmark b ON l.doc_id % 40 = b.item_id LEFT JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1, 2"""


QUERIES = {
    "note_structure": (note_structure, NOTE_STRUCTURE), "source_hints": (source_hints, SOURCE_HINTS), "gap_marks": (gap_marks, GAP_MARKS), "glyph_titles": (glyph_titles, GLYPH_TITLES),
    "missing_forms": (missing_forms, MISSING_FORMS), "unresolved_fields": (unresolved_fields, UNRESOLVED_FIELDS), "legacy_fields": (legacy_fields, LEGACY_FIELDS),
    "answer_signals": (answer_signals, ANSWER_SIGNALS), "evaluation_set": (evaluation_set, EVALUATION_SET), "gold_quotes": (gold_quotes, GOLD_QUOTES),
}
