"""Annotations and payloads on odd rows, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from inkwell.operators import annotations as A
from inkwell.operators import payload as P

MARKS = r"\{\{glyph:\w+\}\}"
TEXTS = [None, "", "plain", "{{glyph:a}}", "x{{glyph:a}}{{glyph:b}}y{{glyph:c}}", "𠀀{{glyph:b}}é\n{{glyph:zz}}"]
FORMS = {"{{glyph:a}}": "甲", "{{glyph:b}}": "甲"}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


@pytest.fixture(scope="module")
def known(spark):
    return A.forms(spark.createDataFrame([("{{glyph:a}}", "甲", None), ("{{glyph:b}}", None, "{{glyph:a}}"), ("{{glyph:c}}", None, "{{glyph:none}}")], "src string, form string, same_as string"))


def test_marks(texts):
    got = sorted((r["id"], r["start"], r["end"], r["quote"]) for r in A.marks(texts, "id", F.col("text"), MARKS).collect())
    assert got == sorted((i, m.start(), m.end(), m[0]) for i, t in enumerate(TEXTS) for m in re.finditer(MARKS, t or ""))


def test_rendered(texts, known):
    got = {r["id"]: r for r in A.rendered(texts, "id", F.col("text"), MARKS, known).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = None if t is None else re.sub(MARKS, lambda m: FORMS.get(m[0], m[0]), t)
        assert got[i]["rendered"] == want and got[i]["verified"]
        assert got[i]["unresolved"] == sum(m not in FORMS for m in re.findall(MARKS, t or ""))


def test_cycle_of_aliases(spark):
    with pytest.raises(ValueError, match="cycle|itself"):
        A.forms(spark.createDataFrame([("a", None, "b"), ("b", None, "a")], "src string, form string, same_as string")).collect()


def test_headwords(spark):
    rows = [("[1] 天：地", "天"), ("云", None), ("：x", None), ("a:b", "a"), ("，a:b", None), ("a" * 13 + ":", None), ("a" * 12 + ":", "a" * 12), (None, None), ("", None)]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", A.headword(F.col("t"), r"\s*\[\d+\]", "：:", "，。"))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_structure_and_source(spark):
    rows = [("见前注", "cross_reference"), ("天：地", "headword_colon"), ("长" * 30, "long_source_note"), ("语（《书》）", "quoted_source"), ("语", "other")]
    df = spark.createDataFrame(rows, "t string, want string")
    head = A.headword(F.col("t"), r"\[\d+\]", "：:", "，。")
    got = df.withColumn("got", A.structure(F.col("t"), head, "见前", r"（[^（）]{0,80}《[^》]{1,80}》[^（）]{0,40}）\s*$", 30)).withColumn("hint", A.source_hint(F.col("t"), r"（[^（）]{0,80}《[^》]{1,80}》[^（）]{0,40}）\s*$"))
    assert all(r["got"] == r["want"] for r in got.collect())
    assert [r["hint"] for r in got.collect() if r["hint"]] == ["（《书》）"]


def test_code_points(spark):
    forms = ["U+0041", "U+00E9", "U+4E00", "U+20000", "U+10FFFF", "U+110000", "U+D800", "U+FFFD", "U+41", "x", None]
    want = ["A", "é", "一", "\U00020000", "\U0010ffff", None, None, None, None, None, None]
    got = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, f string").select("i", A.code_point(F.col("f")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == want


def test_utf16_offsets(spark):
    text = "a\U00020000b\U0001f600c"
    rows = [(text, len(text[:n].encode("utf-16-le")) // 2, n) for n in range(len(text) + 1)]
    got = spark.createDataFrame(rows, "t string, u int, want int").withColumn("got", A.code_points_before(F.col("t"), F.col("u"))).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_conflict_is_an_error(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("c", "c"), (None, None)], "n string, o string")
    assert [r[0] for r in df.select(A.coalesced(F.col("n"), F.col("o"), F.lit("x"))).collect()] == ["a", "b", "c", None]
    with pytest.raises(Exception, match="fields in conflict"):
        spark.createDataFrame([("a", "b")], "n string, o string").select(A.coalesced(F.col("n"), F.col("o"), F.lit("x"))).collect()


def test_digest_tells_fields_apart(spark):
    rows = [("a", "bc"), ("ab", "c"), (None, "abc"), ("abc", None), ("", "abc"), ("-", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(A.digest({"a": F.col("a"), "b": F.col("b")}).alias("d"))
    assert df.distinct().count() == len(rows)


def test_malformed_payloads(spark):
    rows = [(1, "q", None), (2, "q", ""), (3, "q", "{"), (4, "q", '{"Sentences": null}'), (5, "q", '{"Sentences": [{"References": null}, {"Clause": "", "References": [{"Clause": "x"}, {"Clause": ""}, {}]}, {"Clause": "s", "References": [{"Clause": "y", "Title": "t", "WritingId": 3}]}]}')]
    got = P.references(spark.createDataFrame(rows, "id long, query string, payload string"), "id", "query", "payload").orderBy("text").collect()
    assert [(r["id"], r["anchor"], r["text"], r["title"], r["metadata"]["writing_id"]) for r in got] == [(5, "q", "x", None, None), (5, "s", "y", "t", "3")]


def test_first_elements(spark):
    rows = [(1, "q", '[{"Explains": [], "Quotes": [{"Content": "c", "Book": ""}]}, {"Explains": [{"Explain": "m"}, {"Explain": "n"}]}, {"Quotes": null}]'), (2, "q", "[]"), (3, "q", None)]
    got = P.allusions(spark.createDataFrame(rows, "id long, query string, payload string"), "id", "query", "payload").orderBy("text").collect()
    assert [(r["id"], r["text"], r["title"]) for r in got] == [(1, "meaning: m", None), (1, "quote: c", None)]


def test_unique_names(spark):
    entries = spark.createDataFrame([(1, "a", ["b"]), (2, "b", None), (3, "c", ["c", "d"]), (4, None, [])], "id long, name string, aliases array<string>")
    got = {r["asked"]: r for r in P.unique_name(entries, spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "asked string"), 1).collect()}
    assert {k: (r["status"], r["id"], r["n"]) for k, r in got.items()} == {"a": ("ok", 1, 1), "b": ("candidates", None, 2), "c": ("ok", 3, 1), "x": ("no_hit", None, 0)}
    assert got["b"]["candidates"] == [1]
