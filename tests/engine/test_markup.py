"""Roles of blocks, transclusion, the lexicon and the edit distance, against plain loops."""

import random
import re

from inkwell.functions.edits import substring_edits
from inkwell.operators import lexicon
from inkwell.operators.roles import Rules, block_roles
from inkwell.operators.transclude import expanded
from inkwell.sources.markup import read

RULES = Rules(
    zones=(("doubtful", "doubtful"), ("more", "supplement")), skipped_part="guide", skipped_work="list of", inserted_tags=frozenset({"h4"}), inserted_classes=frozenset({"ins"}), insert_marker=r"\[added\]", signature_classes=frozenset({"right"}),
    signature="[A-Z][a-z]{1,9}", dated=r"year \d+", notes=(("o ", "annotations"), ("# ", "commentaries")), title_classes=frozenset({"sub"}), preface_classes=frozenset({"pre"}), reference_classes=frozenset({"ref"}), caption_classes=frozenset({"cap"}),
    break_classes=frozenset({"break"}), separator_classes=frozenset({"mid"}), gap=r"\[\?\]",
)


def roles(spark, *pages, parts=2):
    rows = [(k, i, tag, c.split(), text, style) for k, page in enumerate(pages) for i, (tag, c, text, style) in enumerate((*b, "")[:4] for b in page)]
    df = spark.createDataFrame(rows, "page_id int, ordinal int, tag string, classes array<string>, text string, style string").repartition(parts)
    told, warned = block_roles(df, RULES)
    out = {(r["page_id"], r["ordinal"]): r for r in told.collect()}
    return [[out[k, i]["role"] for i in range(len(p))] for k, p in enumerate(pages)], sorted((r["page_id"], r["ordinal"], r["warning"], r["start"], r["end"]) for r in warned.collect()), out


def test_roles_of_a_book(spark):
    page = [
        ("p", "", "before"), ("h1", "", "guide"), ("h2", "", "skipped here"), ("p", "", "x"), ("h1", "", "doubtful works"), ("h2", "", "First"), ("p", "sub", "a title"), ("p", "sub", "another"), ("p", "pre", "preface"), ("p", "", "line [?] one [?]"),
        ("p", "mid", ""), ("p", "", ""), ("p", "ref", "ref"), ("p", "n", "o note"), ("p", "n", "goes on"), ("p", "cap", "figure"), ("p", "n", "after the figure"), ("p", "m", "# other"), ("p", "n", "not the same"), ("p", "m", "too late"),
        ("p", "", "year 12"), ("h2", "", "list of works"), ("p", "", "in the list"), ("h2", "", "Second"), ("p", "", "text"), ("p", "break", "page"), ("p", "", "[added]"), ("h4", "ins", "Inserted"), ("p", "", "to a friend"), ("p", "right", "Anna"), ("p", "", "lines"),
        ("h4", "ins", "Unsigned"), ("p", "", "lines"), ("p", "", "[added]"), ("h2", "", "Third"), ("li", "", "item"),
    ]
    got, warned, rows = roles(spark, page, [("p", "", "o nothing before")], page)
    want = ["outside", "part", "skipped_heading", "outside", "part", "work_start", "title", "title", "preface", "text", "separator", "layout", "unknown", "annotations", "annotations_continued", "caption", "unknown", "commentaries", "unknown", "unknown",
            "date_of_next", "skipped_heading", "outside", "work_start", "text", "layout", "insert_marker", "work_start", "preface", "signature", "text", "work_start", "text", "insert_marker", "work_start", "other"]
    assert got == [want, ["outside"], want]
    mine = [w[1:] for w in warned if w[0] == 0]
    assert mine == ([(7, "second_title", None, None), (9, "gap", 5, 8), (9, "gap", 13, 16), (12, "reference_after_text", None, None), (14, "continued_note", None, None), (16, "text_after_notes", None, None), (18, "text_after_notes", None, None), (19, "text_after_notes", None, None), (27, "inserted_work", None, None), (31, "inserted_work", None, None), (31, "missing_signature", None, None), (31, "orphan_marker", None, None)])
    assert [w[1:] for w in warned if w[0] == 2] == mine and not [w for w in warned if w[0] == 1]
    assert rows[0, 9]["zone"] == "doubtful" and rows[0, 24]["date"] == "year 12" and rows[0, 5]["date"] is None and rows[1, 0]["zone"] is None
    assert [rows[0, i]["work"] for i in (0, 2, 5, 20, 22, 24, 30, 32, 35)] == [0, 0, 1, 1, 0, 2, 3, 4, 5]


def test_roles_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        page = [("h2", "", "A"), ("p", "", "text"), *[("p", "n", "o note")] * 5, ("p", "n", "on"), ("p", "n", "and on")]
        got, _, _ = roles(spark, page, page, page, parts=1)
        assert got == [["work_start", "text", *["annotations"] * 5, "annotations_continued", "annotations_continued"]] * 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_blocks(spark):
    df = spark.createDataFrame([], "page_id int, ordinal int, tag string, classes array<string>, text string, style string")
    assert [x.count() for x in block_roles(df, RULES)] == [0, 0]
    df = spark.createDataFrame([(None, 0, "h2", None, None, None), (None, 1, "p", None, None, None)], df.schema)
    assert sorted(r["role"] for r in block_roles(df, RULES)[0].collect()) == ["layout", "work_start"]


def test_blank_blocks_and_style():
    html = '<h1>A</h1><p style="x:1"> </p><p>b</p>'
    assert [b["text"] for b in read(html)] == ["A", "b"] and [(b["text"], b["style"]) for b in read(html, True)] == [("A", ""), ("", "x:1"), ("b", "")]


def render(pages, title, seen):
    """Depth first, each title once."""
    if title in seen or title not in pages:
        return "", False
    seen.add(title)
    whole, out, at = True, "", 0
    text = pages[title] or ""
    for m in re.finditer(r"\{\{:([^{}|]+)\}\}", text):
        part, ok = render(pages, m.group(1).strip(), seen)
        out, at, whole = out + text[at : m.start()] + "\n\n" + part + "\n\n", m.end(), whole and ok
    return out + text[at:], whole


def test_transclusion(spark):
    pages = {"a": "x {{:b}} y {{: c }} z", "b": "B{{:c}}", "c": "C", "loop": "l{{:loop}}m", "p": "{{:q}}", "q": "{{:p}}", "gap": "g{{:none}}", "up": "{{:gap}}{{:c}}", "twice": "{{:c}}{{:c}}", "null": None, "empty": "", "odd": "{{b}} {{:}} {{:a|b}}"}
    pick = random.Random(4)
    pages |= {f"n{i}": " ".join(f"t{i}{{{{:n{pick.randrange(14)}}}}}" for _ in range(pick.randrange(4))) for i in range(12)}
    got = {r["title"]: (r["text"], r["complete"]) for r in expanded(spark.createDataFrame(list(pages.items()), "title string, text string")).collect()}
    assert got == {t: render(pages, t, set()) for t in pages}
    some = expanded(spark.createDataFrame(list(pages.items()), "title string, text string"), roots=spark.createDataFrame([("a",), ("none",)], "title string")).collect()
    assert [(r["title"], r["complete"]) for r in some] == [("a", False)]


def least(text, pattern):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_edits():
    pick = random.Random(2)
    for letters in ("ab", "abcdefgh", "詞曲é𝄞x"):
        texts, patterns = [], []
        for _ in range(60):
            t = "".join(pick.choice(letters) for _ in range(pick.choice([0, 1, 5, 80, 200])))
            p = list(t[(a := pick.randrange(len(t) + 1)) : a + pick.choice([0, 3, 63, 64, 65, 128, 150])])
            for _ in range(pick.randrange(6)):
                p.insert(pick.randrange(len(p) + 1), pick.choice(letters))
                del p[pick.randrange(len(p))]
            texts.append(t)
            patterns.append("".join(p) or pick.choice(["", "zz"]))
        assert substring_edits(texts, patterns) == [least(t, p) for t, p in zip(texts, patterns, strict=True)]
    assert substring_edits([], []) == []


def test_lexicon(spark):
    entries = [(1, "alpha", ["alef", "a"], "alpha the first"), (2, "beta", None, "beta after alpha"), (3, "alphabet", [], "詞曲 and letters"), (4, None, ["beta"], None), (5, "a", ["a", None], "%_ signs"), (6, "dup", ["dup"], "")]
    terms = ["alpha", "a", "beta", "lph", "詞", "詞曲", "zzz", "", None, "%_", "et", "alpha", "first", "e aft", "dup", "afters"]
    df = spark.createDataFrame(entries, "id int, headword string, variants array<string>, text string")
    got = {}
    for r in lexicon.lookup(spark.createDataFrame([(t,) for t in terms], "term string"), df, lexicon.grams(df), 2).collect():
        got.setdefault(r["term"], []).append((r["tier"], r["rank"], r["id"]))
    want = {}
    for t in {t for t in terms if t}:
        hits = [i for i, h, v, _ in entries if t == h or t in (v or [])]
        tier = 0 if hits else 1
        hits = hits or [i for i, _, _, x in entries if x is not None and t in x]
        if hits:
            want[t] = [(tier, k, i) for k, i in enumerate(sorted(hits)[:2], 1)]
    assert {t: sorted(v) for t, v in got.items()} == want


def test_cut_off_references_are_text():
    page = "<h1>and &amp; more &am</h1><p>and&&&amp</p><p>&ampx; &copy= &#65 &#65; &#x41; &quot;&middot;&amp;lt;</p><p class='a&copy=1'>&&lt;"
    got = read(page)
    assert [b["text"] for b in got] == ["and & more &am", "and&&&amp", '&ampx; &copy= &#65 A A "·&lt;', "&<"] and got[3]["classes"] == ["a&copy=1"]


def test_counts_of_blocks_with_cut_off_references(spark, tmp_path):
    import duckdb

    from inkwell.plans import compose_queries as Q

    pages = [(1, "<h1>and &amp</h1><p>&&&amp; &co</p>"), (2, "<p>&lt;b&gt;</p><p>&quot</p>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in Q.html_blocks(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(Q.HTML_BLOCKS).fetchall()) == [(1, 2, 1, 1, 15), (2, 2, 2, 0, 8)]
