"""Templates of markup against plain loops."""

import json
from collections import Counter, defaultdict

import pytest

from inkwell.operators import templates


@pytest.fixture(scope="module")
def rows():
    tags = ["p", "h1", "h2", "p", "li", "p", "h3", "p"]
    out = []
    for page in range(9):
        for i in range(3 + page % 6):
            tag = tags[(page + i * 3) % len(tags)]
            out.append((page, i, tag, ["b", "a"] if (page + i) % 3 == 0 else [], "x" if i == 2 else None, ("Note " if (page * i) % 4 == 1 else "text ") + str(i)))
    return [*out, (20, 0, "td", [], None, "alone")]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, ordinal int, tag string, classes array<string>, anchor string, text string").repartition(3)


def test_catalogue(spark, rows):
    pages, want, seen = defaultdict(list), defaultdict(Counter), defaultdict(set)
    for r in rows:
        pages[r[0]].append(r)
    for page, blocks in pages.items():
        for i, (_, _, tag, classes, anchor, _) in enumerate(blocks):
            name = json.dumps({"tag": tag, "classes": sorted(classes), "anchored": anchor is not None}, separators=(",", ":"))
            c, head = want[name], [b[2][0] == "h" for b in blocks]
            c["n"] += 1
            c["leading"] += all(b[2] != "h2" for b in blocks[: i + 1])
            c["after_heading"] += i > 0 and head[i - 1]
            c["before_heading"] += i + 1 < len(blocks) and head[i + 1]
            seen[name].add((page, i))
    got = {r["template"]: r for r in templates.catalogue(_frame(spark, rows), "page_id", 3).collect()}
    assert set(got) == set(want)
    for name, r in got.items():
        assert {k: r[k] for k in ("n", "leading", "after_heading", "before_heading")} == {k: want[name][k] for k in ("n", "leading", "after_heading", "before_heading")}
        assert r["pages"] == len({p for p, _ in seen[name]})
        sample = [(s["page"], s["ordinal"]) for s in r["samples"]]
        assert set(sample) <= seen[name] and len(sample) == min(3, len(seen[name])) and sample == sorted(sample)
    some = {r["template"] for r in templates.kept(templates.catalogue(_frame(spark, rows), "page_id"), 2, 1).collect()}
    order = sorted(want, key=lambda k: (-want[k]["n"], k))
    assert some == set(order[:2]) | {k for k in want if want[k]["n"] == 1}


def test_transitions(spark, rows):
    want = {}
    for a, b in zip(rows, rows[1:]):
        if a[0] == b[0] and a[2] == b[2] == "p" and a[5].startswith("Note") and not b[5].startswith("Note"):
            want.setdefault(a[0], (a[1], b[5]))
    made = rows + [(30, 0, "p", [], None, "Note a"), (30, 1, "p", [], None, "b"), (30, 2, "p", [], None, "Note c"), (30, 3, "p", [], None, "d"), (31, 0, "p", [], None, "Note"), (31, 1, "h1", [], None, "b")]
    want[30] = (0, "b")
    got = {r["page_id"]: (r["ordinal"], r["next_text"]) for r in templates.transitions(_frame(spark, made), "page_id", "^Note").collect()}
    assert got == want


def test_empty(spark):
    e = spark.createDataFrame([], "page_id long, ordinal int, tag string, classes array<string>, anchor string, text string")
    assert templates.kept(templates.catalogue(e, "page_id")).count() == 0 and templates.transitions(e, "page_id", "x").count() == 0
