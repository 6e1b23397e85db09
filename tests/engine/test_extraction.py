"""Coverage, audit and batches against loops."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import extraction


def test_coverage_precedence(spark):
    r, rows, evidence, want = random.Random(3), [], [], []
    for page in range(8):
        region = section = False
        for i in range(40):
            tag, text = r.choice(["h1", "h2", "p", "p", "p"]), r.choice(["editor", "dated", "plain", None])
            rows.append((page, i, tag, text))
            there = r.random() < 0.3
            if there:
                evidence += [(page, i)] * 2
            if tag == "h1":
                region, section = text == "editor", False
            if tag == "h2":
                section = text == "editor"
            rules = [(tag == "p" and text == "dated", "internal_not_exported"), (there, "handled"), (tag == "h1", "structural_heading"), (region, "editorial_region"), (section, "editorial_section")]
            want.append((page, i, next((s for ok, s in rules if ok), "untracked")))
    got = extraction.coverage(spark.createDataFrame(rows, "p int, ordinal int, tag string, text string"), spark.createDataFrame(evidence, "p int, ordinal int"), "p", (F.col("tag") == "p") & (F.col("text") == "dated"), F.col("text") == "editor", F.col("text") == "editor")
    assert sorted(map(tuple, got.collect())) == want


def test_audit(spark):
    roles = [(1, 0, 1, "work_start"), (1, 1, 1, "text"), (1, 2, 2, "work_start"), (1, 3, 2, "other"), (1, 4, 2, "other"), (2, 0, 0, "other")]
    roles = spark.createDataFrame(roles, "p int, ordinal int, work int, role string")
    warnings = spark.createDataFrame([(1, "gap"), (1, "gap"), (1, "note"), (2, "gap"), (9, "gap")], "p int, warning string")
    pages = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, None), (5, "b")], "p int, collection string")
    got = {r[0]: tuple(r)[1:] for r in extraction.audit(roles, warnings, pages, "p").collect()}
    assert got == {"a": (3, 2, 1, 2, 3, 1, {"gap": 3, "note": 1}), None: (1, 0, 0, 1, 0, 0, {}), "b": (1, 0, 0, 1, 0, 0, {})}


def _batch(pools, kinds, turn, limit):
    out, books, seen = [], set(), set()
    for kind in kinds:
        pool = sorted(pools.get(kind, []))
        if len(out) == limit or not pool:
            continue
        at = (turn - 1) * 7 % len(pool)
        left = [c for c in pool[at:] + pool[:at] if c[:2] not in seen]
        if left:
            pick = next((c for c in left if c[2] not in books), left[0])
            out.append((kind, *pick))
            books.add(pick[2])
            seen.add(pick[:2])
    return out


def test_rotated_sample(spark):
    r = random.Random(9)
    pools = {k: list({(r.randrange(6), r.randrange(5)): 0 for _ in range(12)}) for k in "abcd"}
    pools = {k: [(p, i, f"b{p % 3}") for p, i in v] for k, v in pools.items()} | {"e": [(0, 0, "b0")]}
    rows = spark.createDataFrame([(k, b, p, i) for k, v in pools.items() for p, i, b in v], "kind string, book string, page int, place int")
    for turn, limit in ((1, 9), (2, 3), (5, 9)):
        got = extraction.rotated_sample(rows, ["e", "d", "none", "a", "b", "c", "e"], turn, limit)
        assert [(c["kind"], c["page"], c["place"], c["book"]) for c in got] == _batch(pools, ["e", "d", "none", "a", "b", "c", "e"], turn, limit)
        assert [c["case_id"] for c in got] == [f"R{turn:02d}-{i + 1:02d}" for i in range(len(got))]
    with pytest.raises(ValueError):
        extraction.rotated_sample(rows, ["a"], 0, 5)
