"""Composition and containment against plain loops over all places, pieces and pairs."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import compose as C


def _alphabet(rng, n):
    return "".join(rng.choice("abcd 𠀀é") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    pieces = [_alphabet(rng, rng.randint(24, 60)) for _ in range(12)] + ["a" * 24, "a" * 30, "ab" * 12]
    out = [(f"p{i:02}", "x", p) for i, p in enumerate(pieces)]
    for i in range(12):
        parts = [rng.choice(pieces) for _ in range(rng.randint(2, 5))]
        out.append((f"h{i:02}", "x", "".join(parts) if i % 2 else (_alphabet(rng, 5) + "").join(parts)))
    out += [("h90", "x", "a" * 48), ("h91", "x", "a" * 84), ("n1", None, pieces[0] * 2), ("n2", "", pieces[0] * 2), ("n3", "y", pieces[0] * 2), ("e", "x", ""), ("z", "x", None)]
    return out


def _places(rows, host):
    text, author = host[2], host[1]
    return [(i, i + len(p), m) for m, a, p in rows if author and a == author and p and 24 <= len(p) < len(text) for i in range(len(text)) if text.startswith(p, i)]


def _hosts(rows):
    return [r for r in rows if r[1] and r[2] and len(r[2]) >= 48]


@pytest.fixture(scope="module")
def works(spark, rows):
    return spark.createDataFrame(rows, "work_id string, author string, content string")


def test_occurrences(works, rows):
    got = sorted((r["host"], r["pos"], r["end"], r["member"]) for r in C.occurrences(works).collect())
    assert got == sorted((h[0], *x) for h in _hosts(rows) for x in _places(rows, h))


def test_covers(works, rows):
    want = {}
    for h in _hosts(rows):
        before, n = {0: None}, len(h[2])
        for pos, end, member in sorted(_places(rows, h), key=lambda x: (x[0], x[2])):
            if pos in before and end not in before:
                before[end] = (pos, member)
        if n in before:
            chain = []
            while n:
                n, member = before[n]
                chain.append(member)
            if len(chain) > 1:
                want[h[0]] = chain[::-1]
    got: dict = {}
    for r in C.covers(works).orderBy("host", "member_order").collect():
        got.setdefault(r["host"], []).append(r["member"])
    assert got == want and len(want) > 4


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_greedy_cover(works, rows, least):
    want = {}
    for h in _hosts(rows):
        at, out = 0, []
        places = _places(rows, h)
        while at < len(h[2]):
            here = sorted((-end, m) for pos, end, m in places if pos == at)
            if here:
                out.append((here[0][1], at, -here[0][0]))
                at = -here[0][0]
            else:
                at += 1
        if len(out) > 1 and sum(e - p for _, p, e in out) / len(h[2]) >= least:
            want[h[0]] = out
    got: dict = {}
    for r in C.greedy_cover(works, least).orderBy("host", "part").collect():
        got.setdefault(r["host"], []).append((r["member"], r["start"], r["end"]))
    assert got == want and want


def test_normalised_cover(spark):
    a, b = "Abcdefghijklmnopqrstuvwxyz", "Zyxwvutsrqponmlkjihgfedcba"
    df = spark.createDataFrame([("a", "x", a + "!"), ("b", "x", b + "."), ("loose", "x", f"{a}, ({b})"), ("exact", "x", f"{a}!{b}.")], "work_id string, author string, content string")
    assert {r["host"] for r in C.normalised_covers(df).select("host").distinct().collect()} == {"loose"}
    assert C.normalised_covers(df, spark.createDataFrame([("loose",)], "host string")).count() == 0


def test_no_signal_no_cover(spark):
    a, b = "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"
    rows = [("a", "x", a, False), ("b", "x", b, True), ("h", "x", a + b, False), ("g", "x", b + a, True)]
    df = spark.createDataFrame(rows, "work_id string, author string, content string, numbered boolean")
    assert {r["host"] for r in C.greedy_cover(df, 0.8, signal="numbered").collect()} == {"g"}


def test_containing_holds_every_pair(spark):
    rng = random.Random(3)
    items = [(i, "".join(rng.choice("abcdefgh") for _ in range(n))) for i, n in enumerate([48, 60, 45, 30, 24, 80])]
    docs = [(100, None), (101, ""), (102, "abc")]
    for i, t in items:
        for edits in range(4):
            w = list(t)
            for _ in range(edits):
                at = rng.choice([0, 1, len(w) - 1, rng.randrange(len(w))])
                w[at : at + 1] = rng.choice([[], ["z"], [w[at], "z"]]) if len(w) > at else []
            docs.append((i * 10 + edits, _alphabet(rng, 20) + "".join(w) + _alphabet(rng, 20)))
            docs.append((1000 + i * 10 + edits, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    met = C.containing(d, t, "doc_id", "item_id").join(d, "doc_id").join(t.withColumnRenamed("text", "part"), "item_id")
    found = {(r["id"], r["kind"]) for r in C.containment(met.select(F.concat_ws(":", "doc_id", "item_id").alias("id"), "text", "part")).collect() if r["kind"] != "none"}
    every = d.filter("text IS NOT NULL").crossJoin(t.filter("text <> ''").withColumnRenamed("text", "part"))
    want = {(r["id"], r["kind"]) for r in C.containment(every.select(F.concat_ws(":", "doc_id", "item_id").alias("id"), "text", "part")).collect() if r["kind"] != "none"}
    assert found == want and {k for _, k in want} == {"exact", "normalized", "near"}


def test_nothing_to_hold(spark):
    d, t = spark.createDataFrame([(1, "abc")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert C.containing(d, t, "doc_id", "item_id").count() == 0


def test_equal_works_do_not_multiply(spark):
    """Thirty hosts of one text over thirty copies of each piece: each place is found once a host, and edges are still told right."""
    a, b = "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba" * 20
    rows = [(f"{p}{i:02}", "x", t) for i in range(30) for p, t in (("a", a), ("b", b), ("h", a + b + a))]
    df = spark.createDataFrame(rows, "work_id string, author string, content string")
    found = C.occurrences(df, once=True).filter("host LIKE 'h%'").collect()
    assert sorted({(r["pos"], r["end"], r["member"]) for r in found if r["end"] != len(a + b)} | {(26, 546, "b00")}) == [(0, 26, "a00"), (26, 546, "b00"), (546, 572, "a00")] and len(found) == 90
    edges = C.covers(df).select(F.col("host").alias("parent_work_id"), F.col("member").alias("member_work_id"), "member_order")
    told = C.validated_edges(edges, df).collect()
    assert len(told) == 90 and all(r["valid"] for r in told)
    wrong = spark.createDataFrame([("h00", "a00", 0), ("h00", "a00", 1), ("h00", None, 2), ("none", "a00", 0)], "parent_work_id string, member_work_id string, member_order int")
    assert [(r["start"], r["end"], r["valid"]) for r in C.validated_edges(wrong, df).orderBy("parent_work_id", "member_order").collect()] == [(0, 26, False), (26, 52, False), (None, 52, False), (0, 26, False)]



def test_normalised_cover_of_equal_works(spark):
    """Copies of works and hosts in other punctuation: every host is told, with two parts of one member each."""
    a, b = "Abcdefghijklmnopqrstuvwxyz", "Zyxwvutsrqponmlkjihgfedcba"
    rows = [(f"{p}{i}", "x", t) for i in range(5) for p, t in (("a", a + "!"), ("b", b + "." * i), ("h", f"{a}, ({b})"))]
    df = spark.createDataFrame(rows, "work_id string, author string, content string")
    got = C.normalised_covers(df).orderBy("host", "member_order").collect()
    assert [(r["host"], r["member"], r["start"], r["end"]) for r in got] == [x for i in range(5) for x in ((f"h{i}", "a0", 0, 26), (f"h{i}", "b0", 26, 52))]
    assert not C.occurrences(C.normalised(df), once=True).filter("member NOT IN ('a0', 'b0', 'h0')").count()



def test_coverage_rounds_halves_up(spark):
    """759 of 800 characters are 0.94875, which SQL rounds to 0.9488."""
    a, b = "abcdefghijklmnopqrstuvwxyz" * 10, "0123456789" * 49 + "012345678"
    df = spark.createDataFrame([("a", "x", a), ("b", "x", b), ("h", "x", a + "-" * 41 + b)], "work_id string, author string, content string")
    assert [(r["start"], r["end"], r["coverage"]) for r in C.greedy_cover(df).orderBy("part").collect()] == [(0, 260, 0.9488), (301, 800, 0.9488)]
