"""The audit against a plain loop over all orders, with and without colliding hashes."""

import re
from collections import Counter
from itertools import permutations

import pytest

from inkwell.llm import filter_audit as A
from tests.llm import helpers as H

LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 1, 0), (10, 1, None), (None, 1, 1), (999, 1, 1), (12, None, 1), (15, 1, 0)]


def plain(docs, labels):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *f in labels if i is not None and f[k] == 1} for k in (0, 1))
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        rows.append((lang or "", {c for c, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in toxic))
    out, shap = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                now = [r for r in left if c in r[1]]
                gone = {id(r) for r in mine} - {id(r) for r in left}
                left = [r for r in left if c not in r[1]]
                shap[part, c] += len(now)
                out[part, "".join(order), step] = [len(left), len(now), sum(id(r) in gone and c in r[1] for r in mine), sum(r[1] == {c} for r in mine), sum(r[2] for r in now), sum(r[3] for r in now)]
    return {k: (*v, shap[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def fixture():
    base = " ".join(f"w{i}" for i in range(150))
    rows = [*H.odd_rows()]
    more = [(30, base, "en"), (31, base, None), (32, base[:-1] + "x", "en"), (33, base + " #", "fr"), (34, "THE CAT " * 90, "fr"), (35, base * 40, "en"), (36, base * 40, "en"), (36, base * 40, "en"), (37, base * 39 + base[:-1] + "y", "en"), (38, None, ""), (39, "", None), (None, base, "en"), (None, None, "en"), (0, base + " é", "en"), (40, base + " è", "en")]
    return rows + [(*r, None, "x", 1, "y", 2.0, "z") for r in more]


@pytest.mark.parametrize(("first", "bits"), [(256, 64), (4, 64), (256, 2), (8, 1)])
def test_against_a_loop(spark, first, bits):
    docs = spark.createDataFrame(fixture(), H.SCHEMA)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, mask string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in A.audit(docs, labels, first, bits).collect()}
    assert got == plain(fixture(), LABELS)


def test_empty(spark):
    docs, labels = spark.createDataFrame([], H.SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).count() == 0
    one = A.audit(spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], H.SCHEMA), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""}


def test_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(A, "HOT", 20)
    docs = [(i, "same text " * 60 if i % 3 else f"text {i % 7} " * 70, "en") for i in range(300)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2, i % 5 == 0) for i in range(300)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) AS toxic")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in A.audit(rows, labels).collect()}
    assert got == plain(docs, [(i, i % 2, int(i % 5 == 0)) for i in range(300)])
