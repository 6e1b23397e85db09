"""Lines of one template that stay apart: right classes, and pairs that grow with the lines and not with their square."""

import numpy as np
import pytest

from inkwell.llm import line_dedup
from tests.llm import helpers as H
from tests.llm.test_operators import edits


def verified_pairs(monkeypatch):
    seen, plain = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda own, first, pairs: seen.append(pairs.count()) or plain(own, first, pairs))
    return seen


def removed(spark, lines):
    out = line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    return {r["doc_id"] for r in out.filter("n_removed > 0").collect()}


def test_numbers_in_a_template(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 64)
    seen = verified_pairs(monkeypatch)
    pick = np.random.default_rng(3)
    many = []
    for n in (1_000, 4_000):
        seen.clear()
        numbers = [f"{x:09}" for x in pick.integers(0, 10**9, n)]
        got = removed(spark, [f"the order number {x} was shipped to the customer on the next day" for x in numbers])
        by: dict[str, list[int]] = {}
        for i, x in enumerate(numbers):
            for p in range(0, 9):  # numbers within two edits share three digits or more at like places
                for q in range(-2, 3):
                    by.setdefault((p + q, x[p : p + 3]), []).append(i)
        links = {(min(a, b), max(a, b)) for own in by.values() for k, a in enumerate(own) for b in own[:k] if a != b and len(set(numbers[a]) ^ set(numbers[b])) <= 4}
        links = [(a, b) for a, b in links if edits(numbers[a].encode(), numbers[b].encode()) <= 2]
        comp = H.components(range(n), links)
        assert got == {i for i in range(n) if comp[i] != i}
        many.append(sum(seen))
    assert many[1] < 6 * many[0] and many[1] < 40 * 4_000, many


@pytest.mark.parametrize("few,centres", [(4, 1), (12, 3)])
def test_short_rests(spark, monkeypatch, few, centres):
    """Large buckets down to rests of a byte or two: lines over two letters, and their edits, against all pairs."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "CENTRES", centres)
    pick = np.random.default_rng(few)
    lines = ["the same start " + "".join(pick.choice(list("abcdefgh"), int(pick.integers(3, 8)))) + " and end" * int(pick.integers(0, 2)) for _ in range(120)]
    lines += ["".join(pick.choice(list("ab"), int(pick.integers(10, 24)))) for _ in range(60)]
    near = lambda x, y: abs(len(x) - len(y)) <= 2 and edits(x.encode(), y.encode()) <= min(2, min(len(x), len(y)) // 10)
    comp = H.components(lines, [(x, y) for k, x in enumerate(lines) for y in lines[:k] if near(x, y)])
    first: dict = {}
    for i, t in enumerate(lines):
        first.setdefault(comp[t], i)
    assert removed(spark, lines) == {i for i, t in enumerate(lines) if first[comp[t]] != i}
