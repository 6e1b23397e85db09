"""Near duplicates among pages of one template: right components, and pairs that do not grow with the square of the pages."""

import numpy as np
import pytest

from inkwell.llm import near_dup
from tests.llm import helpers as H


def pages(many, own, parts, seed=5):
    """Texts of one template with `own` words of each page in it; every page twice, the second time with an edit; every third page has a part that others share."""
    r = np.random.default_rng(seed)
    template = [f"t{i}" for i in range(330)]
    out = []
    for p in range(many):
        w = template[:200] + [f"p{p}x{i}" for i in range(own)] + template[200:]
        if parts and p % 3 == 0:
            w += [f"s{p % parts}y{i}" for i in range(25 + p % 7)]
        if parts and p % 5 == 0:
            w = w[: 330 - p % 40]
        out.append(w)
        copy = list(w)
        for _ in range(1 + p % 3 if parts else 1):
            copy[r.integers(len(copy))] = f"e{r.integers(10**9)}"
        out.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def counted(monkeypatch):
    met, plain = [], near_dup.confirmed

    def confirmed(pairs, reps, full):
        met.append(pairs.count())
        return plain(pairs, reps, full)

    monkeypatch.setattr(near_dup, "confirmed", confirmed)
    return met


def test_template_pairs_stay_few(spark, tmp_path, monkeypatch):
    met = counted(monkeypatch)
    docs = pages(150, 70, 0)
    H.write(spark, str(tmp_path), docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.op5_near_dup(spark, str(tmp_path)).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}
    # the pairs with the centres are the first; 300 pages have 44,850 pairs
    assert len(met) == 4 and sum(met[1:]) < 1500, met


@pytest.mark.parametrize("few", [0, 16])
def test_templates_of_templates(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(near_dup, "FEW", few)
    docs = pages(90, 66, 12) + [(1000 + i, t) for i, (_, t) in enumerate(pages(60, 80, 9, 7))]
    H.write(spark, str(tmp_path), docs, "doc_id long, text string")
    sets = {i: H.shingle_set(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {r["doc_id"]: r["component_id"] for r in near_dup.op5_near_dup(spark, str(tmp_path)).collect()} == H.components(list(sets), links)
