"""Components that further links extend, against all links at once."""

import random

from inkwell.llm import graph, near_dup
from tests.llm import helpers as H
from tests.llm.test_near_templates import pages


def frame(spark, links):
    return spark.createDataFrame(links, "a long, b long")


def told(found):
    return {r["v"]: r["component"] for r in found.collect()}


def test_extended_components(spark):
    pick = random.Random(4)
    for n, first, more in ((40, 20, 20), (30, 60, 5)):
        links = [tuple(pick.sample(range(n), 2)) for _ in range(first + more)] + [(100, 101), (101, 102), (5, 102)]
        found = graph.components(frame(spark, links[:first]))
        want = H.components({v for x in links for v in x}, links)
        grown = graph.extended(found, frame(spark, links[first:]))
        assert told(grown) == want
        assert graph.extended(grown, frame(spark, links[:3])) is grown
    chain = graph.components(frame(spark, [(i, i + 1) for i in range(50)]))
    assert told(graph.extended(chain, frame(spark, [(60, 70), (50, 60)]))) == dict.fromkeys([*range(51), 60, 70], 0)


def test_links_are_followed_once(spark, tmp_path, monkeypatch):
    """A group of near copies that the first comparison connects, beside pages of templates that later ones connect."""
    met, plain, calls, confirmed = [], graph.components, [], near_dup.confirmed

    def components(links):
        met.append(links.count())
        return plain(links)

    monkeypatch.setattr(graph, "components", components)
    monkeypatch.setattr(near_dup, "components", components)

    def first_group_only(pairs, reps, full):
        """The first comparison is kept from connecting the pages."""
        calls.append(pairs)
        out = confirmed(pairs, reps, full)
        return out.filter("a >= 5000 AND b >= 5000") if len(calls) == 1 else out

    monkeypatch.setattr(near_dup, "confirmed", first_group_only)
    base = [f"w{i}" for i in range(200)]
    docs = [(5000 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(120)] + pages(150, 70, 0)
    H.write(spark, str(tmp_path), docs, "doc_id long, text string")
    sets = {i: H.shingle_set(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {r["doc_id"]: r["component_id"] for r in near_dup.op5_near_dup(spark, str(tmp_path)).collect()} == H.components(list(sets), links)
    assert len(met) >= 2 and sum(met[1:]) < met[0], met
