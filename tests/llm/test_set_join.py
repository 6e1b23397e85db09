"""The set join against all pairs, on odd rows and on groups whose lists, stars and bounds are all met."""

import random

import pytest

from inkwell.llm import set_join as S
from tests.llm import helpers as H


def plain(docs):
    """{(doc_id, n, component)} as a list, by all pairs; rows of one id are one vertex, null ids are none."""
    s = [H.shingle_set(t, 4) for _, t in docs]
    links, ids = [], [i for i, _ in docs]
    for a in range(len(docs)):
        for b in range(a):
            if s[a] and s[b] and ids[a] is not None and ids[b] is not None and 85 * len(s[a]) <= 100 * len(s[b]) and 85 * len(s[b]) <= 100 * len(s[a]):
                i = len(s[a] & s[b])
                if 100 * i >= 85 * (len(s[a]) + len(s[b]) - i):
                    links.append((ids[a], ids[b]))
    of = H.components({i for i in ids if i is not None}, links)
    return sorted(((i, len(x), of.get(i)) for i, x in zip(ids, s, strict=True)), key=str)


def run(spark, docs, parts=3):
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, c string, n int").repartition(parts)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in S.link(df).collect()), key=str)


def test_odd_rows(spark, odd):
    docs = [(r[0], r[1]) for r in H.odd_rows()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in S.op12_set_join(spark, odd).collect()), key=str)
    assert got == plain(docs)


def groups(seed):
    """Chains of edits, two stars near the threshold of each other, a passage in many texts, templates, one-word changes."""
    pick = random.Random(seed)
    word = lambda k=4000: f"w{pick.randrange(k)}"
    docs = []

    def edited(text, k):
        out = list(text)
        for _ in range(k):
            out[pick.randrange(len(out))] = word(10**6)
        return out

    for _ in range(4):
        text = [word() for _ in range(pick.randrange(60, 200))]
        for _ in range(12):  # a chain
            docs.append(text)
            text = edited(text, pick.randrange(0, 4))
    base = [word() for _ in range(200)]
    for k in (0, 3, 4, 5, 6):  # centres that are nearly similar, with members around them
        centre = edited(base, k)
        docs += [edited(centre, pick.randrange(0, 5)) for _ in range(10)]
    passage = [word() for _ in range(60)]
    docs += [[word() for _ in range(pick.randrange(1, 80))] + passage + [word() for _ in range(pick.randrange(1, 20))] for _ in range(40)]
    docs += [passage[: pick.randrange(1, 60)] for _ in range(20)]
    template = [word() for _ in range(150)]
    docs += [template + [word(10**6) for _ in range(pick.randrange(0, 30))] for _ in range(40)]
    out = [(i, " ".join(t)) for i, t in enumerate(docs)]
    return out + [(i + 1000, t) for i, t in out[:20]] + [(5, "another text under the same id as before and so one vertex"), (7, docs and " ".join(docs[30])), (None, out[0][1])]


@pytest.mark.parametrize(("seed", "least", "block", "broadcast"), [(1, 256, 512, 10**6), (2, 4, 512, 0), (3, 8, 3, 10**6)])
def test_against_all_pairs(spark, monkeypatch, seed, least, block, broadcast):
    for name, value in (("LEAST", least), ("BLOCK", block), ("DEALT", block), ("MAX_BROADCAST", broadcast)):
        monkeypatch.setattr(S, name, value)
    docs = groups(seed)
    assert run(spark, docs) == plain(docs)


def test_prefix():
    import numpy as np

    for n in range(1, 300):
        least = -(-85 * n // 100)  # what a linked set shares at least
        assert int(S.prefix(np.array([n]))[0]) == n - least + 1
