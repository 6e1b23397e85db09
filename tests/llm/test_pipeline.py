"""The pipeline against plain versions of its stages, on odd rows."""

import hashlib
import math
import zlib
from collections import Counter

import pytest

from inkwell.llm import langid, mixing
from tests.llm import helpers as H
from tests.llm.test_operators import brute_windows, water_filled

P = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_decide(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    names = docs.columns
    kept = docs
    seen = {}
    for name, stage in P.STAGES:
        kept = P.written(stage(spark, kept, odd))
        seen[name] = kept
        if name != "sharded":
            assert kept.columns == names
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    assert not ids(seen["language"]) & {4, 5, 6, 9} and {1, 2, 12, 13, 14} <= ids(seen["language"])
    assert not ids(seen["near_duplicates"]) & {2, 3, 11, 18} and {1, 10, 12, None} <= ids(seen["near_duplicates"])
    assert not ids(seen["contaminated"]) & {1, 7, 10, 12}
    assert ids(seen["mixed"]) <= ids(seen["contaminated"])
    assert seen["sharded"].count() == seen["mixed"].count()


def without_copies(docs):
    """Of each group of near copies the smallest id stays; rows without an id stay."""
    sets = {}
    for i, t, _ in docs:
        if i is not None:
            sets.setdefault(i, H.shingle_set(t))
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = H.components(list(sets), links)
    return [d for d in docs if d[0] is None or comp[d[0]] == d[0]]


def times_taken(docs):
    """How often the mix takes each id: golden-ratio slots of one word each, word by word."""
    rows = sorted((("1" if s is None else "0" + s), hashlib.md5(str("" if i is None else i).encode()).hexdigest(), i is not None, i or 0, len(H.spaced(t)), i) for i, t, s in docs)
    sizes = Counter()
    for key, *_, size, _ in rows:
        sizes[key] += size
    goal = water_filled(dict(sizes))
    keys, low, before = [k for k in sorted(sizes) if sizes[k]], [], 0.0
    for k in keys:
        low.append(before / sum(goal.values()))
        before += goal[k]
    rank, often = Counter(), Counter()
    for n in range(sum(sizes.values())):
        x = n * mixing.PHI - math.floor(n * mixing.PHI)
        k = keys[max(j for j, lo in enumerate(low) if lo <= x)]
        if rank[k] < 3 * sizes[k]:
            often[k, rank[k] % sizes[k]] += 1
        rank[k] += 1
    place, out = Counter(), {}
    for key, _, _, _, size, i in rows:
        taken = sum(often[key, place[key] + w] for w in range(size))
        place[key] += size
        out[i] = max(out.get(i, 0), math.floor(taken / size + 0.5) if size else 0)
    return out


def test_run_against_plain_stages(spark, odd):
    """All rows of run() by id, size and CRC; ties (equal texts), repeated ids, nulls, empty and very long texts among them."""
    table = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text", "lang", "source")
    judged = langid.predict(table, langid.train(table), ["doc_id", "text", "source"]).collect()  # held against plain loops in test_operators
    docs = [(r["doc_id"], r["text"], r["source"]) for r in judged if r["lang_pred"] != "und" and r["score"] >= P.MIN_LANGUAGE]
    assert len(docs) > 8
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect()]
    grams = {g for _, t in bench if t for g in H.shingle_set(t, 3)}
    # texts of thousands of words that share no three words with an item hold no window of it
    clean = [d for d in without_copies(docs) if not brute_windows(bench, d[1] if H.shingle_set(d[1], 3) & grams or len(d[1]) < 5000 else d[1][:5000])[-1]]
    often = times_taken(clean)
    want = Counter()
    for i, t, _ in clean:
        raw = t.encode()
        want[i, len(raw) + 8, zlib.crc32(raw)] += often[i]
    out = P.run(spark, odd).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == +want and sum(want.values()) > 3
    places = {}
    for r in out:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(0 <= s < P.SHARDS and sorted(p) == list(range(len(p))) for s, p in places.items())


def test_run_of_nothing(spark, empty):
    assert P.run(spark, empty).count() == 0
