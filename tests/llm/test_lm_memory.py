"""What the arrays of a chunk take at their peak, and the sums by runs of rows."""

import tracemalloc

import numpy as np

from inkwell.llm import kernels as K
from inkwell.llm import lm_score


def chunk(rows=400, words=2_000, seed=3):
    r = np.random.default_rng(seed)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 200_000, words)).encode() for _ in range(rows)]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_arrays_of_a_chunk_stay_small():
    buf, offs = chunk()
    lm_score.Grams(buf[: offs[1]], offs[:2])
    tracemalloc.start()
    try:
        grams = lm_score.Grams(buf, offs)
        _, counted = tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        out = lm_score._scores(10**6, 10**5, 1e6)
        scored = out.__closure__[[c for c in out.__code__.co_freevars].index("scored")].cell_contents
        held = tracemalloc.get_traced_memory()[0]
        values = scored(grams, np.ones(len(grams.words), K.U64), np.ones(len(grams.ones), K.U64), np.ones(len(grams.pairs), K.U64))
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    n = grams.at[-1]
    # before: 104 and 79 bytes a token
    assert counted < 60 * n and peak - held < 60 * n, (counted / n, (peak - held) / n)
    assert len(values) == 4 and all(len(v) == 400 for v in values)


def test_distinct_and_runs():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        key = r.integers(0, 300, n).astype(K.U64)
        every, back = lm_score._distinct(key)
        assert np.array_equal(every, np.unique(key)) and np.array_equal(every[back], key)
    for sizes in ([1], [5, 1, 1], [lm_score.TOKENS] * 3, [3 * lm_score.TOKENS, 1, 1, lm_score.TOKENS], r.integers(1, 90_000, 50).tolist()):
        at = np.cumsum([0, *sizes])
        runs = lm_score._runs(at)
        assert [a for a, _ in runs] == [0, *[b for _, b in runs[:-1]]] and runs[-1][1] == len(sizes)
        assert all(at[b] - at[a] <= 2 * lm_score.TOKENS or b == a + 1 for a, b in runs)
