"""Least edits between a pattern and any substring of a text, bit-parallel and for many pairs side by side.

The column of the edit table is held as its vertical differences, 64 rows to a word; words of a long pattern pass the
horizontal difference at their last row on. One numpy step advances all pairs of a group by one character.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
ONE, TOP = U(1), U(63)
#: Pairs that are advanced together, and cells of their tables of characters.
GROUP, CELLS = 512, 1 << 22


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def substring_edits(texts: list[str], patterns: list[str]) -> list[int]:
    """For each pair the least number of characters replaced, added or left out that turns the pattern into a substring of the text."""
    out = [0] * len(texts)
    words = [(len(p) + 63) // 64 for p in patterns]
    # Pairs of as many words and about as long texts go together.
    order = sorted((i for i in range(len(texts)) if patterns[i]), key=lambda i: (words[i], len(texts[i])))
    group: list[int] = []
    letters: set[str] = set()
    for i in order:
        more = letters | set(patterns[i])
        full = len(group) == GROUP or (len(group) + 1) * (len(more) + 1) * words[i] > CELLS
        far = group and (words[i] != words[group[0]] or len(texts[i]) > 2 * len(texts[group[0]]) + 256)
        if group and (full or far):
            _advance(group, texts, patterns, words[group[0]], out)
            group, more = [], set(patterns[i])
        group, letters = [*group, i], more
    if group:
        _advance(group, texts, patterns, words[group[0]], out)
    return out


def _advance(group: list[int], texts: list[str], patterns: list[str], words: int, out: list[int]) -> None:
    n = len(group)
    own = [_codes(patterns[i]) for i in group]
    alphabet = np.unique(np.concatenate(own))
    masks = np.zeros((n, len(alphabet) + 1, words), U)  # the last row: characters of no pattern
    for k, p in enumerate(own):
        at = np.arange(len(p))
        np.bitwise_or.at(masks, (k, np.searchsorted(alphabet, p), at // 64), ONE << (at % 64).astype(U))
    longest = max(len(texts[i]) for i in group)
    code = np.full((longest, n), len(alphabet), np.int64)  # beyond its end a text goes on with a character of no pattern, which saves no edit
    for k, i in enumerate(group):
        t = _codes(texts[i])
        j = np.minimum(np.searchsorted(alphabet, t), len(alphabet) - 1)
        code[: len(t), k] = np.where(alphabet[j] == t, j, len(alphabet))
    up = [np.full(n, ~U(0)) for _ in range(words)]
    down = [np.zeros(n, U) for _ in range(words)]
    length = np.array([len(p) for p in own])
    last = ((length - 1) % 64).astype(U)
    score, rows = length.copy(), np.arange(n)
    best = score.copy()
    for j in range(longest):
        eq = masks[rows, code[j]]
        plus, minus = np.zeros(n, U), np.zeros(n, U)  # the text's first row is 0 everywhere
        for w in range(words):
            e = eq[:, w]
            x = e | down[w]
            e = e | minus
            h = (((e & up[w]) + up[w]) ^ up[w]) | e
            rise, fall = down[w] | ~(h | up[w]), up[w] & h
            if w == words - 1:
                score = score + ((rise >> last) & ONE).astype(np.int64) - ((fall >> last) & ONE).astype(np.int64)
            rise_out, fall_out = rise >> TOP, fall >> TOP
            rise, fall = (rise << ONE) | plus, (fall << ONE) | minus
            up[w], down[w] = fall | ~(x | rise), rise & x
            plus, minus = rise_out, fall_out
        np.minimum(best, score, out=best)
    for k, i in enumerate(group):
        out[i] = int(best[k])
