"""Language-model scoring with a log-frequency Bloom filter.

Words and word pairs are counted over all training texts. Counts are quantised on
a binary log scale (level j: 2**(j-1) occurrences at least), and an n-gram of
level q is put into the filter q times, as (n-gram, 1) ... (n-gram, q). A count is
read back by probing (n-gram, 1), (n-gram, 2), ... until a probe fails. The model
interpolates: P(w | h) = LAMBDA * c(h w) / c(h) + (1 - LAMBDA) * P1(w), where all
counts c are read from the filter, those of single words too: P1(w) =
(c(w) + 0.5) / (M + 0.5 * (V + 1)), M being the sum of c over the V training words. A
history that the filter does not know gives P1 alone. Exact counts serve `base_score` only.
LAMBDA is where held-out text is most likely (measured on held-out documents: README).

Rows are dealt into chunks of text, which are written once. Each chunk ships its
distinct words and pairs with their counts in the training texts, as packed sorted
arrays, one for each range of hashes (a segment). One task merges a segment, makes
that segment's bits of the filter, probes them for every chunk and sends each chunk
one level an n-gram and the exact counts of its words; chunks meet these in their
own order and are scored. Segments grow in number, not in size, with the training
text, and the filter with them (BITS_A_BYTE for each byte): the rate of false
positives is that of a small table at every size, nothing is broadcast, and the
driver gets three totals. A chunk sends one row for each segment in which it has an n-gram:
up to some 10 TB these are far fewer than its n-grams, beyond that no more than them.

Defined results: a null text is empty: its one token is the end; without any
training text every token has probability 1; a null doc_id is held in; repeated
rows train and score one by one; a text longer than a chunk is a chunk of its own; an
empty table gives an empty result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import kernels as K
from inkwell.llm.common import in_arrow, table, written

LAMBDA = 0.5
#: Bits of the filter for a byte of training text, hash functions.
BITS_A_BYTE, HASHES = 2, 4
#: Words and bytes of a chunk, and training text a segment stands for.
MAX_WORDS, FLUSH, SEGMENT_TEXT = 8_000_000, 16 << 20, 16 << 20
#: Rows of a batch, and tokens that are scored at once.
ROWS, TOKENS = 1024, 1 << 18
#: Hashes that stand for the start and the end of a text, and salts for the orders.
START, END = np.array([0x51A7C0DE00000001, 0x51A7C0DE00000002], K.U64)
ORDER1, ORDER2 = K.U64(0x9E3779B97F4A7C15), K.U64(0xC2B2AE3D27D4EB4F)
LEVELS = 40


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first index of each row): each row's words and one end."""
    start, length, first = K.words(buf, offs, K.SPACED)
    word = K.hashes(buf, start, length)
    rows = len(offs) - 1
    at = first + np.arange(rows + 1)
    out = np.full(len(word) + rows, END, K.U64)
    own = np.ones(len(out), dtype=bool)
    own[at[1:] - 1] = False
    out[own] = word
    return out, at


def histories(token: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty_like(token)
    out[1:] = token[:-1]
    out[at[:-1]] = START
    return out


def unigrams(token: np.ndarray) -> np.ndarray:
    return K.mix(token ^ ORDER1)


def bigrams(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return K.mix(history * K.PLACES[0] + token * K.PLACES[1] + ORDER2)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers of as few bytes as the largest needs."""
    wide = np.ascontiguousarray(x, dtype=K.U64).view(np.uint8).reshape(-1, 8)
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return wide[:, :width].tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return out.view(K.U64).reshape(n)


def _packed(key: np.ndarray, low: int) -> bytes:
    """Sorted keys of the segment that begins at low, as steps."""
    return _narrow(np.diff(key, prepend=K.U64(low)))


def _unpacked(raw: bytes, n: int, low: int) -> np.ndarray:
    return np.cumsum(_wide(raw, n), dtype=K.U64) + K.U64(low)


def _chunks(max_words: int):
    """Numbers the rows, and the chunks that they fall into."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        chunk, row, size, seen = 0, 0, 0, 0
        for batch in batches:
            buf, offs = K.texts(batch.column("text"))
            out = np.empty(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                length = int(offs[i + 1] - offs[i])
                size, seen = size + length, seen + length // 2 + 1  # words at most
                if size != length and (size > FLUSH or seen > max_words):
                    chunk, size, seen = chunk + 1, length, length // 2 + 1
                out[i] = part | chunk
            yield pa.record_batch([pa.array(out), pa.array(np.arange(row, row + batch.num_rows)), *batch.columns], ["chunk", "row", *batch.schema.names])
            row += batch.num_rows

    return chunks


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and the place of each key among them as 32 bits: np.unique with less than half of its arrays alive at once."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    every = key[new]
    del key
    back = np.empty(len(order), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return every, back


def _paired(held: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """The pairs that end at each token; takes the tokens out of the list, so that they go before the pairs are sorted."""
    token = held.pop()
    out = histories(token, at)
    for k in range(0, len(out), TOKENS):
        out[k : k + TOKENS] = bigrams(out[k : k + TOKENS], token[k : k + TOKENS])
    return out


class Grams:
    """The distinct words (with START) and pairs of some rows, each sorted, and where the rows' tokens are among them."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        held, firsts, size = [], [np.zeros(1, np.int64)], 0
        for a, b in K.slices(offs):
            token, at = tokens(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            held.append(token)
            firsts.append(at[1:] + size)
            size += len(token)
        held.append(START[None])
        token, self.at = np.concatenate(held), np.concatenate(firsts)
        del held
        self.words, back = _distinct(token)
        self.back, self.start = back[:-1], back[-1]
        held = [token[:-1]]
        del token
        self.pairs, self.pair = _distinct(_paired(held, self.at))
        gram = unigrams(self.words)
        self.order = np.argsort(gram)
        self.ones = gram[self.order]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(chunk, first row, rows): rows of one chunk whose numbers follow each other."""
    held: list[pa.RecordBatch] = []
    last = (-1, -1)
    for batch in batches:
        chunk, row = np.asarray(batch.column("chunk")), np.asarray(batch.column("row"))
        if not len(row):
            continue
        new = (chunk != np.append(last[0], chunk[:-1])) | (row != np.append(last[1], row[:-1]) + 1)
        cuts = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), len(row)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if new[a] and held:
                yield held[0].column("chunk")[0].as_py(), held[0].column("row")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = (chunk[-1], row[-1])
    if held:
        yield held[0].column("chunk")[0].as_py(), held[0].column("row")[0].as_py(), pa.Table.from_batches(held)


KEYS = "chunk long, first long, seg int, " + ", ".join(f"n{k} int, k{k} binary, c{k} binary" for k in range(3))


def _count(bits: int):
    """Packed words, unigrams and pairs of each piece with their counts in training rows; the segment is the first `bits` bits of the hash."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=K.U64) << K.U64(64 - bits)
        for chunk, first, rows in _pieces(batches):
            grams = Grams(*K.texts(rows.column("text")))
            train = np.asarray(rows.column("train").combine_chunks().cast(pa.int8())).astype(np.float64)
            of = np.repeat(train, np.diff(grams.at))
            words = np.bincount(grams.back, of, len(grams.words)).astype(np.int64)
            words[grams.start] += int(train.sum())
            kinds = ((grams.words, words), (grams.ones, words[grams.order]), (grams.pairs, np.bincount(grams.pair, of, len(grams.pairs)).astype(np.int64)))
            cuts = [np.concatenate([[0], np.searchsorted(key, edges), [len(key)]]) for key, _ in kinds]
            used = np.flatnonzero(sum(np.diff(cut) for cut in cuts))
            for k in range(0, len(used), ROWS):
                some = used[k : k + ROWS].tolist()
                out: list = [np.full(len(some), chunk), np.full(len(some), first), np.array(some, np.int32)]
                for (key, many), cut in zip(kinds, cuts, strict=True):
                    spans = [(s, cut[s], cut[s + 1]) for s in some]
                    out += [np.array([b - a for _, a, b in spans], np.int32), pa.array([_packed(key[a:b], s << (64 - bits)) for s, a, b in spans], pa.binary()), pa.array([_narrow(many[a:b]) for _, a, b in spans], pa.binary())]
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in out], [f.split()[0] for f in KEYS.split(", ")])

    return count


def positions(gram: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """Places in the filter of (gram, level): all within the part that the gram's first bits name."""
    h = K.mix(gram + K.U64(level) * ORDER1)
    step = K.mix(h ^ ORDER2) | K.U64(1)
    for _ in range(HASHES):
        yield (h & K.U64((1 << bits) - 1)).astype(np.int64)
        h = h + step


class Filter:
    """2**bits bits in 2**parts equal parts; the first bits of a gram choose the part."""

    def __init__(self, bits: int, parts: int):
        self.bits, self.parts, self.data = bits, parts, np.zeros(1 << (bits - 3), np.uint8)

    def has(self, gram: np.ndarray, level: int) -> np.ndarray:
        """One probe for each gram."""
        alive = np.arange(len(gram))
        base = (gram >> K.U64(64 - self.parts)).astype(np.int64) << (self.bits - self.parts) if self.parts else np.zeros(len(gram), np.int64)
        for place in positions(gram, level, self.bits - self.parts):
            at = (base + place)[alive]
            alive = alive[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(gram), dtype=bool)
        out[alive] = True
        return out

    def levels(self, gram: np.ndarray) -> np.ndarray:
        """Levels by probing one after the other; 0 of unknown ones."""
        level = np.zeros(len(gram), np.int64)
        left = np.arange(len(gram))
        for j in range(1, LEVELS + 1):
            left = left[self.has(gram[left], j)]
            if not len(left):
                break
            level[left] = j
        return level

    def count(self, gram: np.ndarray) -> np.ndarray:
        return middle(self.levels(gram))


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of a level's range of counts."""
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1) - 0.5, 0.0)


def _put(bits: np.ndarray, gram: np.ndarray, many: np.ndarray, width: int) -> None:
    level = np.frexp(many.astype(np.float64))[1]  # 1: once, 2: two or three times, ...
    for j in range(1, int(level.max(initial=0)) + 1):
        for place in positions(gram[level >= j], j, width):
            bits[place] = True


ANSWERS = "chunk long, first long, seg int, " + ", ".join(f"n{k} int, v{k} binary" for k in range(3)) + ", total long, words long, mass double"


def _merge(parts: int, width: int):
    """The counts, and the bits, of one segment; each piece gets its words' counts and its n-grams' levels."""
    def merge(rows: pa.Table) -> pa.Table:
        seg = rows.column("seg")[0].as_py()
        low = seg << (64 - parts)
        sizes = [np.asarray(rows.column(f"n{k}")).astype(np.int64) for k in range(3)]
        found = []
        for k in range(3):
            key, many = [np.zeros(0, K.U64)], [np.zeros(0, K.U64)]
            for n, x, c in zip(sizes[k].tolist(), rows.column(f"k{k}"), rows.column(f"c{k}"), strict=True):
                key.append(_unpacked(x.as_py(), n, low))
                many.append(_wide(c.as_py(), n))
            every, back = _distinct(np.concatenate(key))
            del key
            found.append((every, back, np.bincount(back, np.concatenate(many).astype(np.float64), len(every)).astype(np.int64)))
        bits = np.zeros(1 << width, dtype=bool)
        for every, _, many in found[1:]:
            _put(bits, every[many > 0], many[many > 0], width)
        bloom = Filter(width, 0)
        bloom.data = np.packbits(bits, bitorder="little")
        out: list[list[bytes]] = []
        for k, (every, back, many) in enumerate(found):
            value = (many if k == 0 else bloom.levels(every))[back]
            ends = np.cumsum(sizes[k])
            out.append([_narrow(value[e - n : e]) for e, n in zip(ends.tolist(), sizes[k].tolist(), strict=True)])
        real = (found[0][0] != START) & (found[0][2] > 0)
        total, words, mass = (np.zeros(rows.num_rows, kind) for kind in (np.int64, np.int64, np.float64))
        total[0], words[0] = found[0][2][real].sum(), real.sum()
        ones, _, many = found[1]
        mass[0] = middle(bloom.levels(ones[(many > 0) & (ones != unigrams(START[None])[0])])).sum()
        columns = [rows.column(c) for c in ("chunk", "first", "seg")]
        for k in range(3):
            columns += [rows.column(f"n{k}"), pa.array(out[k], pa.binary())]
        return pa.table([*columns, pa.array(total), pa.array(words), pa.array(mass)], [f.split()[0] for f in ANSWERS.split(", ")])

    return merge


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """The rows, dealt into runs of some TOKENS tokens; every row has one."""
    cuts = np.unique(np.append(np.searchsorted(at, np.arange(0, at[-1], TOKENS), "right") - 1, len(at) - 1)).tolist()
    return list(zip(cuts, cuts[1:], strict=False))


def _scores(total: int, words: int, mass: float):
    def scored(grams: Grams, exact: np.ndarray, ones: np.ndarray, pairs: np.ndarray) -> list[np.ndarray]:
        """Of each row: tokens, known ones, log10 of base and of model."""
        seen = np.empty(len(grams.words))
        seen[grams.order] = middle(ones.astype(np.int64))
        exact, pairs = exact.astype(np.int64), middle(pairs.astype(np.int64))
        out = []
        for a, b in _runs(grams.at):
            of = slice(grams.at[a], grams.at[b])
            at, back = grams.at[a:b] - grams.at[a], grams.back[of]
            history = np.empty_like(back)
            history[1:] = back[:-1]
            history[at] = grams.start
            before = seen[history]
            pair = np.minimum(pairs[grams.pair[of]], before)
            c = exact[back]
            p0 = (c + 0.5) / (total + 0.5 * (words + 1))
            p1 = (seen[back] + 0.5) / (mass + 0.5 * (words + 1))
            p = np.where(before > 0, LAMBDA * pair / np.maximum(before, 1) + (1 - LAMBDA) * p1, p1)
            out.append([np.add.reduceat(x, at) for x in ((c > 0).astype(np.int64), np.log10(p0), np.log10(p))])
        return [np.diff(grams.at), *map(np.concatenate, zip(*out, strict=True))]

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, answers = chunk.sort_by("row"), answers.sort_by([("first", "ascending"), ("seg", "ascending")])
        row, first = np.asarray(chunk.column("row")), np.asarray(answers.column("first"))
        starts = np.unique(first)
        edges = np.append(np.searchsorted(row, starts), len(row))
        out = []
        for s, a, b in zip(starts, edges[:-1], edges[1:], strict=True):
            lo, hi = np.searchsorted(first, (s, s + 1))
            own = answers.slice(lo, hi - lo)
            got = [np.concatenate([_wide(x.as_py(), n) for n, x in zip(own.column(f"n{k}").to_pylist(), own.column(f"v{k}"), strict=True)]) for k in range(3)]
            out.append(scored(Grams(*K.texts(chunk.column("text").slice(a, b - a))), *got))
        values = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
        made = pa.table([chunk.column("doc_id"), chunk.column("held_out"), values[0].cast(pa.int64()), values[1], pa.array(np.full(len(row), total, np.int64)), values[2], values[3]], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return made.filter(chunk.column("asked"))

    return score


def shape(size: int) -> tuple[int, int]:
    """For so many bytes of training text: 2**parts segments, and 2**bits bits of all of them."""
    parts = max(3, (size // SEGMENT_TEXT).bit_length())
    return parts, max(parts + 10, max(1 << 16, size * BITS_A_BYTE).bit_length() - 1)


def score_rows(rows: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """rows: doc_id, text, held_out, train (counts), asked (is scored) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = dict(rows.dtypes)["doc_id"]
    base = written(in_arrow(rows.select("doc_id", "text", "held_out", "train", "asked"), _chunks(max_words), f"chunk long, row long, doc_id {kind}, text string, held_out boolean, train boolean, asked boolean"))
    size = base.filter("train").agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(1))).first()[0] or 1
    parts, bits = shape(size)
    keys = in_arrow(base.select("chunk", "row", "text", "train"), _count(parts), KEYS)
    answers = written(keys.groupBy("seg").applyInArrow(_merge(parts, bits - parts), ANSWERS))
    total, words, mass = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "words", "mass")]).first()
    own = answers.drop("total", "words", "mass")
    return base.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(_scores(total, words, mass), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, train: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """docs: doc_id, text, held_out; train: doc_id, text."""
    asked = docs.select("doc_id", "text", "held_out", F.lit(False).alias("train"), F.lit(True).alias("asked"))
    counted = train.select("doc_id", "text", F.lit(False).alias("held_out"), F.lit(True).alias("train"), F.lit(False).alias("asked"))
    return score_rows(asked.union(counted), max_words)


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return score_rows(docs.withColumn("train", ~F.col("held_out")).withColumn("asked", F.lit(True)))
