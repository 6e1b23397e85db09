"""Benchmark decontamination by winnowing.

Every span of WINDOW = 10 words holds six 5-word grams; the smallest of their
hashes is the span's fingerprint, and consecutive spans mostly share theirs, so
about two in seven grams are kept. A span that occurs in both texts has the same
fingerprint in both: no shared span of 10 words can be missed. Fingerprints of
documents are joined with those of the benchmark, and every hit is extended to
the spans around it, which are compared in full (by a hash of all their words).
An item of fewer than 10 words, but not none, is one span of its own length, and
its fingerprint is the span itself.

The benchmark is measured first and cut into blocks of at most BLOCK_BYTES of
text by a hash of its rows. One block's index is broadcast at a time; the
documents pass each block in turn, so nothing that is broadcast grows with the
data, and no shuffle is needed at all.

Defined results: null texts have no words; items without words are never found;
an item with a null id marks words but is not listed; items of equal id count
once; repeated documents are reported one by one; an empty benchmark finds
nothing; columns beyond doc_id and text (item_id and text) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import kernels as K
from inkwell.llm.common import in_arrow, table, written

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 8 << 20
#: Blocks whose passes are chained in one stage.
CHAINED = 3


class Index:
    """Fingerprints and spans of one block of the benchmark."""

    def __init__(self, ids: list, column: pa.Array | pa.ChunkedArray):
        buf, offs = K.texts(column)
        start, length, first = K.words(buf, offs, K.ALNUM)
        word = K.hashes(buf, start, length)
        counts = np.diff(first)
        self.ids = ids
        self.spans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        whole = K.ngrams(word, WINDOW)
        ok = K.within(first, WINDOW)
        if ok.any():
            item = np.searchsorted(first, np.flatnonzero(ok), "right") - 1
            self.spans[WINDOW] = self._table(whole[ok], item)
        self.prints = np.unique(minima(K.ngrams(word, GRAM))[ok]) if ok.any() else np.zeros(0, K.U64)
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(self.prints & K.U64(0xFFFF)).astype(np.int64)] = True
        for n in sorted({int(c) for c in counts if 0 < c < WINDOW}):
            rows = np.flatnonzero(counts == n)
            self.spans[n] = self._table(K.ngrams(word, n)[first[rows]], rows)

    @staticmethod
    def _table(spans: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct spans, and where the items of each begin in the list of items."""
        pairs = np.unique(np.stack([spans, item.astype(K.U64)]), axis=1)
        keys, at = np.unique(pairs[0], return_index=True)
        return keys, np.append(at, pairs.shape[1]), pairs[1].astype(np.int64)

    def find(self, word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(span length, starts of the words' spans that are in the index, place of each in its table)."""
        for n, (keys, _, _) in self.spans.items():
            ok = K.within(first, n)
            if not ok.any():
                continue
            if n == WINDOW:
                low = minima(K.ngrams(word, GRAM))
                new = np.concatenate([[True], low[1:] != low[:-1]])  # the grams that winnowing keeps
                kept = low[new]
                met = self.bits[(kept & K.U64(0xFFFF)).astype(np.int64)]
                met[met] = member(self.prints, kept[met])[0]
                at = np.flatnonzero(np.repeat(met, np.diff(np.append(np.flatnonzero(new), len(low)))) & ok)
                spans = sum_spans(word, at, n)
            else:
                at = np.flatnonzero(ok)
                spans = K.ngrams(word, n)[at]
            there, place = member(keys, spans)
            if there.any():
                yield n, at[there], place[there]


def minima(grams: np.ndarray) -> np.ndarray:
    """The smallest gram of each WINDOW words."""
    w = WINDOW - GRAM + 1
    if len(grams) < w:
        return np.zeros(0, K.U64)
    two = np.minimum(grams[:-1], grams[1:])
    four = np.minimum(two[:-2], two[2:])
    return np.minimum(four[: len(grams) - w + 1], two[4:])


def sum_spans(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """K.ngrams at some places only."""
    out = np.zeros(len(at), K.U64)
    for j in range(n):
        out += word[at + j] * K.PLACES[j]
    return K.mix(out + K.U64(n))


def member(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, asked)
    if not len(keys):
        return np.zeros(len(asked), dtype=bool), at
    at[at == len(keys)] = 0
    return keys[at] == asked, at


def _scan(index, fresh: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Index = index.value
        for batch in batches:
            buf, offs = K.texts(batch.column("text"))
            for a, b in K.slices(offs):
                part = buf[offs[a] : offs[b]]
                start, length, first = K.words(part, offs[a : b + 1] - offs[a], K.ALNUM)
                word = K.hashes(part, start, length)
                edges = np.zeros(len(word) + 1, np.int64)
                row_of, item_of = [], []
                for n, at, place in block.find(word, first):
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + n, -1)
                    _, begin, items = block.spans[n]
                    many = begin[place + 1] - begin[place]
                    row_of.append(np.repeat(np.searchsorted(first, at, "right") - 1, many))
                    item_of.append(items[np.repeat(begin[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])
                rows = b - a
                # A span ends within its row, so runs of hit words of two rows touch but are cut at the row.
                hit = np.cumsum(edges[:-1]) > 0
                left = np.concatenate([[False], hit[:-1]])
                left[first[:-1][first[:-1] < len(hit)]] = False
                begins = np.flatnonzero(hit & ~left)
                right = np.concatenate([hit[1:] & left[1:], [False]]) if len(hit) else left
                ends = np.flatnonzero(hit & ~right) + 1
                own = np.searchsorted(first, begins, "right") - 1
                ranges = [[] for _ in range(rows)]
                for r, s, e in zip(own.tolist(), (begins - first[own]).tolist(), (ends - first[own]).tolist(), strict=True):
                    ranges[r].append({"start": s, "end": e})
                found: list[set] = [set() for _ in range(rows)]
                if row_of:
                    both = np.unique(np.stack([np.concatenate(row_of), np.concatenate(item_of)]), axis=1)
                    for r, i in both.T.tolist():
                        if block.ids[i] is not None:
                            found[r].add(block.ids[i])
                out = [c.slice(a, rows) for c in batch.columns]
                if fresh:
                    out += [pa.array(np.diff(first).astype(np.int64)), pa.array(ranges, RANGES), pa.array([sorted(x) for x in found], ITEMS)]
                else:
                    out[-2] = pa.array([x + y for x, y in zip(out[-2].to_pylist(), ranges, strict=True)], RANGES)
                    out[-1] = pa.array([sorted({*x, *y}) for x, y in zip(out[-1].to_pylist(), found, strict=True)], ITEMS)
                yield pa.record_batch(out, [*(batch.schema.names if fresh else batch.schema.names[:-3]), "n_words", "ranges", "items"])

    return scan


RANGES, ITEMS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())


def union(ranges: Column) -> Column:
    """Ranges in order, those that overlap or touch made one."""
    def add(done, r):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= r["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs and n_words, ranges (of hit words, by number from 0, end exclusive), items (ids as strings)."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL")
    blocks = -(-(tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] or 1) // block_bytes)
    blocks = 1 if blocks == 1 else 2 * blocks  # a hash deals unevenly
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + "n_words long, ranges array<struct<start:bigint,end:bigint>>, items array<string>"
    out = docs
    for k in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else tests
        rows = part.toArrow()
        index = spark.sparkContext.broadcast(Index(rows.column("item_id").to_pylist(), rows.column("text")))
        out = in_arrow(out, _scan(index, k == 0), schema)
        if k % CHAINED == CHAINED - 1 and k < blocks - 1:
            out = written(out)
    return out if blocks == 1 else out.withColumn("ranges", union(F.col("ranges")))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of contamination()."""
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT rid, item_id, i, n FROM dw JOIN bw USING (n, s)),
p AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""
