"""Removal of repeated byte strings by bucket-pointer refinement.

Suffixes lie in buckets of equal first bytes, and each has a pointer to its bucket. The
first buckets are those of the 8 bytes that a suffix begins with. A bucket is refined by
sorting its suffixes on the pointers of the suffixes some bytes later, and the finer
pointers are written back, where the next round reads them: after 8 bytes buckets are 16,
32, 64 and, by pointers 36 bytes later, 100 = SPAN deep. Suffixes alone in their bucket
drop out. All of this compares bytes, not fingerprints (`refined`).

Suffixes enter at anchors, so that few of them must meet: the anchor of a 100-byte string is
the smallest of its 77 24-byte grams, a function of the string, so equal strings have equal
anchors and the strings of an anchor lie side by side in a region of 100 to 176 bytes.

1. Each region has the gram of its anchor and a fingerprint of all its bytes; equal regions
   of one batch are resolved at once (the first stays), so copies never travel.
2. Regions are sorted by gram, fingerprint and place. Regions equal to an earlier
   one are removed whole. A gram with one fingerprint left is done: nearly all are.
3. The regions of the others meet once more, with their bytes, sorted by gram, and
   their suffixes are refined. All strings of a bucket but the first are removed. Where the
   regions of a gram are in several pieces, the firsts of the pieces meet in a last, small shuffle.

Grams that hold more than a MOST_HOT-th of all regions are found first (each task tells those
above that share of its own). Their buckets are finer from the start: the strings of a region
that hold the NEXT bytes after the anchor's gram are in the bucket of the gram and these bytes,
the others, which hold those before it, in that of the gram and the bytes before.

Defined results: a null text has no bytes; a text under 100 bytes loses nothing; a long text
is read in overlapping pieces with the same strings; ids order the documents, null after all
others; each row without an id is a document
of its own, and these are in the order of their texts' MD5; rows that share an id are
versions of one document: a string at the same start of two versions counts once, and
what one version loses all lose; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import kernels as K
from inkwell.llm.common import in_arrow, numbered, table, written

SPAN, GRAM = 100, 24
GRAMS = SPAN - GRAM + 1
#: Bytes beside a hot gram that its finer buckets take in: half of what a string has beside it.
NEXT = (SPAN - GRAM) // 2
#: Bytes of the first buckets, as one number.
FIRST = 8
#: Bits of a packed value that hold a place in a piece; pieces are shorter than that.
PLACE = K.U64(20)
PIECE = (1 << 20) - SPAN


def pieces(column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, place of each row's bytes in its text): rows, or overlapping pieces of one long row."""
    buf, offs = K.texts(column)
    for a, b in K.slices(offs, PIECE):
        lo, hi = int(offs[a]), int(offs[b])
        if hi - lo <= PIECE:
            yield a, buf[lo:hi], offs[a : b + 1] - lo, np.zeros(b - a, np.int64)
            continue
        for s in range(lo, hi - SPAN + 1, PIECE - SPAN + 1):
            e = min(hi, s + PIECE)
            yield a, buf[s:e], np.array([0, e - s]), np.array([s - lo])


def regions(buf: np.ndarray, offs: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, first string, strings, bucket, fingerprint) of each region; hot: sorted grams whose buckets are finer."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, K.U64) for _ in range(2))
    n = len(buf) - SPAN + 1
    if n <= 0:
        return none
    prefix = K.raw(buf)
    at = np.arange(len(buf) - GRAM + 1)
    gram = K.span(prefix, at, GRAM)
    low = (gram >> PLACE << PLACE) | at.astype(K.U64)
    width = 1
    while width * 2 <= GRAMS:  # smallest of `width` grams, doubling
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[GRAMS - width : GRAMS - width + n])
    anchor = (low & K.U64((1 << int(PLACE)) - 1)).astype(np.int64)
    ok = np.zeros(len(buf) + 1, np.int64)  # strings within one row: +1 and -1 at their ends
    long = np.diff(offs) >= SPAN
    np.add.at(ok, offs[:-1][long], 1)
    np.add.at(ok, offs[1:][long] - SPAN + 1, -1)
    ok = np.cumsum(ok)[:n] > 0
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    if not len(first):
        return none
    stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1
    many, anchor = stop - first, anchor[first]
    bucket = gram[anchor]
    if hot is not None and len(hot):
        at = np.searchsorted(hot, bucket)
        at[at == len(hot)] = 0
        split = hot[at] == bucket
        # strings up to NEXT bytes before the anchor hold as many after its gram; those before hold NEXT + 1 before it
        f, m, a, g = first[split], many[split], anchor[split], bucket[split]
        cut = np.clip(a - NEXT, f, f + m)
        right, left = f + m > cut, cut > f
        finer = lambda pick, where, size, k: K.mix(g[pick] * K.PLACES[k] + K.span(prefix, where[pick], size))
        first = np.concatenate([first[~split], cut[right], f[left]])
        many = np.concatenate([many[~split], (f + m - cut)[right], (cut - f)[left]])
        anchor = np.concatenate([anchor[~split], a[right], a[left]])
        bucket = np.concatenate([bucket[~split], finer(right, a + GRAM, NEXT, 3), finer(left, a - NEXT - 1, NEXT + 1, 4)])
    row = np.searchsorted(offs, first, "right") - 1
    print_ = K.mix(K.span(prefix, first, many + SPAN - 1) + (anchor - first).astype(K.U64))
    return row, first, many, bucket, print_


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the ranges of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    # a running maximum of the ends within each document: documents are lifted apart by rank
    lift = np.cumsum(new) * (int(end.max()) + 2)
    far = np.maximum.accumulate(end + lift)
    new[1:] |= (start + lift)[1:] > far[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end + lift, at) - lift[at]


def _rows(kind: int, doc: np.ndarray, start: np.ndarray, many: np.ndarray, gram: np.ndarray | None = None, print_: np.ndarray | None = None) -> pa.RecordBatch:
    """Place, number and kind share a number; rows without a gram are dealt by document."""
    packed = start << 24 | many.clip(max=(1 << 22) - 1) << 2 | kind
    gram = (K.mix(doc.astype(K.U64)) if gram is None else gram).view(np.int64)
    return pa.record_batch([pa.array(doc.astype(np.int64)), pa.array(packed.astype(np.int64)), pa.array(gram), pa.array(np.zeros(len(doc), np.int64) if print_ is None else print_.view(np.int64))], ["doc", "packed", "gram", "print"])


def _gone(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of removed ranges, which a number of 22 bits may have to split."""
    doc, start, end = _merge(doc, start, end)
    while len(doc):
        size = np.minimum(end - start, (1 << 22) - 1)
        yield _rows(GONE, doc, start, size)
        left = start + size < end
        doc, start, end = doc[left], (start + size)[left], end[left]


ROWS = "doc long, packed long, gram long, print long"
#: Kinds of rows: a region to sort, a range that is removed, a region whose strings must be refined.
REGION, GONE, OPEN = 0, 1, 2
#: Regions resolved together, and strings refined together.
FLUSH, LIMIT = 400_000, 400_000
#: Rows that are added at once.
STEP = 512
#: Hot grams at most, and regions of one at least.
MOST_HOT, HOT = 1 << 16, 1 << 11


def kind() -> Column:
    return F.col("packed").bitwiseAND(F.lit(3))


def many() -> Column:
    return F.shiftright("packed", 2).bitwiseAND(F.lit((1 << 22) - 1))


def start() -> Column:
    return F.shiftright("packed", 24)


def _heat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of this task with a share of its regions that a hot one has in some task: at most MOST_HOT of them."""
    held: list[np.ndarray] = []
    grams, many = np.zeros(0, K.U64), np.zeros(0, np.int64)
    total = 0

    def count() -> tuple[np.ndarray, np.ndarray]:
        gram, back = np.unique(np.concatenate([grams, *held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([many, *(np.ones(len(x)) for x in held)]), len(gram)).astype(np.int64)
        keep = n > max(1, total // MOST_HOT)
        return gram[keep], n[keep]

    for batch in batches:
        for _, buf, offs, _ in pieces(batch.column("text")):
            held.append(regions(buf, offs)[3])
            total += len(held[-1])
        if sum(map(len, held)) >= FLUSH:
            grams, many = count()
            held = []
    grams, many = count()
    yield pa.record_batch([pa.array(np.append(grams.view(np.int64), 0)), pa.array(np.append(many, 0)), pa.array(np.append(np.zeros(len(many), np.int64), total))], ["gram", "n", "total"])


def hot_grams(own: DataFrame) -> np.ndarray:
    """Sorted grams whose buckets must be finer, at most MOST_HOT."""
    told = written(in_arrow(own.select("text"), _heat, "gram long, n long, total long"))
    most = max(HOT, (told.agg(F.sum("total")).first()[0] or 0) // MOST_HOT)
    got = told.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("gram").toArrow()  # each holds a MOST_HOT-th of all regions
    return np.sort(np.asarray(got.column("gram")).view(K.U64))


def _anchor(hot: np.ndarray):
    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _anchored(batches, hot)

    return anchor


def _anchored(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, start, many, gram, print_ = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, doc, print_, gram))
        doc, start, many, gram, print_ = doc[order], start[order], many[order], gram[order], print_[order]
        same = np.concatenate([[False], (gram[1:] == gram[:-1]) & (print_[1:] == print_[:-1])])
        once = same & np.concatenate([[False], (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])])  # versions of one row
        yield _rows(REGION, doc[~same], start[~same], many[~same], gram[~same], print_[~same])
        same &= ~once
        yield from _gone(doc[same], start[same], start[same] + many[same] + SPAN - 1)

    parts: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        ids = np.asarray(batch.column("doc"))
        for a, buf, offs, shift in pieces(batch.column("text")):
            row, first, many, gram, print_ = regions(buf, offs, hot)
            if len(row):
                parts.append((ids[a + row], first - offs[row] + shift[row], many, gram, print_))
                size += len(row)
            if size >= FLUSH:
                yield from flush(parts)
                parts, size = [], 0
    if parts:
        yield from flush(parts)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram, print, doc, packed. Of equal regions the first stays; it is open if its gram has another print."""
    last: tuple | None = None  # doc, start, gram, print of the region before
    head: tuple = ()  # doc, start, many, gram of the first region of the last print
    said = False  # whether that one is out as open
    for batch in batches:
        doc, packed, gram, print_ = (np.asarray(batch.column(c)) for c in ("doc", "packed", "gram", "print"))
        through = packed & 3 != REGION
        if through.any():
            yield batch.filter(pa.array(through))
        doc, packed, gram, print_ = (x[~through] for x in (doc, packed, gram, print_))
        if not len(doc):
            continue
        start, many = packed >> 24, packed >> 2 & (1 << 22) - 1
        before = lambda x, k: np.concatenate([[last[k] if last else ~x[0]], x[:-1]])  # noqa: B023, E731
        same_gram = gram == before(gram, 2)
        same = same_gram & (print_ == before(print_, 3))
        gone = same & ~((doc == before(doc, 0)) & (start == before(start, 1)))
        lead = np.flatnonzero(~same)  # the first of each print that begins in this batch
        opened = same_gram[lead]  # its gram had another print before
        if len(lead) and opened[0] and head and not said:
            yield _rows(OPEN, *(np.array([x]) for x in head))
        openly = lead[opened | np.append(opened[1:], False)] if len(lead) else lead
        if len(openly):
            yield _rows(OPEN, doc[openly], start[openly], many[openly], gram[openly])
        yield from _gone(doc[gone], start[gone], start[gone] + many[gone] + SPAN - 1)
        if len(lead):
            k = lead[-1]
            head, said = (doc[k], start[k], many[k], gram[k]), bool(opened[-1])
        last = (doc[-1], start[-1], gram[-1], print_[-1])


def refined(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, pointers) of the SPAN-byte strings that lie within a row: pointers are equal where the bytes are."""
    n = len(buf)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)  # bytes from here to the row's end
    eight = np.zeros(n, K.U64)
    for j in range(FIRST if n >= FIRST else 0):
        eight[: n - FIRST + 1] |= buf[j : n - FIRST + 1 + j].astype(K.U64) << K.U64(8 * (FIRST - 1 - j))
    pointer = np.full(n, -1, np.int64)
    live = np.flatnonzero(left >= FIRST)
    order = np.argsort(eight[live], kind="stable")
    key = eight[live][order]
    place = np.arange(len(live))
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(live)]
    pointer[live[order]] = np.maximum.accumulate(np.where(new, place, 0))
    depth = FIRST
    while depth < SPAN:
        step = min(depth, SPAN - depth)
        deep = left >= depth
        company = np.bincount(pointer[deep], minlength=n)
        live = np.flatnonzero(left >= depth + step)
        live = live[company[pointer[live]] > 1]
        if not len(live):
            break
        bucket, later = pointer[live], pointer[live + step]
        order = np.argsort(bucket * n + later, kind="stable") if n < 1 << 31 else np.lexsort((later, bucket))
        bucket, later = bucket[order], later[order]
        place = np.arange(len(live))
        other = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        new = other | np.concatenate([[True], later[1:] != later[:-1]])
        # a finer bucket begins as far into its bucket as its first suffix lies
        pointer[live[order]] = bucket + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(other, place, 0))
        depth += step
    at = np.flatnonzero(left >= SPAN)
    return at, pointer[at]


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the open regions of each document."""
    for batch in batches:
        ids = np.asarray(batch.column("doc"))
        buf, offs = K.texts(batch.column("text"))
        raw = buf.tobytes()
        out: list[list] = [[] for _ in range(4)]
        for i, own in enumerate(batch.column("spans")):
            lo, hi = int(offs[i]), int(offs[i + 1])
            for g, s, m in zip(*(own.values.field(c).to_pylist() for c in ("gram", "start", "many")), strict=True):
                part = raw[lo + s : min(hi, lo + s + m + SPAN - 1)]
                if len(part) >= SPAN:  # another version of the document may be shorter
                    for c, v in zip(out, (g, int(ids[i]), s, part), strict=True):
                        c.append(v)
        if out[0]:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["gram", "doc", "start", "bytes"])


def _resolve(rows: pa.Table, parted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Later strings of a bucket are gone; the firsts go on where other pieces of the row's gram are elsewhere (`parted`)."""
    buf, offs = K.texts(rows.column("bytes"))
    at, name = refined(buf, offs)
    row = np.searchsorted(offs, at, "right") - 1
    doc, start = np.asarray(rows.column("doc"))[row], np.asarray(rows.column("start"))[row] + at - offs[row]
    order = np.lexsort((start, doc, name))
    at, row, name, doc, start = at[order], row[order], name[order], doc[order], start[order]
    same = np.concatenate([[False], name[1:] == name[:-1]])[: len(name)]
    again = np.concatenate([[False], (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])])[: len(name)]  # versions of one document
    gone = same & ~again
    yield from _gone(doc[gone], start[gone], start[gone] + SPAN)
    on = ~same & parted[row]
    if on.any():
        yield _rows(OPEN, doc[on], start[on], np.ones(int(on.sum()), np.int64), K.span(K.raw(buf), at[on], SPAN))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram; whole grams of some LIMIT strings together are refined together, larger grams in pieces."""
    held = pa.table({"gram": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "bytes": pa.array([], pa.binary())})
    size, before = 0, None  # before: the gram of which a piece is out
    many = lambda t: int(np.diff(K.texts(t.column("bytes"))[1] - (SPAN - 1) * np.arange(t.num_rows + 1)).sum())

    def flush(rows: pa.Table, after: int | None) -> Iterator[pa.RecordBatch]:
        gram = np.asarray(rows.column("gram"))
        parted = np.zeros(len(gram), dtype=bool)
        for other in (before, after):
            if other is not None:
                parted |= gram == other
        yield from _resolve(rows, parted)

    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            some = pa.Table.from_batches([batch.slice(at, STEP)])
            held, size = pa.concat_tables([held, some]), size + many(some)
            if size < LIMIT:
                continue
            gram = np.asarray(held.column("gram"))
            last = int(gram[-1])
            tail = int(np.flatnonzero(gram == last)[0])
            if tail:
                yield from flush(held.slice(0, tail), None)
                held, before = held.slice(tail), None if before != last else before
                size = many(held)
            if size >= LIMIT:  # one gram alone
                yield from flush(held, last)
                held, size, before = held.slice(held.num_rows), 0, last
    if held.num_rows:
        yield from flush(held, None)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = K.texts(batch.column("text"))
        out: list[list] = [[] for _ in range(5)]
        for i, own in enumerate(batch.column("gone")):
            text = buf[offs[i] : offs[i + 1]]
            keep, removed = hashlib.sha256(), []
            if own.is_valid and len(own.values):
                s, e = np.asarray(own.values.field("start")), np.asarray(own.values.field("end"))
                _, s, e = _merge(np.zeros(len(s), np.int64), s, np.minimum(e, len(text)))
                removed = [(a, b) for a, b in zip(s.tolist(), e.tolist(), strict=True) if a < b]
            at = 0
            for a, b in removed:
                keep.update(text[at:a])
                at = b
            keep.update(text[at:])
            for c, v in zip(out, (len(text), sum(b - a for a, b in removed), len(removed), keep.hexdigest(), [{"start": a, "end": b} for a, b in removed]), strict=True):
                c.append(v)
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed ranges); one row a document."""
    own = numbered(docs)
    # Removed ranges travel with the regions, so that the texts are read once for both.
    anchored = in_arrow(own.select("doc", "text"), _anchor(hot_grams(own)), ROWS).repartition("gram").sortWithinPartitions("gram", "print", "doc", "packed")
    met = written(in_arrow(anchored, _meet, ROWS))
    spans = met.filter(kind() == OPEN).groupBy("doc").agg(F.collect_list(F.struct("gram", start().alias("start"), many().alias("many"))).alias("spans"))
    dealt = own.repartition("doc")  # one exchange of the texts, for this join and the last
    opened = in_arrow(dealt.join(spans, "doc").select("doc_id", "text", "doc", "spans"), _fetch, "gram long, doc long, start long, bytes binary")
    strings = in_arrow(opened.repartition("gram").sortWithinPartitions("gram"), _strings, ROWS)
    first = F.min(F.struct("doc", "packed")).over(Window.partitionBy("gram"))
    late = strings.withColumn("first", F.when(kind() == OPEN, first))
    ranges = lambda df, size: df.select("doc", start().alias("start"), (start() + size).alias("end"))
    gone = ranges(met.filter(kind() == GONE), many())
    gone = gone.union(ranges(late.filter((kind() == GONE) | (F.struct("doc", "packed") != F.col("first"))), F.when(kind() == GONE, many()).otherwise(SPAN)))
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    type_ = dict(docs.dtypes)["doc_id"]
    return in_arrow(dealt.join(gone, "doc", "left").select("doc_id", "text", "doc", "gone"), _cut, f"doc_id {type_}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("spans")
