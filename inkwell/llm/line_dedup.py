"""Removal of repeated lines by a segment-partition edit join.

Lines that are near each other are linked; classes are the components of the links, and of
each class the first line (smallest doc_id, then place) stays. A line of n bytes allows
`allowed(n)` edits (of UTF-8 bytes): one for each ten bytes, at most EDITS = 2; two lines are
near if their distance is within what the shorter one allows, so lines under ten bytes must be equal.
Two lines within k edits, cut into k + 1 segments, share at least one
segment: each distinct line indexes its segments by its length, and probes, for
each length up to k shorter, the substrings at which such a segment can lie (the
multi-match-aware ranges of the published method, which leave out places that would
need more edits than are left on either side). Rows of the index and of the probes
meet by the hash of (length, segment number, bytes). Pairs must agree in a 16-cell
byte histogram up to two edits, which loses none, before they are verified by banded
bit-parallel edit distance, for many pairs side by side.

Equal lines are one class from the start, batch by batch and then over all, so common
lines never travel or unfold. A bucket of up to FEW rows gives its pairs at once. A larger one
is read as a stream: its rows meet its first CENTRES index lines alone, and are kept. A large bucket
that these links do not connect is refined: two of its lines are near through this segment only if what is left of
them, without the segment, is within k edits, so the rest of each line, without what the whole bucket has in common at
both ends, is cut into k + 1 segments again, and rows meet in finer buckets (`refined`). Of a line filled into a template the
differing part alone is left after a step or two. A rest of no more than k bytes is certain to be near, and its bucket's
centre links it. So every bucket ends with up to FEW rows, connected or with nothing left, whatever its size; rows of a
bucket grow with its lines, and pairs with its rows.

Defined results: a null text has no lines; blank lines are kept and not judged; the
last line may lack its end; a line of any length is read whole; rows without an id come after
all others, each a document of its own, in the order of their texts' MD5; rows that share an
id are versions of one
document, and a line at the same place of two versions counts once; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import kernels as K
from inkwell.llm.common import in_arrow, joined, numbered, table, written
from inkwell.llm.graph import components

EDITS, BYTES_AN_EDIT = 2, 10
#: Pairs of one bucket that are compared together; rows of a bucket that meet at once, centres of a larger one.
PAIRS, FEW, CENTRES = 1 << 20, 1 << 9, 64
INDEXED, PROBED = 0, 1


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of each line without its end; every text has one line at least."""
    cut = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offs[:-1], cut + 1]), kind="stable")
    order = np.sort(np.concatenate([offs[1:], cut]), kind="stable")
    # A text's end and the next one's start coincide, so the k-th start goes with the k-th end.
    row = np.searchsorted(cut, offs)
    many = np.diff(row) + 1
    return np.repeat(np.arange(len(offs) - 1), many), starts, order - starts


def _blank(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(K.SPACED[buf])])
    return seen[start + length] == seen[start]


def _lines_of(column) -> Iterator[tuple]:
    """(first row, bytes, row, start, length, place) of the lines that are not blank."""
    buf, offs = K.texts(column)
    for a, b in K.slices(offs):
        part, at = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        row, start, length = lines(part, at)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = ~_blank(part, start, length)
        yield a, part, row[keep], start[keep], length[keep], place[keep]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("doc"))
        for a, part, row, start, length, place in _lines_of(batch.column("text")):
            line = K.span(K.raw(part), start, length) if len(row) else np.zeros(0, K.U64)
            yield pa.record_batch([pa.array(ids[a + row]), pa.array(place.astype(np.int64)), pa.array(line.view(np.int64))], ["doc", "place", "line"])


def allowed(length: np.ndarray) -> np.ndarray:
    """Edits within which a line of this length is near another that is not shorter."""
    return np.minimum(length // BYTES_AN_EDIT, EDITS)


def segments(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i of lines of these lengths: the last ones take what does not divide."""
    base = length // parts
    longer = parts - length % parts  # segments from here on have one byte more
    return i * base + np.maximum(i - longer, 0), base + (i >= longer)


def _histogram(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Counts of bytes in 16 cells, each modulo 16, in one number."""
    out = np.zeros(len(start), K.U64)
    order = np.argsort(start)  # sums between the lines stay short
    edges = np.stack([start[order], (start + length)[order]], axis=1).ravel()
    cell = np.append((buf * np.uint8(181) >> np.uint8(4)) & np.uint8(15), np.uint8(255))
    for c in range(16):
        seen = np.add.reduceat((cell == c).view(np.uint8), edges, dtype=np.uint8)[::2]  # modulo 256
        out[order] |= (seen & np.uint8(15)).astype(K.U64) << K.U64(4 * c)
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done: set | np.ndarray = np.zeros(0, K.U64)
        for _, part, _, start, length, _ in _lines_of(batch.column("text")):
            if not len(start):
                continue
            prefix = K.raw(part)
            line, at = np.unique(K.span(prefix, start, length), return_index=True)
            new = (length[at] >= BYTES_AN_EDIT) & ~np.isin(line, done)
            line, at = line[new], at[new]
            done = np.union1d(done, line)
            s, n, h = start[at], length[at], _histogram(part, start[at], length[at])
            if not len(s):
                continue

            def key(i: int, size: np.ndarray, from_: np.ndarray, of: np.ndarray) -> np.ndarray:
                return K.mix(K.span(prefix, from_, size) * K.PLACES[1] + of.astype(K.U64) * K.PLACES[2] + K.U64(i))  # noqa: B023

            out = []
            for edits in range(1, EDITS + 1):
                parts = edits + 1
                for i in range(parts):
                    own = allowed(n) == edits
                    p, size = segments(n[own], i, parts)
                    out.append((key(i + parts * parts, size, s[own] + p, n[own]), line[own], h[own], np.full(int(own.sum()), INDEXED, np.int8)))
                    for less in range(edits + 1):
                        short = n - less
                        p, size = segments(short, i, parts)
                        # the segment of the shorter line may have moved by i edits from the left, and by parts - 1 - i from the right
                        for move in range(-edits, edits + less + 1):
                            if abs(move) > i or abs(move - less) > parts - 1 - i:
                                continue
                            ok = (p + move >= 0) & (p + move + size <= n) & (allowed(short) == edits)
                            out.append((key(i + parts * parts, size[ok], (s + p + move)[ok], short[ok]), line[ok], h[ok], np.full(int(ok.sum()), PROBED, np.int8)))
            keys, line, h, side = (np.concatenate(c) for c in zip(*out, strict=True))
            keys = (keys & ~K.U64(1)) | side.astype(K.U64)
            yield pa.record_batch([pa.array(c.view(np.int64)) for c in (keys, line, h)], ["key", "line", "histogram"])


def near_histograms(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two edits can make one histogram the other: an edit changes at most two cells by one."""
    total = np.zeros(np.broadcast_shapes(x.shape, y.shape), np.int16)
    for c in range(16):
        d = ((x >> K.U64(4 * c)) - (y >> K.U64(4 * c))) & K.U64(15)
        total += np.minimum(d, K.U64(16) - d).astype(np.int16)
    return total <= 2 * EDITS


def crossed(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller, larger) lines of the pairs of x and y whose histograms are near; x, y: line, histogram."""
    wide = max(1, PAIRS // max(1, len(y[0])))
    for a in range(0, len(x[0]), wide):
        some = [c[a : a + wide, None] for c in x]
        ok = near_histograms(some[1], y[1][None, :]) & (some[0] != y[0][None, :])
        i, j = np.nonzero(ok)
        if len(i):
            yield np.minimum(x[0][a + i], y[0][j]), np.maximum(x[0][a + i], y[0][j])


MET = "a long, b long, key long"


def _out(pairs: list) -> Iterator[pa.RecordBatch]:
    if pairs:
        a, b = np.unique(np.stack([np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])]), axis=1)
        yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.zeros(len(a), np.int64))], ["a", "b", "key"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, whose last bit is the side (index rows first). Pairs of a bucket's index and probe rows (key 0);
    of a bucket of more than FEW rows those with its first lines, and its rows: line, histogram, key."""
    held: list[np.ndarray] | None = None  # rows of the bucket that is not over
    centres: tuple[np.ndarray, ...] | None = None  # of that bucket, once it is large

    def bucket(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        side = rows[0] & 1
        sides = []
        for want in (INDEXED, PROBED):
            line, at = np.unique(rows[1][side == want], return_index=True)
            sides.append((line.view(K.U64), rows[2][side == want][at].view(K.U64)))
        return crossed(*sides)

    def large(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        line, hist = rows[1].view(K.U64), rows[2].view(K.U64)
        yield from _out(list(crossed(centres, (line, hist))))
        yield pa.record_batch([pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[0])], ["a", "b", "key"])

    for batch in batches:
        cols = [np.asarray(batch.column(c)) for c in ("key", "line", "histogram")]
        if not len(cols[0]):
            continue
        if centres is not None:
            go_on = int(np.searchsorted(-((cols[0] & -2) == goes_on).astype(np.int8), 0))  # noqa: F821
            if go_on:
                yield from large([c[:go_on] for c in cols])
            if go_on == len(cols[0]):
                continue
            cols, centres = [c[go_on:] for c in cols], None
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
        key = cols[0] & -2
        cut = len(key) - int((key == key[-1]).sum())
        held = [c[cut:] for c in cols]
        yield from _out(list(_buckets([c[:cut] for c in cols], bucket)))
        if len(held[0]) > FEW:
            goes_on = key[-1]
            first, at = np.unique(held[1][held[0] & 1 == INDEXED], return_index=True)
            order = np.argsort(at)[:CENTRES]
            centres = (first[order].view(K.U64), held[2][held[0] & 1 == INDEXED][at[order]].view(K.U64))
            if len(centres[0]):
                yield from large(held)
                held = None
            else:
                centres = None  # probes that no index row can meet, as index rows come first
                held = [c[:1] for c in held]
    if held is not None:
        yield from _out(list(_buckets(held, bucket)))


def _buckets(cols: list[np.ndarray], bucket) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each bucket that has both sides and more than one line."""
    if not len(cols[0]):
        return
    key, side = cols[0] & -2, cols[0] & 1
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    stop = np.append(head[1:], len(key))
    probes = np.add.reduceat((side == PROBED).astype(np.int64), head)
    other = np.maximum.reduceat(cols[1], head) != np.minimum.reduceat(cols[1], head)
    ok = (probes > 0) & (stop - head > probes) & other
    for a, b in zip(head[ok].tolist(), stop[ok].tolist(), strict=True):
        yield from bucket([c[a:b] for c in cols])


PARTS = "key long, line long, histogram long, edits int, less int, rest binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets (PARTS, and the bytes that the bucket has in common at both ends: head, tail) with a segment of their rest taken out: rows of finer buckets.

    An index row has each segment of its rest, a probe row, `less` bytes longer, each place at which such a segment can lie.
    A rest of fewer than k + 1 bytes is cut into single bytes, sought at any place; probe rows with up to k bytes left are certain.
    """
    for batch in batches:
        buf, offs = K.texts(batch.column("rest"))
        cols = [np.asarray(batch.column(c)) for c in ("key", "line", "histogram", "edits", "less", "head", "tail")]
        for a, b in K.slices(offs):
            part, at = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            key, line, hist, edits, less, head, tail = (c[a:b] for c in cols)
            start, n = at[:-1] + head, np.diff(at) - head - tail
            short, probe = n - less, (key & 1) == PROBED
            prefix, raw, out = K.raw(part), part.tobytes(), []
            for k in range(1, EDITS + 1):
                for i in range(k + 1):
                    own = np.flatnonzero((edits == k) & (i < np.minimum(k + 1, short)) & ~(probe & (n <= k)))
                    place, size = segments(short[own], i, np.minimum(k + 1, short[own]))
                    for move in range(-k, 2 * k + 1):
                        p = place + move
                        ok = (p >= 0) & (p + size <= n[own]) & np.where(probe[own], (short[own] <= k) | ((abs(move) <= i) & (np.abs(move - less[own]) <= k - i)), move == 0)
                        if ok.any():
                            row, from_, wide = own[ok], start[own[ok]] + p[ok], size[ok]
                            finer = K.mix(K.span(prefix, from_, wide) * K.PLACES[1] + (key[row] & -2).view(K.U64) * K.PLACES[2] + K.U64(i))
                            out.append((row, from_, wide, (finer & ~K.U64(1)) | probe[row].astype(K.U64)))
            if not out:
                continue
            row, from_, wide, finer = (np.concatenate(c) for c in zip(*out, strict=True))
            begin, end = start[row], (start + n)[row]
            rest = [raw[x:y] + raw[z:e] for x, y, z, e in zip(begin.tolist(), from_.tolist(), (from_ + wide).tolist(), end.tolist(), strict=True)]
            yield pa.record_batch([pa.array(finer.view(np.int64)), pa.array(line[row]), pa.array(hist[row]), pa.array(edits[row]), pa.array(less[row]), pa.array(rest, pa.binary())], ["key", "line", "histogram", "edits", "less", "rest"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes that all rests of a bucket have in common at the start and the end, which are those of the least and the greatest of them."""

    def common(x: str, y: str) -> int:
        n = min(len(x), len(y))
        differ = np.flatnonzero(np.frombuffer(x[:n].encode(), np.uint8) != np.frombuffer(y[:n].encode(), np.uint8))
        return (int(differ[0]) if len(differ) else n) // 2

    for batch in batches:
        b = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        head = [min(common(x, y), r) for x, y, r in zip(b["lo"], b["hi"], b["short"], strict=True)]
        tail = [min(common(x, y), r - h) for x, y, r, h in zip(b["end_lo"], b["end_hi"], b["short"], head, strict=True)]
        yield pa.record_batch([batch.column("bucket"), pa.array(head, pa.int32()), pa.array(tail, pa.int32())], ["bucket", "head", "tail"])


def within(a: list[bytes], b: list[bytes], edits: int = EDITS) -> np.ndarray:
    """Whether each pair is within `edits` edits: bit-parallel columns of the band of 2 * edits + 1 diagonals."""
    n = len(a)
    if not n:
        return np.zeros(0, dtype=bool)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    short, long = np.where(la <= lb, la, lb), np.where(la <= lb, lb, la)
    width, band = int(long.max()), 2 * edits + 1
    pattern = np.full((width + 2 * band, n), 256, np.int16)  # the shorter, shifted by `edits`, beyond it a byte that equals none
    text = np.full((width, n), 257, np.int16)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        pattern[edits : edits + len(x), k] = np.frombuffer(x, np.uint8)
        text[: len(y), k] = np.frombuffer(y, np.uint8)
    full = (1 << band) - 1
    # Bit k of column j stands for row j - edits + k; rows up to 0 hold j, so they have no vertical difference.
    plus = np.full(n, full >> edits << edits, np.int64)
    minus = np.zeros(n, np.int64)
    score = np.full(n, edits, np.int64)
    final = np.full(n, edits + 1, np.int64)
    for j in range(1, width + 1):
        equal = np.zeros(n, np.int64)
        for k in range(band):
            equal |= (pattern[j - 1 + k] == text[j - 1]).astype(np.int64) << k
        zero = ((((equal & plus) + plus) ^ plus) | equal | minus) & full
        up = (minus | ~(zero | plus)) & full
        down = zero & plus
        # down the lowest diagonal until it is in the last row, then along that row
        last = short - j + edits
        along = (up >> np.clip(last, 0, band) & 1) - (down >> np.clip(last, 0, band) & 1)
        score += np.where(j <= short - edits, 1 - (zero >> (band - 1) & 1), along)
        plus = (down | ~(zero >> 1 | up)) & full
        minus = (zero >> 1) & up
        final = np.where(long == j, score, final)
    return (long - short <= edits) & (final <= edits)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        order = sorted(range(len(a)), key=lambda i: len(a[i]))
        ok = np.zeros(len(a), dtype=bool)
        at = 0
        while at < len(order):
            stop = at
            while stop < len(order) and (stop == at or (stop - at + 1) * (len(a[order[stop]]) + EDITS) <= 1 << 21):
                stop += 1
            for edits in range(1, EDITS + 1):
                some = [i for i in order[at:stop] if allowed(min(len(a[i]), len(b[i]))) == edits]
                ok[some] = within([a[i] for i in some], [b[i] for i in some], edits)
            at = stop
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked lines of each document."""
    for batch in batches:
        buf, offs = K.texts(batch.column("text"))
        raw = buf.tobytes()
        out: tuple[list, list] = ([], [])
        for i, own in enumerate(batch.column("asked")):
            parts = raw[offs[i] : offs[i + 1]].split(b"\n")
            for place, line in zip(own.values.field("place").to_pylist(), own.values.field("line").to_pylist(), strict=True):
                if place < len(parts):
                    out[0].append(line)
                    out[1].append(parts[place])
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["line", "bytes"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = K.texts(batch.column("text"))
        raw = buf.tobytes()
        out: list[list] = [[], [], [], []]
        for i, gone in enumerate(batch.column("gone").to_pylist()):
            parts = raw[offs[i] : offs[i + 1]].split(b"\n")
            drop = {p for p in gone or () if p < len(parts)}
            kept = b"\n".join(p for k, p in enumerate(parts) if k not in drop) if drop else raw[offs[i] : offs[i + 1]]
            for c, v in zip(out, (len(parts) if offs[i + 1] > offs[i] else 0, len(drop), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")), strict=True):
                c.append(v)
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_lines", "n_removed", "kept_sha256", "kept"])


def bytes_of(own: DataFrame, first: DataFrame, wanted: DataFrame) -> DataFrame:
    """line, bytes of the lines wanted (line). own: doc, text; first: line, at (doc, place)."""
    asked = first.join(wanted, "line", "left_semi").groupBy(F.col("at.doc").alias("doc")).agg(F.collect_list(F.struct(F.col("at.place").alias("place"), "line")).alias("asked"))
    got = in_arrow(own.select("doc", "text").join(asked, "doc"), _fetch, "line long, bytes binary")
    # Another version of a document has another line there: the hash of the bytes is not asked for, the first place is.
    return written(got.groupBy("line").agg(F.min("bytes").alias("bytes")))


def verified(own: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of lines those that are near. own: doc, text; first: line, at (doc, place)."""
    got = bytes_of(own, first, pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct())
    full = pairs.join(got.select(F.col("line").alias("a"), F.col("bytes").alias("x")), "a").join(got.select(F.col("line").alias("b"), F.col("bytes").alias("y")), "b")
    return written(in_arrow(full.select("a", "b", "x", "y"), _verify, "a long, b long"))


def _bucket() -> Column:
    return F.col("key").bitwiseAND(F.lit(-2))


def met_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: key, line, histogram -> pairs (a, b) of small buckets and with the centres of large ones; line, histogram, bucket of the large ones."""
    met = written(in_arrow(rows.select("key", "line", "histogram").repartition(_bucket()).sortWithinPartitions("key"), _meet, MET))
    return met.filter("key = 0").select("a", "b").distinct(), met.filter("key <> 0").select(F.col("a").alias("line"), F.col("b").alias("histogram"), _bucket().alias("bucket"))


def open_buckets(rest: DataFrame, found: DataFrame) -> DataFrame:
    """The buckets of `rest` (line, bucket) that hold lines of more than one component; found: v, component."""
    told = rest.select("line", "bucket").join(found.withColumnRenamed("v", "line"), "line", "left").withColumn("component", F.coalesce("component", "line"))
    return told.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that found (v, component) does not connect."""
    side = lambda k: found.select(F.col("v").alias(k), F.col("component").alias(f"_{k}"))
    told = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return told.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def refined(own: DataFrame, first: DataFrame, rest: DataFrame, near: DataFrame, tried: DataFrame) -> DataFrame:
    """Links of the lines of large buckets (rest: line, histogram, bucket) beside `near`, enough to connect what is connected; tried: pairs verified before.

    The lines of buckets that are not connected are cut anew from the whole line on, level by level; each level's rests are
    shorter by a segment, so the levels are logarithmic in the length. Every level is a written table.
    """
    found = components(near)
    wanted = written(rest.join(open_buckets(rest, found), "bucket", "left_semi").select("line", "histogram").distinct())
    if not wanted.limit(1).count():
        return near
    # Each of these lines is a document of its own from here on.
    lines = written(bytes_of(own, first, wanted.select("line")).join(wanted, "line"))
    alone, at = lines.select(F.col("line").alias("doc"), F.col("bytes").alias("text")), lines.select("line", F.struct(F.col("line").alias("doc"), F.lit(0).cast("long").alias("place")).alias("at"))
    sides = [(INDEXED, 0), *((PROBED, less) for less in range(EDITS + 1))]
    rows = lines.select("line", "histogram", "bytes", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(n).alias("less")) for s, n in sides])).alias("_s")).select("*", (F.octet_length("bytes") - F.col("_s.less")).alias("short"))
    edits = F.least(F.floor(F.col("short") / BYTES_AN_EDIT), F.lit(EDITS)).cast("int")
    root = F.xxhash64("short").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("_s.side").cast("long"))
    rows = rows.select(root.alias("key"), "line", "histogram", edits.alias("edits"), F.col("_s.less").alias("less"), F.col("bytes").alias("rest"), F.lit(0).alias("head"), F.lit(0).alias("tail")).filter("edits >= 1 AND less <= edits")
    while True:
        parts = written(in_arrow(rows, _cut, PARTS))
        pairs, rest = met_rows(parts)
        pairs = written(apart(pairs, found).join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        links = verified(alone, at, pairs)
        if links.limit(1).count():
            near = near.union(links)
            found = components(near)
        open_ = written(open_buckets(rest, found))
        if not open_.limit(1).count():
            return near
        inside = written(joined(parts.withColumn("bucket", _bucket()), open_, ["bucket"]))
        text = F.hex("rest")
        facts = inside.groupBy("bucket").agg(F.min(text).alias("lo"), F.max(text).alias("hi"), F.min(F.reverse(text)).alias("end_lo"), F.max(F.reverse(text)).alias("end_hi"), F.min(F.octet_length("rest") - F.col("less")).alias("short"))
        rows = joined(inside, written(in_arrow(facts, _common, "bucket long, head int, tail int")), ["bucket"]).drop("bucket")


def links(own: DataFrame, first: DataFrame) -> DataFrame:
    """a, b: hashes of different lines that are near, enough to connect what is connected. own: doc, text; first: line, at (doc, place)."""
    pairs, rest = met_rows(in_arrow(own.select("doc", "text"), _keys, "key long, line long, histogram long"))
    pairs = written(pairs)
    near = verified(own, first, pairs)
    return refined(own, first, rest, near, pairs) if rest.limit(1).count() else near


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256, kept (the text without the removed lines); one row a document."""
    own = numbered(docs)
    seen = written(in_arrow(own.select("doc", "text"), _occurrences, "doc long, place long, line long"))
    first = written(seen.groupBy("line").agg(F.min(F.struct("doc", "place")).alias("at"), F.count("*").alias("c")))
    found = components(links(own, first)).withColumnRenamed("v", "line")
    heads = first.join(found, "line").groupBy("component").agg(F.min("at").alias("head"))
    classed = found.join(heads, "component").select("line", "head")
    judged = first.join(classed, "line", "left").select("line", F.coalesce("head", "at").alias("head"), "c", "at").filter((F.col("c") > 1) | (F.col("head") != F.col("at")))
    gone = joined(seen, judged.select("line", "head"), ["line"]).filter(F.struct("doc", "place") != F.col("head")).groupBy("doc").agg(F.collect_set("place").alias("gone"))
    kind = dict(docs.dtypes)["doc_id"]
    return in_arrow(own.join(gone, "doc", "left").select("doc_id", "text", "gone"), _keep, f"doc_id {kind}, n_lines long, n_removed long, kept_sha256 string, kept string")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
