"""Works made of other works: concatenation cover, edges, candidate filters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.edits import substring_edits
from inkwell.functions.hashing import nfkc
from inkwell.functions.text import letters_only, same_hit, squeeze
from inkwell.operators.ranking import renumbered
from inkwell.plans.ship import ship
from inkwell.sources.tables import cut

PREFIX, MIN_PIECE = 12, 24
#: Segments of items that are broadcast; more are joined by shuffle.
MAX_BROADCAST = 200_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row, also where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def _grams(c: Column, size: int) -> Column:
    """Hashes of the substrings of `size` characters at each place; the text is cut into characters once, so this is linear."""
    return _let(F.split(c, ""), lambda chars: F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(chars, i, size))))


#: Texts of so many characters are hashed together. Lengths of pieces known by one longer window: from each up to STEP times it.
CHUNK, STEP, CLASSES = 1 << 19, 4, 8
#: Bits of the filter of the pieces' keys: so many a key, and at most (64 MB).
BITS, MOST_BITS = 64, 1 << 29
_BASE, _ODD = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_POWERS: dict[int, np.ndarray] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of an odd number modulo 2^64, kept for the next call."""
    if len(_POWERS.get(base, ())) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        _POWERS[base] = np.cumprod(held, dtype=np.uint64)
    return _POWERS[base][:n]


def _sums(c: np.ndarray) -> np.ndarray:
    """Running sums of the code points times powers of the base, on the last axis, from 0."""
    out = np.zeros((*c.shape[:-1], c.shape[-1] + 1), np.uint64)
    np.cumsum(c * _powers(_BASE, c.shape[-1]), axis=-1, dtype=np.uint64, out=out[..., 1:])
    return out


def _windows(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the substrings of `size` code points at the places `at`: what the sums gained there, divided by the power of the place."""
    lowest = _powers(pow(_BASE, -1, 1 << 64), sums.shape[-1])
    rows = () if sums.ndim == 1 else (np.arange(len(sums)) if at.ndim == 1 else slice(None),)
    return (sums[(*rows, at + size)] - sums[(*rows, at)]) * lowest[at]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _low(h: np.ndarray) -> np.ndarray:
    """The upper halves of hashes with the places below, so that of equal ones the first is the least."""
    return (_mixed(h) & np.uint64(0xFFFFFFFF00000000)) | np.arange(h.shape[-1], dtype=np.uint64)


def _keys(h: np.ndarray, author: np.ndarray, kind: int) -> np.ndarray:
    return _mixed(_mixed(h) + author + np.uint64(kind)).view(np.int64)


def _of_pieces(heads: list[str], author: np.ndarray, kind: int, size: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and lead of beginnings of one length: the lead is the place of the least hash of `size` characters in the first `span`, the key the hash of what follows."""
    sums = _sums(_points("".join(heads)).reshape(len(heads), -1))
    places = np.arange(span - size + 1)
    grams = (sums[:, size : span + 1] - sums[:, : span - size + 1]) * _powers(pow(_BASE, -1, 1 << 64), len(places))
    lead = _low(grams).argmin(axis=1)
    return _keys(_windows(sums, lead, sums.shape[1] - 1 - span + size), author, kind), lead.astype(np.int32)


def _of_hosts(texts: list[str], author: np.ndarray, windows: list[int], size: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, place and key of each anchor, for each window that ends within the text; whether it is the text's own key as a piece."""
    c, sizes = _points("".join(texts)), np.array([len(t) for t in texts])
    if len(c) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(texts)), sizes)
    sums = _sums(c)
    low, done = _low(_windows(sums, np.arange(len(c) - size + 1), size)), 1
    width = span - size + 1
    while 2 * done <= width:
        low, done = np.minimum(low[:-done], low[done:]), 2 * done
    if done < width:
        low = np.minimum(low[: len(low) - width + done], low[width - done :])
    at = (low[of[: len(low)] == of[span - 1 :]] & np.uint64(0xFFFFFFFF)).astype(np.int64)  # ascending
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    first, out = np.concatenate([[True], of[at][1:] != of[at][:-1]]) if len(at) else np.zeros(0, bool), []
    kinds = np.searchsorted([w - size + span for w in windows], sizes, "right") - 1
    for kind, window in enumerate(windows):
        fit = at + window <= ends[of[at]]
        held = at[fit]
        out.append((of[held], (held - (ends - sizes)[of[held]]).astype(np.int32), _keys(_windows(sums, held, window), author[of[held]], kind), first[fit] & (kinds[of[held]] == kind)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bits(keys: DataFrame) -> tuple[np.ndarray, int, np.ndarray]:
    """A filter of the keys (k), one bit each, built in segments: its bytes, by how many bits a key is shifted to its place, and the bytes of places met twice."""
    n = min(MOST_BITS, 1 << max(16, (BITS * keys.count()).bit_length()))
    shift = 65 - n.bit_length()
    part = n // 64

    def filled(table: pa.Table) -> pa.Table:
        at = np.asarray(table.column("i"))
        held, twice = np.zeros(part, bool), np.zeros(part, bool)
        places, times = np.unique(at % part, return_counts=True)
        held[places], twice[places[times > 1]] = True, True
        packed = [pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary()) for x in (held, twice)]
        return pa.table({"s": pa.array([int(at[0]) // part], pa.int64()), "b": packed[0], "t": packed[1]})

    places = keys.select(F.shiftrightunsigned("k", shift).alias("i"))
    rows = places.groupBy(F.floor(F.col("i") / part)).applyInArrow(filled, "s long, b binary, t binary").toLocalIterator()
    out, again = np.zeros(n // 8, np.uint8), np.zeros(n // 8, np.uint8)
    for r in rows:
        at = slice(r["s"] * part // 8, (r["s"] + 1) * part // 8)
        out[at], again[at] = np.frombuffer(r["b"], np.uint8), np.frombuffer(r["t"], np.uint8)
    return out, shift, again


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of CHUNK characters or one row."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > CHUNK:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _print(c: Column) -> Column:
    """The first 64 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 16), 16, -10).cast("long")


def _printed(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big", signed=True)


def _only(df: DataFrame, key: str, bits: tuple[np.ndarray, int, np.ndarray], hashed: bool = False) -> DataFrame:
    """Rows whose key passes the filter; the keys' hashes alone go to Python."""
    held, shift = df.sparkSession.sparkContext.broadcast(bits[0]), bits[1]

    @F.pandas_udf("boolean")
    def fits(k: pd.Series) -> pd.Series:
        return pd.Series(_fits(held.value, k.to_numpy(), shift))

    return df.filter(fits(F.col(key) if hashed else F.xxhash64(key)))


def _fits(bits: np.ndarray, keys: np.ndarray, shift: int) -> np.ndarray:
    i = keys.view(np.uint64) >> np.uint64(shift)
    return (bits[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 == 1


def occurrences(works: DataFrame, min_piece: int = MIN_PIECE, prefix: int = PREFIX, once: bool = False, told: tuple[str, ...] = ()) -> DataFrame:
    """host, pos, end, member, len: places in a host at which a shorter work of its author stands in full. once: of works
    with equal texts (and equal columns `told`, which come with the result) the least stands for all.

    Of any `min_piece` characters the least hash of `prefix` characters is their anchor. A work is known by the anchor of its
    beginning and the hash of what follows it, up to the largest of the lengths min_piece * 4^i that it has, a host by those
    of all its anchors (about one in seven places) that pass a filter of the works' keys; so wherever the work stands the two
    meet. A key of one work brings that work's print (the first 64 bits of its MD5), which is compared with that of the host's
    stretch; a key of more brings their lengths, each once however many works have them, and the prints of the stretches and of the
    works are joined. So no text travels with a pair, and what stands for a text is its key, length and print, 128 bits of hashes.
    Works that are of the host's length or longer are no members.
    """
    spark = works.sparkSession
    ship(spark)
    works = works.filter(F.coalesce("author", F.lit("")) != "").select("author", "work_id", "content", *told)
    kinds = dict(works.dtypes)
    lengths = [min_piece * STEP**i for i in range(CLASSES)]
    windows = [n - min_piece + prefix for n in lengths]
    n = F.char_length("content")
    kind = reduce(lambda c, x: F.when(n >= x[1], F.lit(x[0])).otherwise(c), enumerate(lengths), F.lit(-1))
    length = reduce(lambda c, x: F.when(n >= x, F.lit(x)).otherwise(c), lengths, F.lit(0))
    sized = works.filter(n >= min_piece).select(F.xxhash64("author").alias("_a"), F.col("work_id").alias("member"), n.alias("n"), _print(F.col("content")).alias("d"), kind.alias("_kind"), F.substring("content", F.lit(1), length).alias("_s"), *told)
    keep = ["member", "n", "d", *told]

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            author, of, heads = np.asarray(batch.column("_a")).view(np.uint64), np.asarray(batch.column("_kind")), batch.column("_s").to_pylist()
            keys, lead = np.zeros(len(of), np.int64), np.zeros(len(of), np.int32)
            for k in np.unique(of):
                rows = np.flatnonzero(of == k)
                step = max(1, CHUNK // lengths[k])
                for a in range(0, len(rows), step):
                    i = rows[a : a + step]
                    keys[i], lead[i] = _of_pieces([heads[x] for x in i], author[i], int(k), prefix, min_piece)
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(keys), pa.array(lead)], [*keep, "k", "lead"])

    pieces = sized.mapInArrow(leads, ", ".join(f"`{c}` {dict(sized.dtypes)[c]}" for c in keep) + ", k long, lead int")
    if once:
        pieces = pieces.groupBy("n", "d", "k", "lead", *told).agg(F.min("member").alias("member"))
    pieces = cut(pieces)
    bits, shift, again = _bits(pieces)
    held = spark.sparkContext.broadcast((bits, again))
    hosts = works.filter(n >= 2 * min_piece).select(F.col("work_id").alias("host"), "author", "content")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, again = held.value
        for batch in batches:
            ids, author, text, size = batch.column("host"), np.asarray(batch.column("_a")).view(np.uint64), batch.column("content"), np.asarray(batch.column("len"))
            for a, b in _chunks(size):
                rows, at, keys, own = _of_hosts(text.slice(a, b - a).to_pylist(), author[a:b], windows, prefix, min_piece)
                # A text's own key counts only if another has it.
                fit = _fits(bits, keys, shift) & (~own | _fits(again, keys, shift))
                rows = rows[fit] + a
                yield pa.record_batch([ids.take(pa.array(rows)), pa.array(size[rows]), pa.array(at[fit]), pa.array(keys[fit])], ["host", "len", "at", "k"])

    id_kind = kinds["work_id"]
    starts = hosts.select("host", F.xxhash64("author").alias("_a"), "content", n.alias("len")).mapInArrow(anchors, f"host {id_kind}, len int, at int, k long")
    starts = cut(starts)
    one = F.struct("lead", "n", "d", "member", *told)
    wanted = pieces.groupBy("k").agg(F.min(one).alias("one"), F.count("*").alias("_c"), F.collect_set(F.struct("lead", "n")).alias("w"))
    wanted = wanted.select("k", F.when(F.col("_c") == 1, F.col("one")).alias("one"), F.when(F.col("_c") > 1, F.col("w")).alias("w"))
    met = starts.join(wanted, "k")
    begins = lambda x: F.col("at") - x["lead"]
    fits = lambda x: (begins(x) >= 0) & (x["n"] < F.col("len")) & (begins(x) + x["n"] <= F.col("len"))
    span = lambda x, d, m: F.struct(begins(x).alias("pos"), x["n"].alias("n"), F.col("k").alias("k"), d.alias("d"), m.alias("m"))
    own = F.struct(F.col("one.member").alias("member"), *[F.col(f"one.{t}").alias(t) for t in told])
    none = F.lit(None).cast(f"struct<member:{id_kind}{''.join(f',{t}:{kinds[t]}' for t in told)}>")
    lone = met.filter("one IS NOT NULL").filter(fits(F.col("one"))).select("host", "len", span(F.col("one"), F.col("one.d"), own).alias("s"))
    many = met.filter("one IS NULL").withColumn("x", F.explode("w")).filter(fits(F.col("x"))).select("host", "len", span(F.col("x"), F.lit(None).cast("long"), none).alias("s"))
    lists = lone.unionByName(many).groupBy("host").agg(F.max("len").alias("len"), F.collect_list("s").alias("s"))
    asked = _bits(starts.select(F.xxhash64("host").alias("k")).distinct())
    whole = lists.join(_only(hosts.select("host", "content"), "host", asked), "host")
    m_kind = whole.schema["s"].dataType.elementType["m"].dataType.simpleString()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                lists = batch.column("s")
                each, of = lists.flatten(), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                at, size, told_d = (each.field(c).to_pylist() for c in ("pos", "n", "d"))
                texts = batch.column("content").to_pylist()
                found = [_printed(texts[i][p : p + z]) for i, p, z in zip(of, at, size, strict=True)]
                # Those that were told a print are settled here.
                keep = pa.array([i for i, (d, t) in enumerate(zip(found, told_d, strict=True)) if t is None or t == d], pa.int64())
                rows = batch.column("host").take(pa.array(of)).take(keep), batch.column("len").take(pa.array(of)).take(keep)
                yield pa.record_batch([*rows, *[each.field(c).take(keep) for c in ("pos", "n", "k")], pa.array(found, pa.int64()).take(keep), each.field("m").take(keep)], ["host", "len", "pos", "n", "k", "d", "m"])

    full = cut(whole.mapInArrow(compared, f"host {id_kind}, len int, pos int, n int, k long, d long, m {m_kind}"))
    out = ["host", "pos", (F.col("pos") + F.col("n")).alias("end"), "member", "len", *told]
    open_ = full.filter("m IS NULL").drop("m")
    settled = full.filter("m IS NOT NULL").select("*", "m.*").select(*out)
    return settled.unionByName(open_.join(_only(pieces.drop("lead"), "k", _bits(open_.select("k").distinct()), True), ["k", "n", "d"]).select(*out))


def _walked(found: DataFrame, walk: Callable[[list, int], list[tuple]], schema: str) -> DataFrame:
    """walk(places of a host as (pos, end, member), its length) gives rows without the host; a host is one row, many are a batch."""
    kind = dict(found.dtypes)["host"]
    lists = found.groupBy("host").agg(F.max("len").alias("len"), F.collect_list(F.struct("pos", "end", "member")).alias("p"))
    ship(found.sparkSession)
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, (places, size) in enumerate(zip(batch.column("p"), batch.column("len").to_pylist(), strict=True)):
                got = walk([(x["pos"], x["end"], x["member"]) for x in places.as_py()], size)
                rows += [i] * len(got)
                out += got
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.record_batch([batch.column("host").take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, [_ARROW.get(x.split(" ")[1], batch.schema.field("p").type.value_type.field("member").type) for x in schema.split(", ")], strict=True)]], ["host", *names])

    return lists.mapInArrow(run, f"host {kind}, {schema}")


_ARROW = {"int": pa.int32(), "double": pa.float64()}


def covers(works: DataFrame, min_piece: int = MIN_PIECE) -> DataFrame:
    """host, member_order, member, start, end: hosts that are a concatenation of two or more works of their author.

    From position 0 the reachable ends are followed in ascending order; the first piece (by place of its
    start, then member) that reaches an end is the one that counts.
    """
    # A host's occurrences meet in one row: as many as a text has places for works of 24 characters or more. Equal texts
    # reach the same ends, so the least of them is found alone.
    def walk(places: list, size: int) -> list[tuple]:
        ends: dict[int, tuple[int, object]] = {}
        reached = {0}
        # By place, so a place is known to be reached before the works that begin there are seen.
        for pos, member, end in sorted((p, m, e) for p, e, m in places):
            if pos in reached and end not in reached:
                reached.add(end)
                ends[end] = (pos, member)
        out, p = [], size
        if p in ends:
            while p:
                q, member = ends[p]
                out.append((member, q, p))
                p = q
        return [(i, m, s, e) for i, (m, s, e) in enumerate(out[::-1])] if len(out) > 1 else []

    kind = dict(works.dtypes)["work_id"]
    return _walked(occurrences(works, min_piece, once=True), walk, f"member_order int, member {kind}, start int, end int")


def normalised(works: DataFrame) -> DataFrame:
    """works with content in NFKC and of letters and digits only."""
    return works.withColumn("content", letters_only(nfkc(works.sparkSession)(F.col("content"))))


def normalised_covers(works: DataFrame, known: DataFrame | None = None, min_piece: int = MIN_PIECE) -> DataFrame:
    """covers() of the normalised texts, without the hosts (host) that are known and those that are covers as they stand."""
    out = covers(normalised(works), min_piece).join(covers(works, min_piece).select("host").distinct(), "host", "left_anti")
    return out if known is None else out.join(known, "host", "left_anti")


def greedy_cover(works: DataFrame, least: float = 0.8, min_piece: int = MIN_PIECE, signal: str | None = None) -> DataFrame:
    """host, part, member, start, end, coverage: hosts that hold two or more other works of their author, walked from the left:
    at each place the longest work (the smallest id of equals) is taken and the walk goes on at its end. Hosts are returned if
    `least` of their length is covered. `signal` names a boolean column: a work counts only if it, or the host, has it."""
    found = occurrences(works, min_piece, once=True, told=(signal,) if signal else ())
    if signal:
        found = found.join(works.select(F.col("work_id").alias("host"), F.col(signal).alias("_h")), "host").filter(F.col(signal) | F.col("_h")).drop(signal, "_h")

    def walk(places: list, size: int) -> list[tuple]:
        at, out = 0, []
        for pos, end, member in sorted((p, -e, m) for p, e, m in places):
            if pos >= at:
                out.append((member, pos, -end))
                at = -end
        share = sum(e - p for _, p, e in out) / size
        share = int(share * 10000 + 0.5) / 10000 if len(out) > 1 and share >= least else None  # halves up, as SQL rounds
        return [(i, m, p, e, share) for i, (m, p, e) in enumerate(out)] if share is not None else []

    kind = dict(works.dtypes)["work_id"]
    return _walked(found, walk, f"part int, member {kind}, start int, end int, coverage double")


def composition_filter(candidates: DataFrame, edges: DataFrame, aliases: DataFrame, current: str, k: int, pool: int = 32) -> DataFrame:
    """Candidates (query_id, rank, work_id, text; `current` is a column of the current text) without the collections
    that hold the current work or another candidate with the same hit; then the first k, renumbered."""
    pooled = candidates.filter(F.col("rank") <= pool)
    own = edges.join(aliases, edges["member_work_id"] == aliases["alias"]).select("query_id", F.col("parent_work_id").alias("work_id")).distinct()
    by_self = pooled.join(own, ["query_id", "work_id"]).filter(same_hit(F.col("text"), F.col(current))).select("query_id", "work_id")
    left = pooled.join(by_self, ["query_id", "work_id"], "left_anti")
    # Pairs are found by ids; a collection's text is then met once, with the members' hits in a list of `pool` at most, and squeezed once.
    ids = left.select("query_id", "work_id")
    pairs = ids.join(edges.withColumnRenamed("parent_work_id", "work_id"), "work_id").join(ids.withColumnRenamed("work_id", "member_work_id"), ["query_id", "member_work_id"])
    members = left.select("query_id", F.col("work_id").alias("member_work_id"), squeeze(F.col("text")).alias("_m"))
    lists = pairs.join(members, ["query_id", "member_work_id"]).groupBy("query_id", "work_id").agg(F.collect_set("_m").alias("_l"))
    met = lists.join(left.select("query_id", "work_id", squeeze(F.col("text")).alias("_t")), ["query_id", "work_id"])
    same = lambda m: (F.least(F.char_length("_t"), F.char_length(m)) >= 6) & (F.contains("_t", m) | F.contains(m, F.col("_t")))
    by_member = met.filter(F.exists("_l", same)).select("query_id", "work_id")
    return renumbered(left.join(by_member, ["query_id", "work_id"], "left_anti").withColumnRenamed("rank", "pool_rank"), ["query_id"], "pool_rank").filter(F.col("rank") <= k)


def validated_edges(edges: DataFrame, works: DataFrame) -> DataFrame:
    """Edges with start and end by running lengths, and whether each member's text stands there and the last end is the host's."""
    ship(works.sparkSession)
    size = F.char_length("content")
    members = works.select(F.col("work_id").alias("member_work_id"), size.alias("n"), _print(F.col("content")).alias("d"))
    edges = cut(edges.select("parent_work_id", "member_work_id", "member_order"))
    each = F.struct("member_order", "member_work_id", "n", "d")
    lists = edges.join(members, "member_work_id", "left").groupBy("parent_work_id").agg(F.array_sort(F.collect_list(each)).alias("e"))
    # A host's text is read once, with all of its edges.
    hosts = _only(works.select(F.col("work_id").alias("parent_work_id"), "content"), "parent_work_id", _bits(edges.select(F.xxhash64("parent_work_id").alias("k")).distinct()))
    held = lists.join(hosts, "parent_work_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                lists = batch.column("e")
                each, of = lists.flatten(), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                out, texts, at = [], batch.column("content").to_pylist(), 0
                sizes, prints = each.field("n").to_pylist(), each.field("d").to_pylist()
                for text, length in zip(texts, lists.value_lengths().to_pylist(), strict=True):
                    n, d = sizes[at : at + length], prints[at : at + length]
                    ends, end = [], None
                    for x in n:
                        end = end if x is None else (end or 0) + x
                        ends.append(end)
                    whole_host = text is not None and end == len(text)
                    out += [(None if x is None else e - x, e, bool(whole_host and x is not None and _printed(text[e - x : e]) == p)) for x, e, p in zip(n, ends, d, strict=True)]
                    at += length
                start, end, valid = zip(*out, strict=True) if out else ((), (), ())
                parts = [each.field(c) for c in ("member_work_id", "member_order")]
                yield pa.record_batch([batch.column("parent_work_id").take(pa.array(of)), *parts, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(valid, pa.bool_())], ["parent_work_id", "member_work_id", "member_order", "start", "end", "valid"])

    types = dict(edges.dtypes)
    return held.mapInArrow(run, f"parent_work_id {types['parent_work_id']}, member_work_id {types['member_work_id']}, member_order {types['member_order']}, start long, end long, valid boolean")


def containing(docs: DataFrame, items: DataFrame, key: str, item: str, most: int = 3) -> DataFrame:
    """key, item: pairs whose text may hold the item's with `most` edits or fewer. The item's letters are split into most + 1 segments;
    an item within the edits leaves one of them whole, so every such pair, and every exact or normalised one, shares a segment.
    Segments are met by hash at each place of a text; items too short for segments of 6 letters are met by the whole of them."""
    letters = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    part = items.select(item, letters(F.col("text")).alias("_p")).filter("_p <> ''").withColumn("_n", F.char_length("_p"))
    count = F.when(F.col("_n") >= 6 * (most + 1), F.lit(most + 1)).otherwise(F.lit(1))
    cut = lambda i: F.floor(F.col("_n") * i / F.col("_c")).cast("int")
    segments = part.withColumn("_c", count).select(item, "_p", F.explode(F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda i: F.struct(cut(i).alias("at"), (cut(i + 1) - cut(i)).alias("size")))).alias("s")).select(item, F.substring(F.col("_p"), F.col("s.at") + 1, F.col("s.size")).alias("_q"))
    # A text meets the first letters of segments, of one length for all; what meets is compared in full before it counts.
    width = segments.agg(F.min(F.char_length("_q"))).first()[0]
    if width is None:
        return docs.select(key).limit(0).crossJoin(items.select(item).limit(0))
    width = min(width, 12)
    segments = segments.select(item, "_q", _grams(F.substring("_q", 1, width), width)[0].alias("_h"))
    texts = docs.select(key, letters(F.col("text")).alias("_t")).filter(F.char_length("_t") >= width)
    starts = texts.select(key, F.explode(F.array_distinct(_grams(F.col("_t"), width))).alias("_h"))
    small = segments.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    met = starts.join(F.broadcast(segments) if small else segments, "_h").select(key, item, "_q")
    return met.join(texts, key).filter(F.contains("_t", F.col("_q"))).select(key, item).distinct()


def containment(pairs: DataFrame, most: int = 3) -> DataFrame:
    """pairs: id, text, part -> id, kind: `exact` (24 characters or more), `normalized` (24 letters or more), `near`
    (40 letters or more, edits), or `none`. Only pairs that the cheap tests leave open reach the edit distance."""
    ship(pairs.sparkSession)
    letters = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    t = pairs.withColumn("_t", letters(F.col("text"))).withColumn("_p", letters(F.col("part")))
    cheap = F.when((F.char_length("part") >= 24) & F.contains("text", F.col("part")), "exact").when((F.char_length("_p") >= 24) & F.contains("_t", F.col("_p")), "normalized").when(F.char_length("_p") < 40, "none")
    t = t.withColumn("kind", cheap)

    def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            edits = substring_edits(part["_t"].tolist(), part["_p"].tolist())
            yield pd.DataFrame({"id": part["id"], "kind": ["near" if e <= most else "none" for e in edits]})

    kind = dict(pairs.dtypes)["id"]
    return t.filter("kind IS NOT NULL").select("id", "kind").unionByName(t.filter("kind IS NULL").select("id", "_t", "_p").mapInPandas(near, f"id {kind}, kind string"))
