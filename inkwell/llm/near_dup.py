"""Near-duplicate detection with HyperMinHash signatures.

A document is the set of its distinct word shingles. Its signature has BUCKETS
compressed registers: of the smallest 32-bit hash that a bucket sees, the number
of leading zeros (6 bits) and the MANTISSA bits after the leading one. Four
registers make a band, which as one 64-bit number is the banding key. Pairs that
share a band are compared by the share of equal registers, corrected for
registers that agree by chance, and pairs over a safe margin are confirmed on
their full shingle sets.

Each bucket has a permutation of its own. (Dealing the shingles over the buckets,
as the original sketch does, leaves most registers of short texts empty, and
short pairs would be lost.) A pair at the threshold of 0.75 misses all 40 bands
of four with probability 2.5e-7.

Equal sets are one class from the start. In a band bucket each class is first
compared with the bucket's most central class alone: the one whose own buckets
hold the most classes, so the least edited of a group of near copies. Then the
components so far are known, and only pairs of a bucket that are still in
different components are compared, without the classes that cannot link: a
shingle that occurs in no other class of these buckets is shared with none, which
bounds every intersection from above. Buckets of more than FEW classes are not
unfolded even then: each class meets the smallest of the bucket, its pivot, and
pairs that may link without it are sought by the rarest shingles that the pivot
lacks (`pivoted`), so texts filled into one template meet only those that share
more than the template. Every pair of classes that shares a band is therefore
confirmed, refuted or already connected.

Defined results: a null or wordless text has an empty set, n_shingles 0, and is
linked with nothing; texts of fewer words than a shingle are one shingle; a null
doc_id has component_id null and is kept; repeated ids are one vertex; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import kernels as K
from inkwell.llm.common import HOT, MOST_HOT, in_arrow, joined, table, written
from inkwell.llm.graph import components, extended

WORDS, THRESHOLD = 5, 75
BANDS, ROWS, MANTISSA = 40, 4, 10
BUCKETS = BANDS * ROWS
#: Estimates this far below the threshold are not confirmed: five standard deviations of the register count.
MARGIN = 0.18
#: Cells of the odd sketch; classes of a bucket that a task compares with the others; classes of a bucket all of whose pairs are compared.
ODD, BLOCK, FEW = 512, 512, 16
ROW_BITS = K.U64(16)
_rng = np.random.Generator(np.random.PCG64(5))
_ODD = _rng.integers(0, 2**31, size=BUCKETS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 2**32, size=BUCKETS, dtype=np.uint32)


def sets(buf: np.ndarray, offs: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 48 bits, first index of each row) of the distinct shingles; under 65,536 rows."""
    start, length, first = K.words(buf, offs, K.SPACED)
    grams, at = K.shingles(K.hashes(buf, start, length), first, n)
    row = np.repeat(np.arange(len(offs) - 1, dtype=K.U64), np.diff(at))
    key = np.sort((row << (K.U64(64) - ROW_BITS)) | (grams >> ROW_BITS))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    at = np.searchsorted(key, np.arange(len(offs), dtype=K.U64) << (K.U64(64) - ROW_BITS)) if len(offs) < 65536 else None
    return key & K.U64(2**48 - 1), at


def registers(values: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of 32-bit minima, as 16 bits."""
    width = np.frexp(values.astype(np.float64))[1].astype(np.uint32)
    zeros = np.uint32(32) - width
    rest = (values.astype(np.uint64) << (zeros.astype(np.uint64) + K.U64(1))) & K.U64(0xFFFFFFFF)
    return ((zeros << np.uint32(MANTISSA)) | (rest >> K.U64(32 - MANTISSA)).astype(np.uint32)).astype(np.uint16)


def signature(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers of each row that has shingles: an array (rows, BUCKETS)."""
    counts = np.diff(at)
    heads = at[:-1][counts > 0]
    low = (grams >> K.U64(16)).astype(np.uint32)
    out = np.empty((BUCKETS, len(heads)), np.uint32)
    held = np.empty_like(low)
    for k in range(BUCKETS if len(heads) else 0):
        np.bitwise_xor(low, _XOR[k], out=held)
        np.multiply(held, _ODD[k], out=held)
        held ^= held >> np.uint32(15)
        np.multiply(held, _ODD[k - 1], out=held)
        np.minimum.reduceat(held, heads, out=out[k])
    return registers(np.ascontiguousarray(out.T))


def _slices(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = K.texts(column)
    for a, b in K.slices(offs):
        for c in range(a, b, 8_000):
            d = min(b, c + 8_000)
            yield c, d, buf[offs[c] : offs[d]], offs[c : d + 1] - offs[c]


def _digest(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(at)
    out = np.zeros((2, len(counts)), K.U64)
    if len(grams):
        heads = at[:-1][counts > 0]
        mixed = K.mix(grams + K.U64(1))
        out[0, counts > 0] = np.add.reduceat(mixed, heads)
        out[1, counts > 0] = np.add.reduceat(K.mix(mixed * K.PLACES[7]), heads)
    return out[0].view(np.int64), out[1].view(np.int64)


def odd_sketch(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parities of each row, (rows, ODD / 64) numbers: the bits in which two rows differ are at most their symmetric difference."""
    rows = len(at) - 1
    cell = np.repeat(np.arange(rows, dtype=np.int64) * ODD, np.diff(at)) + (grams & K.U64(ODD - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=rows * ODD) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, ODD), axis=1).view(np.int64)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offs in _slices(batch.column("text")):
            grams, at = sets(buf, offs)
            counts = np.diff(at)
            d1, d2 = _digest(grams, at)
            keys = signature(grams, at).view(np.int64).reshape(-1)
            yield pa.record_batch([batch.column("doc_id")[a:b], pa.array(counts.astype(np.int64)), pa.array(d1), pa.array(d2), _lists(keys, np.where(counts > 0, BANDS, 0)), _lists(odd_sketch(grams, at).reshape(-1), np.full(b - a, ODD // 64))], ["doc_id", "n", "d1", "d2", "bands", "odd"])


def _shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offs in _slices(batch.column("text")):
            grams, at = sets(buf, offs)
            d1, d2 = _digest(grams, at)
            yield pa.record_batch([batch.column("doc_id")[a:b], pa.array(d1), pa.array(d2), _lists(grams.view(np.int64), np.diff(at))], ["id", "d1", "d2", "grams"])


def estimate(equal: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers; two different minima with the same
    leading zeros agree in the mantissa by chance with 2**-MANTISSA."""
    chance = zeros * 2.0**-MANTISSA
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.asarray(batch.column(c).flatten()).view(np.uint16).reshape(-1, BUCKETS) for c in ("x", "y"))
        same_zeros = ((x >> MANTISSA) == (y >> MANTISSA)).mean(axis=1) if len(x) else np.zeros(0)
        j = estimate((x == y).mean(axis=1) if len(x) else np.zeros(0), same_zeros)
        yield batch.select(["a", "b"]).filter(pa.array(j >= THRESHOLD / 100 - MARGIN))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), d1, d2 (digest of the set), bands (the registers, four to a number), odd (sketch)."""
    return in_arrow(docs.select("doc_id", "text"), _sign, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, d1 long, d2 long, bands array<long>, odd array<long>")


def confirmed(pairs: DataFrame, reps: DataFrame, full: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of class representatives, those whose full sets are similar enough; full: rep, grams."""
    mine = reps.select("rep", "bands")
    near = pairs.join(mine.select(F.col("rep").alias("a"), F.col("bands").alias("x")), "a").join(mine.select(F.col("rep").alias("b"), F.col("bands").alias("y")), "b")
    near = written(in_arrow(near.select("a", "b", "x", "y"), _close, "a long, b long"))
    if not near.limit(1).count():  # the full sets stay where they are
        return near
    met = near.join(full.select(F.col("rep").alias("a"), F.col("grams").alias("x")), "a").join(full.select(F.col("rep").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return written(met.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y") - shared).alias("u")).filter(F.col("i") * 100 >= F.col("u") * THRESHOLD).select("a", "b"))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, grams: the shingle sets of the class representatives `wanted` (rep, d1, d2)."""
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    full = in_arrow(texts, _shingle, "id long, d1 long, d2 long, grams array<long>")
    full = full.withColumnRenamed("id", "rep").join(wanted, ["rep", "d1", "d2"], "left_semi")
    return written(full.groupBy("rep").agg(F.first("grams").alias("grams")))


def able_classes(rest: DataFrame, reps: DataFrame, full: DataFrame) -> DataFrame:
    """rest: band, key, c (classes of the bucket), rep, n, component -> its classes that may link, with `most` (bound of any intersection) and the odd sketch."""
    each = full.join(rest.select("rep").distinct(), "rep", "left_semi").select("rep", F.explode("grams").alias("gram"))
    own = each.groupBy("gram").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).filter("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
    able = rest.join(own, "rep", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).filter(F.col("most") * 100 >= F.col("n") * THRESHOLD)
    return written(able.join(reps.select("rep", "odd"), "rep").select("band", "key", "c", "rep", "n", "component", "most", *[F.col("odd")[i].alias(f"o{i}") for i in range(ODD // 64)]))


def met_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b) of rows of equal keys and two components that no bound refutes; c: rows of the keys.

    Keys of c rows are cut into blocks of BLOCK, each of which meets all rows of its keys in a task of its own.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    told = ["rep", "n", "component", "most", *[f"o{i}" for i in range(ODD // 64)]]
    x, y = (rows.select(*keys, part.alias("block"), *[F.col(c).alias(f"{c}_{s}") for c in told]) for s, part in (("x", F.pmod(F.xxhash64("rep"), blocks).cast("int")), ("y", F.explode(F.sequence(F.lit(0), blocks - 1)))))
    both = F.col("n_x") + F.col("n_y")
    # i / (n_x + n_y - i) >= t for some i up to the bound, which the smaller set bounds too
    may = F.least("most_x", "most_y") * (100 + THRESHOLD) >= both * THRESHOLD
    differ = sum((F.bit_count(F.col(f"o{i}_x").bitwiseXOR(F.col(f"o{i}_y"))) for i in range(ODD // 64)), F.lit(0))
    may = may & (differ * (100 + THRESHOLD) <= both * (100 - THRESHOLD))
    met = x.join(y, [*keys, "block"]).filter((F.col("rep_x") < F.col("rep_y")) & (F.col("component_x") != F.col("component_y")) & may)
    return met.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()


def pivoted(many: DataFrame, full: DataFrame, hot: DataFrame) -> DataFrame:
    """pivot, pn, rep, n, i (shingles shared with the pivot), prefix: each class of `many` with the smallest class of each of its buckets.

    Two classes x, y that link, but not both with their pivot p, share a shingle outside p: p is the smallest, so the one
    that does not link shares less than (n_p + n_x) * t / (1 + t) shingles with it, t = THRESHOLD / 100, which is less than x and y share.
    They share at least (n_x + n_y) * t / (1 + t) - i_x outside p. So of the n - i shingles outside p, rarest first, so many
    less one may be left out at the end; those kept that occur in another class are the prefix.
    """
    bucket = ["band", "key"]
    least = many.groupBy(*bucket).agg(F.min(F.struct("n", "rep")).alias("p"))
    tied = joined(many, least, bucket, hot=hot).select("rep", "n", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn")).distinct()
    each = written(full.join(many.select("rep").distinct(), "rep", "left_semi").select("rep", F.explode("grams").alias("gram")))
    counts = each.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1")
    ordered = joined(each, counts, ["gram"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).getField("gram").alias("ordered"))
    met = tied.join(ordered, "rep").join(full.select(F.col("rep").alias("pivot"), F.col("grams").alias("held")), "pivot")
    met = met.withColumn("outside", F.array_except("ordered", "held")).withColumn("i", F.size("ordered") - F.size("outside"))
    least_other = F.greatest("pn", F.expr(f"({THRESHOLD} * n + 99) div 100"))
    met = met.withColumn("_both", F.col("n") + least_other).withColumn("_need", F.greatest(F.lit(1), F.expr(f"({THRESHOLD} * _both + {99 + THRESHOLD}) div {100 + THRESHOLD}") - F.col("i")))
    # shingles of no other class come first and are not written
    take = F.size("ordered") - F.col("i") - F.col("_need") + 1
    return written(met.select("pivot", "pn", "rep", "n", "i", F.slice("outside", F.lit(1), F.greatest(F.lit(0), take).cast("int")).alias("prefix")))


def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (rep) with their component, which is the class itself where it has no link."""
    return rows.drop("component").join(found.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def listed(held: DataFrame, found: DataFrame) -> DataFrame:
    """pivot, gram, rep, n, component, c, head: the prefixes as lists, those of more than one component."""
    lists = written(with_component(held.select("pivot", "rep", "n", F.explode("prefix").alias("gram")), found))
    facts = lists.groupBy("pivot", "gram").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("n", "rep", "component")).alias("head"))
    return written(joined(lists, facts.filter("lo < hi").drop("lo", "hi"), ["pivot", "gram"]))


def late_components(rest: DataFrame, reps: DataFrame, full: DataFrame, found: DataFrame, hot: DataFrame) -> DataFrame:
    """The components `found`, joined by links between the classes of `rest`; not by all, but by enough to connect what is connected.

    The pairs of a bucket of up to FEW classes are compared, which is a constant for each class. In larger ones
    pairs are sought in the lists of `pivoted`; each list is first compared with its smallest class, then by pairs that are still apart.
    """
    able = able_classes(rest, reps, full)
    late = confirmed(met_pairs(able.filter(F.col("c") <= FEW), ["band", "key"]), reps, full)
    many = written(able.filter(F.col("c") > FEW))
    if not many.limit(1).count():
        return extended(found, late)
    held = pivoted(many.select("band", "key", "rep", "n"), full, hot)
    direct = held.filter((F.col("rep") != F.col("pivot")) & (F.col("i") * (100 + THRESHOLD) >= (F.col("n") + F.col("pn")) * THRESHOLD)).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    found = extended(found, late.union(direct))
    lists = listed(held, found)
    stars = lists.filter(F.col("component") != F.col("head.component")).select(F.least("rep", "head.rep").alias("a"), F.greatest("rep", "head.rep").alias("b")).distinct()
    joint = extended(found, confirmed(stars, reps, full))
    if joint is not found:
        lists = listed(held, joint)
    bounds = many.select("rep", "most", *[f"o{i}" for i in range(ODD // 64)]).distinct()
    return extended(joint, confirmed(met_pairs(lists.join(bounds, "rep"), ["pivot", "gram"]), reps, full))


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row a document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(signatures(docs))
    classes = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = written(signed.withColumnRenamed("doc_id", "rep").join(classes.drop("copies"), ["d1", "d2", "n", "rep"]).dropDuplicates(["rep", "d1", "d2"]))
    banded = reps.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    bucket = ["band", "key"]
    sizes = written(banded.groupBy(*bucket).agg(F.count("*").alias("c")).filter("c > 1"))  # buckets with company
    hot = written(sizes.filter(F.col("c") > max(HOT, BANDS * reps.count() // MOST_HOT)).select(*bucket))
    shared = written(joined(banded, sizes, bucket, hot=hot).select("band", "key", "rep", "n", "c"))
    scores = shared.groupBy("rep").agg(F.sum("c").alias("score"))
    central = shared.join(scores, "rep").groupBy("band", "key").agg(F.max(F.struct("score", (-F.col("rep")).alias("r"))).alias("best")).select("band", "key", (-F.col("best.r")).alias("head"))
    stars = joined(shared, central, bucket, hot=hot).filter("rep <> head").select(F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b")).distinct()
    full = full_sets(docs, reps.join(shared.select("rep").distinct(), "rep", "left_semi").select("rep", "d1", "d2"))
    links = confirmed(stars, reps, full)
    found = components(links)
    inside = shared.join(found.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = inside.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band", "key")
    rest = written(joined(inside, split, bucket, hot=hot).select("band", "key", "c", "rep", "n", "component"))
    found = late_components(rest, reps, full, found, hot)
    told = classes.join(found.withColumnRenamed("v", "rep"), "rep", "left").filter("copies > 1 OR component IS NOT NULL")
    told = told.select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    out = joined(signed, told, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_near_dup(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
