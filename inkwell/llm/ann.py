"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors are lengthened by one component so that the largest inner product is the
smallest distance, turned by a random rotation, and put into the list of the
nearest centroid (k-means on a bounded sample; few vectors a list). A query probes
the nearest lists until they hold a share of all vectors; the share is calibrated with
ASKED rows whose true neighbours among all vectors are found in the pass that counts the
lists, as the least at which RECALL of them is found.
Within the lists the scan reads columns in blocks of BLOCK: after each, a candidate is
abandoned if its partial distance is too large for the whole distance to be below the query's
bound, by the test of the published method (partial distances in rotated space are
estimates of the whole; EPSILON standard errors). The bound starts from the sample's vectors in the
probed lists and tightens with what is found. What survives is scored on the original vectors, in double
precision, component after component.

Lists that lie side by side form a group of up to MEMBERS vectors, by halving the centroids along
their widest axis; a larger list is a group of its own, cut into blocks. A task holds one
block of a group and up to PROBES of the queries that probe it, so a vector is sent once for each PROBES
queries of its group, a query once for each block that holds lists it probes, and neither a
large list nor a popular one lands in one task. The sample, the rotation and the centroids are
bounded and broadcast; every row is indexed, and queries and candidates travel packed.

Defined results: vectors that are null, zero, or hold nulls or non-finite numbers take no part; a
null id takes no part; vectors of different lengths have no inner product, so each length is
searched apart (more than MOST_LENGTHS of them are an error); rows of one id are one candidate,
with its best score; a query never finds its own id; ties go to the smaller id; with fewer than
k candidates all are returned; without vectors, nothing is; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import in_arrow, table, written

NEAREST, RECALL, EPSILON, BLOCK = 20, 0.94, 2.3, 16
#: Bounds: vectors that lists are fitted on, further ones to calibrate with, lists, members and queries of one task's block, lengths.
SAMPLE, ASKED, MAX_LISTS, MEMBERS, PROBES, MOST_LENGTHS = 8192, 256, 4096, 16384, 16384, 16
#: Vectors of the sample for a list.
A_LIST = 4
SHARES = tuple(i / 50 for i in range(1, 51))


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, v (array of doubles) of the rows that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).filter(v.isNotNull() & F.col("id").isNotNull()).filter(~bad & F.exists(v, lambda x: x != 0))


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def even(sizes: np.ndarray) -> np.ndarray:
    """Sizes as the share of vectors to probe counts them: a crowded list does not use up what others need."""
    return np.minimum(sizes, 2 * int(np.ceil(np.median(sizes[sizes > 0]))) if (sizes > 0).any() else 0)


class Index:
    """Rotation, centroids and sample; `norm2` is the largest squared norm."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, norm2: float, k: int = NEAREST, seed: int = 9):
        r = np.random.Generator(np.random.PCG64(seed))
        self.dim, self.norm2, self.k = sample.shape[1] + 1, norm2, k
        self.turn = np.linalg.qr(r.normal(size=(self.dim, self.dim)))[0]
        self.ids, self.sample = ids, self.rotated(sample)
        c = self.sample[r.permutation(len(sample))[: max(1, min(MAX_LISTS, len(sample) // A_LIST))]].copy()
        for _ in range(6):
            own = self._nearest(self.sample, c)
            total = np.zeros_like(c)
            np.add.at(total, own, self.sample)
            many = np.bincount(own, minlength=len(c))
            c[many > 0] = total[many > 0] / many[many > 0, None]
        self.centroids = c
        self.own = self._nearest(self.sample, c)

    def share(self, q: np.ndarray, sizes: np.ndarray, of: np.ndarray, own: np.ndarray) -> float:
        """The share of vectors to probe: `own` are the lists of true neighbours of the queries (numbers `of`)."""
        sizes = even(sizes)
        order = np.argsort(self.distances(q, self.centroids), axis=1)
        ahead = np.cumsum(sizes[order], axis=1) - sizes[order]
        before = np.take_along_axis(ahead, np.argsort(order, axis=1), axis=1)[of, own]
        return next((s for s in SHARES if len(of) and (before < s * sizes.sum()).mean() >= RECALL), 1.0)

    def rotated(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return (np.concatenate([x, more[:, None]], axis=1) @ self.turn).astype(np.float32)

    def queries(self, x: np.ndarray) -> np.ndarray:
        return (np.concatenate([x, np.zeros((len(x), 1))], axis=1) @ self.turn).astype(np.float32)

    @staticmethod
    def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T), 0)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[a : a + 4096] @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])

    def lists(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.rotated(x), self.centroids)

    def probes(self, q: np.ndarray, sizes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(queries, lists): whether a query probes a list, and the distance up to which it does; sizes: members of each."""
        sizes = even(sizes)
        out, cut = np.zeros((len(q), len(sizes)), dtype=bool), np.zeros(len(q))
        for a in range(0, len(q), 256):
            d = self.distances(q[a : a + 256], self.centroids)
            order = np.argsort(d, axis=1)
            ahead = np.cumsum(sizes[order], axis=1) - sizes[order]
            np.put_along_axis(out[a : a + 256], order, ahead < max(share * sizes.sum(), 4 * self.k), axis=1)
            cut[a : a + 256] = np.where(out[a : a + 256], d, 0).max(axis=1)
        return out, cut

    def groups(self, sizes: np.ndarray, most: int) -> np.ndarray:
        """The group of each list: lists side by side, of up to `most` members together; a larger one alone."""
        out = np.zeros(len(sizes), np.int64)
        left, made = [np.arange(len(sizes))], 0
        while left:
            some = left.pop()
            if len(some) == 1 or sizes[some].sum() <= most:
                out[some], made = made, made + 1
                continue
            x = self.centroids[some]
            some = some[np.argsort(x[:, x.var(axis=0).argmax()], kind="stable")]
            half = np.cumsum(sizes[some])
            at = min(max(1, int(np.searchsorted(half, half[-1] / 2))), len(some) - 1)
            left += [some[:at], some[at:]]
        return out

    def bounds(self, ids: np.ndarray, q: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """Squared distance to scan up to: that of the 2k-th of the sample's vectors in the probed lists, the query's id
        left out. They are candidates themselves, so k are found even where the test abandons some."""
        out = np.full(len(q), np.inf)
        last = 2 * self.k - 1
        for a in range(0, len(q), 256):
            d = self.distances(q[a : a + 256], self.sample)
            d[(ids[a : a + 256][:, None] == self.ids[None, :]) | ~probed[a : a + 256][:, self.own]] = np.inf
            if d.shape[1] > last:
                out[a : a + 256] = np.partition(d, last, axis=1)[:, last]
        return out


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, probed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) places of the probed pairs that the dimension scan keeps for squared distances up to `bound`."""
    dim = q.shape[1]
    limit = bound * (1 + 1e-4) + 1e-5 * float(max((q * q).sum(axis=1).max(initial=0), (x * x).sum(axis=1).max(initial=0)))  # single precision
    d = min(BLOCK, dim)
    part = Index.distances(q[:, :d], x[:, :d])
    slack = (d / dim) * (1 + EPSILON / d**0.5) ** 2 if d < dim else 1.0
    i, j = np.nonzero((part <= (limit * slack)[:, None]) & probed)
    acc = part[i, j].astype(np.float64)
    while d < dim and len(i):
        e = min(dim, d + BLOCK)
        step = q[i, d:e] - x[j, d:e]
        acc += np.einsum("nd,nd->n", step, step)
        d = e
        slack = (d / dim) * (1 + EPSILON / d**0.5) ** 2 if d < dim else 1.0
        keep = acc <= limit[i] * slack
        i, j, acc = i[keep], j[keep], acc[keep]
    return i, j


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, component after component."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: largest score first, then smallest id."""
    order = np.lexsort((ids, -scores, query))
    own = query[order]
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    nth = np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own))))
    return order[nth < k]


PACKED = "grp int, vb int, qb int, query boolean, ids binary, lists binary, vectors binary"


def _pack(parts: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*parts, strict=True))
    types = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.split()[0] for f in PACKED.split(", ")])


def _members(held, group: np.ndarray, v_blocks: np.ndarray, q_blocks: np.ndarray):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        seen = 0
        for batch in batches:
            ids, x = np.asarray(batch.column("id")), matrix(batch.column("v"))
            if not len(x):
                continue
            own = index.lists(x)
            of = group[own]
            block = (seen + np.arange(len(x))) % v_blocks[of]  # dealt in turn: rows of one id need not meet
            seen += len(x)
            parts = []
            for g, vb in np.unique(np.stack([of, block]), axis=1).T.tolist():
                at = np.flatnonzero((of == g) & (block == vb))
                parts += [(g, vb, qb, False, ids[at].tobytes(), own[at].astype(np.int32).tobytes(), x[at].tobytes()) for qb in range(q_blocks[g])]
            if parts:
                yield _pack(parts)

    return members


def _asked(held, sizes: np.ndarray, share: float, group: np.ndarray, v_blocks: np.ndarray, q_blocks: np.ndarray | None = None):
    """Without query blocks: how many queries probe each group. With: the queries, for each group and block."""
    first = np.flatnonzero(np.concatenate([[True], np.sort(group)[1:] != np.sort(group)[:-1]]))
    order = np.argsort(group, kind="stable")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        seen = 0
        for batch in batches:
            ids, x = np.asarray(batch.column("id")), matrix(batch.column("v"))
            if not len(x):
                continue
            q = index.queries(x)
            probed, cut = index.probes(q, sizes, share)
            in_group = np.logical_or.reduceat(probed[:, order], first, axis=1)
            if q_blocks is None:
                yield pa.record_batch([pa.array(np.arange(len(v_blocks), dtype=np.int32)), pa.array(in_group.sum(axis=0).astype(np.int64))], ["list", "n"])
                continue
            full = np.concatenate([x, index.bounds(ids, q, probed)[:, None], cut[:, None]], axis=1)
            parts = []
            for g in np.flatnonzero(in_group.any(axis=0)).tolist():
                at = np.flatnonzero(in_group[:, g])
                block = (seen + at) % q_blocks[g]
                parts += [(g, vb, qb, True, ids[at[block == qb]].tobytes(), b"", full[at[block == qb]].tobytes()) for qb in np.unique(block).tolist() for vb in range(v_blocks[g])]
            seen += len(x)
            if parts:
                yield _pack(parts)

    return asked


def _counts(held, ids: np.ndarray, q: np.ndarray, k: int):
    """Members of each list (query -1), and the k nearest members of each query with their lists, of one task."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        n = np.zeros(len(index.centroids), np.int64)
        top = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.float64))  # query, list, distance
        for batch in batches:
            x = matrix(batch.column("v"))
            if not len(x):
                continue
            own = index.lists(x)
            n += np.bincount(own, minlength=len(n))
            d = index.distances(q, index.rotated(x)).astype(np.float64)
            d[ids[:, None] == np.asarray(batch.column("id"))[None, :]] = np.inf
            near = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            new = (np.repeat(np.arange(len(q)), near.shape[1]), own[near].ravel(), np.take_along_axis(d, near, axis=1).ravel())
            top = tuple(np.concatenate(c) for c in zip(top, new, strict=True))
            keep = best(top[0], top[1], -top[2], k)
            top = tuple(c[keep] for c in top)
        real = np.isfinite(top[2])
        cols = (np.concatenate([np.full(len(n), -1), top[0][real]]), np.concatenate([np.arange(len(n)), top[1][real]]), np.concatenate([n.astype(np.float64), top[2][real]]))
        yield pa.record_batch([pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2])], ["query", "list", "value"])

    return counts


def _search(held, k: int):
    def search(rows):
        index: Index = held.value
        side = np.asarray(rows.column("query").to_pylist(), dtype=bool)
        raw = {c: rows.column(c).to_pylist() for c in ("ids", "lists", "vectors")}
        part = lambda c, want, kind: np.concatenate([np.frombuffer(x, kind) for x, s in zip(raw[c], side, strict=True) if s == want] or [np.zeros(0, kind)])
        dim = index.dim - 1
        v_ids, v_list, v = part("ids", False, np.int64), part("lists", False, np.int32), part("vectors", False, np.float64).reshape(-1, dim)
        q_ids, full = part("ids", True, np.int64), part("vectors", True, np.float64).reshape(-1, dim + 2)
        q, bound, cut = full[:, :dim], full[:, dim].copy(), full[:, dim + 1] * (1 + 1e-6)
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(v) and len(q):
            order = np.argsort(v_list, kind="stable")
            v_ids, v = v_ids[order], v[order]
            some, own = np.unique(v_list[order], return_inverse=True)
            turned, asked = index.rotated(v), index.queries(q)
            for a in range(0, len(q), 256):
                b = min(len(q), a + 256)
                near = index.distances(asked[a:b], index.centroids[some]) <= cut[a:b, None]
                seen: tuple[np.ndarray, ...] = tuple(x[:0] for x in out[0])
                for s in range(0, len(v), 1024):
                    i, j = scan(asked[a:b], turned[s : s + 1024], bound[a:b], near[:, own[s : s + 1024]])
                    other = q_ids[a + i] != v_ids[s + j]
                    i, j = a + i[other], s + j[other]
                    if not len(i):
                        continue
                    seen = tuple(np.concatenate([x, y]) for x, y in zip(seen, (i, v_ids[j], exact(q[i], v[j])), strict=True))
                    # rows of one id are one candidate
                    order = np.lexsort((-seen[2], seen[1], seen[0]))
                    seen = tuple(x[order] for x in seen)
                    fresh = np.concatenate([[True], (seen[0][1:] != seen[0][:-1]) | (seen[1][1:] != seen[1][:-1])])
                    seen = tuple(x[fresh] for x in seen)
                    keep = best(*seen, k)
                    seen = tuple(x[keep] for x in seen)
                    full_up = np.flatnonzero(np.bincount(seen[0] - a, minlength=b - a) >= k)
                    if len(full_up):  # the k-th best so far bounds what can still matter
                        worst = np.full(b - a, np.inf)
                        np.minimum.at(worst, seen[0] - a, seen[2])
                        norms = (q[a:b] ** 2).sum(axis=1) + index.norm2
                        bound[a + full_up] = np.minimum(bound[a + full_up], (norms - 2 * worst)[full_up])
                out.append((q_ids[seen[0]], seen[1], seen[2]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"query_id": pa.array(cols[0]), "vec_id": pa.array(cols[1]), "score": pa.array(cols[2])})

    return search


def _found(own: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, vec_id, score of candidates near enough; own: id, v, all of one length."""
    spark = own.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    got = own.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE + ASKED).toArrow()
    norm2 = own.agg(F.max(norm)).first()[0]
    ids, rows = np.asarray(got.column("id")), matrix(got.column("v"))
    index = Index(ids[:SAMPLE], rows[:SAMPLE], norm2, k)
    held = spark.sparkContext.broadcast(index)
    ask = index.queries(rows[-ASKED:])
    seen = written(in_arrow(own, _counts(held, ids[-ASKED:], ask, k), "query int, list int, value double"))

    def per_list(df: DataFrame, many: int) -> np.ndarray:
        out = np.zeros(many, np.int64)
        for c, n in df.groupBy("list").agg(F.sum("n")).collect():  # a row a list
            out[c] = n
        return out

    sizes = per_list(seen.filter("query < 0").select("list", F.col("value").cast("long").alias("n")), len(index.centroids))
    nearest = Window.partitionBy("query").orderBy("value", "list")
    true = seen.filter("query >= 0").withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") <= k).select("query", "list").toArrow()  # k rows a query
    share = index.share(ask, sizes, np.asarray(true.column("query")), np.asarray(true.column("list")))
    group = index.groups(sizes, MEMBERS)
    v_blocks = np.maximum(1, -(-np.bincount(group, sizes) // MEMBERS)).astype(np.int64)
    queries = own.filter(F.col("id") % every == 0)
    asked = per_list(in_arrow(queries, _asked(held, sizes, share, group, v_blocks), "list int, n long"), len(v_blocks))
    q_blocks = -(-asked // PROBES)
    packed = in_arrow(own, _members(held, group, v_blocks, q_blocks), PACKED).union(in_arrow(queries, _asked(held, sizes, share, group, v_blocks, q_blocks), PACKED))
    return packed.groupBy("grp", "vb", "qb").applyInArrow(_search(held, k), "query_id long, vec_id long, score double")


def neighbours(vectors: DataFrame, every: int = 20, k: int = NEAREST, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`."""
    own = usable(vectors, id_column, column)
    lengths = sorted(r[0] for r in own.select(F.size("v").alias("n")).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    parts = [_found(own.filter(F.size("v") == n), every, k) for n in lengths]
    if not parts:
        return own.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranked = reduce(DataFrame.union, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
