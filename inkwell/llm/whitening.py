"""Whitening of embeddings by principal components, with matrix-free block Lanczos.

The covariance V of the integer vectors x = floor(64 c) + 1000000 is never formed. One pass over the table counts the
rows and sums each dimension exactly; every later pass multiplies a block Q of at most BLOCK columns by V: each
task centres its rows (n x - S is exact in integers), computes Xc'(Xc Q) for them batch by batch, and one row a
dimension and task is summed by Spark. The driver holds the basis, at most as many columns as there are dimensions.

Block Lanczos: the product of the newest block is orthogonalised against all earlier blocks, twice (full
reorthogonalisation), and its QR factor is the next block. Where columns of it vanish (breakdown: the space so far
is invariant), they are replaced by random directions orthogonal to the basis (restart), so repeated eigenvalues and
unconnected subspaces are found. A block is as wide as the components wanted, so no multiplicity escapes.
The iteration ends when the residuals of the wanted Ritz pairs fall below TOLERANCE of the largest eigenvalue, or the
basis spans the whole space. A last pass takes the true products V u of the wanted vectors: they give the
eigenvalues as Rayleigh quotients, true residuals (the iteration goes on from these vectors while one is too large) and
the covariance of the whitened values.

trace(V) is the sum of all deviations over n^3, as deviation = n^2 |x - S/n|^2 is summed exactly.

Defined results: vectors that are null or hold null, NaN or infinite entries are dropped; a vector with fewer entries than
the longest has zeros in the others; entries whose 64 c is beyond 2^52 are held at 2^52; a row without vec_id is
a row like others; repeated ids give repeated rows; equal vectors count as often as they stand. Components whose variance is
below RANK of the largest one (all, if all vectors are equal or there is one row) are numerically no direction and are
left out. A deviation beyond a long is null. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import in_arrow, table

COMPONENTS = 32
#: Columns of a block: all wanted components at once.
BLOCK = COMPONENTS
#: Residuals and variances, relative to the largest eigenvalue.
TOLERANCE, RANK = 1e-13, 1e-11
#: Entries of vectors that are handled at once.
ENTRIES = 1 << 20
#: Rounds of the last pass; one is enough but for nearly equal eigenvalues.
ROUNDS = 4
LONGEST = 2.0**52


def vectors(column: pa.Array, wide: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their x) of the finite vectors, some ENTRIES at a time; shorter vectors are filled with zeros."""
    held = np.flatnonzero(np.asarray(column.is_valid()))
    offs = np.asarray(column.offsets)
    flat = column.values.cast(pa.float64())
    flat = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts, sizes = offs[:-1][held], np.diff(offs)[held]
    d = int(sizes.max(initial=0)) if wide is None else wide
    step = max(1, ENTRIES // max(d, 1))
    for a in range(0, len(held), step):
        s, n = starts[a : a + step], sizes[a : a + step]
        if (n == d).all() and (np.diff(s) == d).all():
            c = flat[s[0] : s[0] + len(s) * d].reshape(len(s), d)
        else:
            inside = np.arange(d) < n[:, None]
            c = np.zeros((len(s), d))
            c[inside] = flat[(s[:, None] + np.arange(d))[inside]]
        good = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.floor(np.clip(64.0 * c[good], -LONGEST, LONGEST)).astype(np.int64) + 1_000_000
        yield held[a : a + step][good], x


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, width, and the exact sums of entries as 26 low bits and the rest, by dimension; zeros of shorter vectors are added at the end."""
    n, wide, low, high = 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for _, x in vectors(batch.column("embedding")):
            d = x.shape[1]
            if len(x) and d > len(low):
                # rows before had no entry here: floor(64 * 0) + 1000000 each
                more = np.full(d - len(low), n * 1_000_000, np.int64)
                low, high = np.concatenate([low, more & (2**26 - 1)]), np.concatenate([high, more >> 26])
            low[:d] += (x & (2**26 - 1)).sum(axis=0)
            high[:d] += (x >> 26).sum(axis=0)
            rest = np.full(len(low) - d, len(x) * 1_000_000, np.int64)
            low[d:] += rest & (2**26 - 1)
            high[d:] += rest >> 26
            n += len(x)
    wide = len(low)
    if n:
        yield pa.record_batch([pa.array(np.arange(-1, wide, dtype=np.int32)), pa.array(np.concatenate([[n], low])), pa.array(np.concatenate([[wide], high])), pa.array(np.full(wide + 1, n))], ["dim", "low", "high", "n"])


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, S): the number of finite vectors and the exact sum of each dimension of their x."""
    parts = in_arrow(rows.select("embedding"), _sums, "dim int, low long, high long, n long")
    told = parts.groupBy("dim").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n").alias("n")).collect()  # a row a dimension
    by = {r["dim"]: r for r in told}
    if -1 not in by:
        return 0, []
    n = int(by[-1]["low"])
    # A task whose vectors were all shorter has no row here: its vectors count as zeros.
    return n, [int(by[j]["low"]) + (int(by[j]["high"]) << 26) + (n - int(by[j]["n"])) * 1_000_000 for j in range(max(by) + 1)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit integers, or Python's where those would overflow."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if most * n < 2**61:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def deviations(moved: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    if moved.dtype == object:
        return [int(v) for v in (moved * moved).sum(axis=1)]
    most = int(np.abs(moved).max(initial=0))
    if most * most * max(moved.shape[1], 1) < 2**62:
        return (moved * moved).sum(axis=1).tolist()
    size = np.abs(moved)
    a, b, c = size >> 42, (size >> 21) & (2**21 - 1), size & (2**21 - 1)  # sums of products of 21 bits stay below 2^63
    parts = ((a * a, 84), (a * b, 64), (b * b, 42), (a * c, 43), (b * c, 22), (c * c, 0))
    return [sum(row) for row in zip(*([v << k for v in p.sum(axis=1).tolist()] for p, k in parts), strict=True)]


def _plain(moved: np.ndarray, n: int) -> np.ndarray:
    """x - S/n as doubles."""
    return moved.astype(np.float64) / n


def products(rows: DataFrame, n: int, total: list[int], block: np.ndarray, trace: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None]:
    """(V Q, the covariance of Xc Q, its mean, the sum of all deviations or None) of Q = block, in one pass."""
    d, b = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, own, mean, dev, seen = np.zeros((d, b)), np.zeros((b, b)), np.zeros((1, b)), 0, False
        for batch in batches:
            for _, x in vectors(batch.column("embedding"), d):
                moved = centred(x, n, total)
                dev += sum(deviations(moved)) if trace else 0
                c = _plain(moved, n)
                z = c @ block
                into += c.T @ z
                own += z.T @ z
                mean += z.sum(axis=0)
                seen = True
        if seen:
            flat = np.concatenate([into, own, mean])
            # The sum of deviations in two parts, so that neither leaves the decimals of 38 digits
            yield pa.record_batch([pa.array(np.arange(len(flat), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, b), pa.int32()), pa.array(flat.reshape(-1))), pa.array([str(dev % 10**18)] + ["0"] * (len(flat) - 1)), pa.array([str(dev // 10**18)] + ["0"] * (len(flat) - 1))], ["dim", "v", "low", "high"])

    parts = in_arrow(rows.select("embedding"), run, "dim int, v array<double>, low string, high string")
    added = [F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(b)]
    told = sorted(parts.groupBy("dim").agg(*added, F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high")).collect(), key=lambda r: r["dim"])
    out = np.array([[r[f"v{j}"] for j in range(b)] for r in told])
    dev = int(told[0]["low"]) + int(told[0]["high"]) * 10**18
    mean = out[-1] / n
    return out[:d] / n, out[d : d + b] / n - np.outer(mean, mean), mean, dev if trace else None


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, pick: np.random.Generator) -> tuple[np.ndarray, int]:
    """(an orthonormal block orthogonal to the basis, columns that had vanished and were drawn anew); fewer columns where the space ends."""
    out, drawn = np.zeros((len(block), 0)), 0
    room = len(block) - basis.shape[1]
    for j in range(block.shape[1]):
        if out.shape[1] >= room:
            break
        v = block[:, j].copy()
        held = np.linalg.norm(v)
        for _ in range(2):
            v -= basis @ (basis.T @ v)
            v -= out @ (out.T @ v)
        if held <= 1e-14 * scale or np.linalg.norm(v) <= 1e-14 * max(scale, held):
            drawn += 1
            v = pick.standard_normal(len(block))
            for _ in range(3):
                v -= basis @ (basis.T @ v)
                v -= out @ (out.T @ v)
        v /= np.linalg.norm(v)
        v -= basis @ (basis.T @ v)
        v -= out @ (out.T @ v)
        out = np.concatenate([out, (v / np.linalg.norm(v))[:, None]], axis=1)
    return out, drawn


def lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """(eigenvalues falling, eigenvectors, what was done) of the symmetric operator `apply` of d x b blocks."""
    pick = np.random.default_rng(11)
    first = pick.standard_normal((d, min(block, d)))
    if start is not None:
        first[:, : min(start.shape[1], first.shape[1])] = start[:, : first.shape[1]]
    basis, image, told = np.zeros((d, 0)), np.zeros((d, 0)), {"passes": 0, "restarts": 0}
    new, _ = _orthonormal(first, basis, 0.0, pick)
    while True:
        got = apply(new)
        told["passes"] += 1
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, got], axis=1)
        small = basis.T @ image
        values, inside = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(-values)[:wanted]
        values, inside = values[top], inside[:, top]
        scale = float(np.abs(values).max(initial=0.0))
        found = basis @ inside
        left = np.linalg.norm(image @ inside - found * values, axis=0)
        told["residual"] = float(left.max(initial=0.0))
        if basis.shape[1] >= d or len(values) >= wanted and told["residual"] <= tolerance * scale:
            return values, found, told
        new, drawn = _orthonormal(got, basis, float(np.abs(np.diag(small)).max(initial=0.0)), pick)
        told["restarts"] += bool(drawn)


def fit(rows: DataFrame, n: int, total: list[int], wanted: int = COMPONENTS, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(eigenvalues, unit eigenvectors, trace(V), identity error) of the fit list."""
    d, deviation = len(total), None

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal deviation
        got = products(rows, n, total, q, trace=deviation is None)
        deviation = got[3] if deviation is None else deviation
        return got[0]

    found, values, own = None, None, np.zeros((0, 0))
    for _ in range(ROUNDS):
        values, found, _ = lanczos(apply, d, min(wanted, d), block, start=found)
        image, own, _, _ = products(rows, n, total, found)
        values = np.einsum("ij,ij->j", found, image)
        scale = float(np.abs(values).max(initial=0.0))
        if np.linalg.norm(image - found * values, axis=0).max(initial=0.0) <= 1e-11 * scale:
            break
    order = np.argsort(-values)
    order = order[values[order] > RANK * max(float(values.max(initial=0.0)), 0.0)]
    values, found, own = values[order], found[:, order], own[np.ix_(order, order)]
    trace = float(deviation) / float(n) ** 3
    off = own / np.sqrt(np.outer(values, values)) - np.eye(len(values))
    return values, found, trace, float(np.abs(off).max(initial=0.0))


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(docs: DataFrame, wanted: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each finite vector and component."""
    rows = docs.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = dict(docs.dtypes)["vec_id"]
    n, total = sums(rows)
    values, found, trace, error = fit(rows, n, total, wanted, block) if n and total else (np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    k = len(values)
    scaled = found / np.sqrt(values) if k else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in vectors(batch.column("embedding"), len(total)) if k else ():
                moved = centred(x, n, total)
                dev = [v if v < 2**63 else None for v in deviations(moved)]
                z = _plain(moved, n) @ scaled
                m = len(at)
                yield pa.record_batch(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(dev, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(z.reshape(-1)), pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return in_arrow(rows, run, f"vec_id {kind}, {SCHEMA}")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
