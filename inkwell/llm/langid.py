"""Language identification by a bidirectional gated recurrent network over bytes.

A forward and a backward GRU of HIDDEN units read the bytes of a text; at every
position their states give a distribution over the learned languages, and the
mean of the positions' distributions is the document's. Texts are cut into
segments of SEGMENT bytes that start from a zero state, so any number of texts
of any length is read in the same few megabytes.

Training is backpropagation through time in numpy with Adam, on a bounded sample:
the PER_LANG documents of each language with the smallest hashes of their ids and
texts, and WINDOWS windows of SEGMENT characters spread evenly over each of them,
whatever its length. Only documents whose hash is below a threshold, which lets
SPARE times PER_LANG of a language's distinct rows through, are ranked, so no task
gathers rows that grow with the data; repeated rows are one. Only text and label
of training rows are used, and only text for predictions.

Defined results: a null text, or one without a letter, is `und` with score 0; so
is every text if there is nothing to learn from; a null label is not learned from;
a text of any length is read whole; every label that occurs with a letter is
learned, and more than MOST_LANGS of them raise an error; ties go to the label first
in order; repeated rows get equal answers; an empty table gives an empty result;
columns beyond doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import kernels as K
from inkwell.llm.common import in_arrow, table, written

HIDDEN, SEGMENT = 8, 64
#: Bounds of the sample: documents a language, windows a document; how many times PER_LANG rows are ranked.
PER_LANG, WINDOWS, SPARE = 300, 6, 4
#: More languages than this are an error.
MOST_LANGS = 4096
STEPS, BATCH, RATE = 260, 256, 0.02
#: Segments that run side by side in prediction.
WIDTH = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


class Network:
    """Weights of both directions: e (256, 3H) from bytes, u (H, 3H) from the state; w (2H, L), b (L)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 4):
        r = np.random.Generator(np.random.PCG64(seed))
        self.langs, self.h = langs, hidden
        f = lambda *s, k: r.normal(0, k, s).astype(np.float32)
        self.p = {"ef": f(256, 3 * hidden, k=0.3), "eb": f(256, 3 * hidden, k=0.3), "uf": f(hidden, 3 * hidden, k=0.3), "ub": f(hidden, 3 * hidden, k=0.3), "w": f(2 * hidden, len(langs), k=0.3), "b": np.zeros(len(langs), np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """x, mask: (T, n), in reading order of the direction. States after each step, (T, n, H)."""
        h, e, u = self.h, self.p["e" + way], self.p["u" + way]
        uz, uc = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        for t in range(x.shape[0]):
            a = e.take(x[t], axis=0)
            gates = state @ uz
            gates += a[:, : 2 * h]
            _sigmoid(gates)
            z, r = gates[:, :h], gates[:, h:]
            rs = r * state
            c = rs @ uc
            c += a[:, 2 * h :]
            np.tanh(c, out=c)
            new = state - c
            new *= z
            new += c
            new *= mask[t][:, None]
            if keep is not None:
                keep.append((x[t], mask[t], state, gates, rs, c))
            out[t] = state = new
        return out

    def positions(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Distribution over languages at each position: (T, n, L)."""
        f = self._run(x, mask, "f", keep.setdefault("f", []) if keep is not None else None)
        b = self._run(x[::-1], mask[::-1], "b", keep.setdefault("b", []) if keep is not None else None)[::-1]
        if keep is not None:
            keep["hf"], keep["hb"] = f, b
        y = f @ self.p["w"][: self.h] + b @ self.p["w"][self.h :] + self.p["b"]
        y -= y.max(axis=2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=2, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
        keep: dict = {}
        y = self.positions(x, mask, keep)
        n = max(1.0, float(mask.sum()))
        rows = np.arange(x.shape[1])
        loss = -float((np.log(y[:, rows, target] + 1e-9) * mask).sum()) / n
        y[:, rows, target] -= 1
        y *= (mask / n)[:, :, None]
        h = self.h
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"][:h] = np.einsum("tnh,tnl->hl", keep["hf"], y)
        g["w"][h:] = np.einsum("tnh,tnl->hl", keep["hb"], y)
        g["b"] = y.sum(axis=(0, 1))
        for way, dout in (("f", y @ self.p["w"][:h].T), ("b", (y @ self.p["w"][h:].T)[::-1])):
            u = self.p["u" + way]
            ds = np.zeros((x.shape[1], h), np.float32)
            for t in range(x.shape[0] - 1, -1, -1):
                b, m, state, gates, rs, c = keep[way][t]
                z, r = gates[:, :h], gates[:, h:]
                ds = (ds + dout[t]) * m[:, None]
                dz = ds * (state - c) * z * (1 - z)
                dc = ds * (1 - z) * (1 - c * c)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * state * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                np.add.at(g["e" + way], b, da)
                g["u" + way][:, : 2 * h] += state.T @ da[:, : 2 * h]
                g["u" + way][:, 2 * h :] += rs.T @ dc
                ds = ds * z + drs * r + da[:, : 2 * h] @ u[:, : 2 * h].T
        return loss, g

    def fit(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 4) -> float:
        """Adam over random batches of segments, languages in equal shares; x, mask: (T, n)."""
        r = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        of = [np.flatnonzero(target == k) for k in range(len(self.langs))]
        loss = 0.0
        for step in range(1, steps + 1):
            lang = r.integers(0, len(of), batch)
            pick = np.array([of[k][r.integers(len(of[k]))] for k in lang])
            loss, g = self.gradients(x[:, pick], mask[:, pick], target[pick])
            now = rate * (1 - 0.9 * step / steps)
            for k, w in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                w -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def pooled(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean distribution of each text: (rows, L); zeros for texts without bytes."""
        lengths = np.diff(offs)
        many = -(-lengths // SEGMENT)
        row = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = offs[:-1][row] + nth * SEGMENT
        size = np.minimum(lengths[row] - nth * SEGMENT, SEGMENT)
        sums = np.zeros((len(lengths), len(self.langs)))
        step = np.arange(SEGMENT)
        for a in range(0, len(row), WIDTH):
            s, n = start[a : a + WIDTH], size[a : a + WIDTH]
            mask = step[:, None] < n[None, :]
            x = buf[np.minimum(s[None, :] + step[:, None], len(buf) - 1)]
            y = self.positions(x, mask.astype(np.float32))
            np.add.at(sums, row[a : a + WIDTH], np.einsum("tnl,tn->nl", y, mask.astype(np.float32)))
        return sums / np.maximum(lengths, 1)[:, None]


def segments(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(x, mask) of the first SEGMENT bytes of each text."""
    buf, offs = K.texts(column)
    step = np.arange(SEGMENT)[:, None]
    mask = (step < np.diff(offs)[None, :]).astype(np.float32)
    return buf[np.minimum(offs[:-1][None, :] + step, max(0, len(buf) - 1))] if len(buf) else np.zeros((SEGMENT, len(offs) - 1), np.uint8), mask


def fold(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def sample(rows: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """lang, window: up to WINDOWS windows of up to per_lang distinct rows of each language of `rows` (doc_id, text, lang)."""
    own = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    known = written(own.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")))
    if known.count() > MOST_LANGS:  # the network grows with them
        raise ValueError(f"more than {MOST_LANGS} languages to learn")
    part = (F.col("hash").cast("double") + 2.0**63) / 2.0**64  # even over 0 to 1
    room = F.greatest(F.length("text") - SEGMENT, F.lit(0))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: (room * k / (WINDOWS - 1)).cast("int") + 1))
    cut = F.transform(starts, lambda s: F.substring("text", s, F.lit(SEGMENT)))
    low = own.join(F.broadcast(known), "lang").filter(part * F.col("n") <= SPARE * per_lang).select("lang", "hash", cut.alias("cut")).dropDuplicates(["lang", "hash"])
    got = low.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).filter(F.col("_n") <= per_lang)
    return got.select("lang", "hash", F.posexplode("cut").alias("place", "window"))


def train(rows: DataFrame, per_lang: int = PER_LANG, hidden: int = HIDDEN, steps: int = STEPS) -> Network | None:
    """A network fitted on a bounded sample of `rows` (doc_id, text, lang); None without labelled text."""
    got = sample(rows, per_lang).orderBy("lang", "hash", "place").select("lang", "window").toArrow()
    if not got.num_rows:
        return None
    langs = sorted(set(got.column("lang").to_pylist()))
    net = Network(langs, hidden)
    place = {k: i for i, k in enumerate(langs)}
    net.fit(*segments(got.column("window")), np.array([place[k] for k in got.column("lang").to_pylist()]), steps)
    return net


def _predict(held):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = held.value
        for batch in batches:
            buf, offs = K.texts(batch.column("text"))
            for a, b in K.slices(offs):
                rest = [c.slice(a, b - a) for c in batch.columns]
                if net is None:
                    best, score = ["und"] * (b - a), np.zeros(b - a)
                else:
                    lettered = np.array(batch.column("lettered").slice(a, b - a).to_pylist(), dtype=bool)
                    y = net.pooled(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                    best = np.where(lettered, np.array(net.langs, dtype=object)[y.argmax(axis=1)], "und").tolist()
                    score = np.where(lettered, np.clip(y.max(axis=1), 0, 1), 0.0)
                yield pa.record_batch([*rest, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """keep, lang_pred, score for each row of docs."""
    asked = docs.select(*keep, *([] if "text" in keep else ["text"]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    held = docs.sparkSession.sparkContext.broadcast(net)  # a few kilobytes
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    return in_arrow(asked, _predict(held), f"{schema}, lang_pred string, score double").select(*keep, "lang_pred", "score")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = fold(4) == 2
    net = train(docs.filter(F.coalesce(~out, F.lit(True))))
    return predict(docs.withColumn("held_out", F.coalesce(out, F.lit(False))), net, ["doc_id", "held_out"])
