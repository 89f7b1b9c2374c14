"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a text's UTF-8 bytes in both directions.  Each direction is a gated recurrent unit (update
gate, reset gate, candidate) whose squashing is softsign, x / (1 + |x|), in place of tanh and logistic; the
two states at a byte give the class probabilities at that byte.  It is trained by backpropagation through time
on the cross-entropy of every position.  A text's score is the mean over all of its positions; long texts are
read in segments, every byte of which is labelled.

Training learns from the text and the non-null language of documents whose crc32(doc_id as text) mod 5 is not
0; ``per_class`` windows of ``window`` characters a language are gathered, chosen by a hash of the row, which
bounds what reaches the driver.  The weights (a few kB) are broadcast.

Plan: one aggregation by language, one bounded gather, then a narrow pass; no shuffle of texts.

Edge cases.  Null text, or one without a letter: `und`, score 0.  Without training rows every text is `und`.
Repeated documents: a row each.  Null doc_id: never held out (its checksum is null).  Ties go to the first
language in order.  Input columns named like an output column are replaced, all others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

PER_CLASS, WINDOW = 400, 192
HIDDEN, SEGMENT, WIDTH = 8, 128, 1024
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, per_class: int = PER_CLASS, window: int = WINDOW) -> list[tuple[str, str]]:
    """(language, window of a text), at most per_class a language, from documents that are not held out."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.char_length("text") >= 8) & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.5 * per_class / n)).otherwise(share)
    start = F.pmod(F.xxhash64("text"), F.greatest(F.char_length("text") - window, F.lit(1))) + 1
    picked = rows.where(unit < share).select("lang", F.xxhash64("doc_id", "text").alias("h"), F.substr("text", start.cast("int"), F.lit(window)).alias("t"))
    by: dict[str, list] = {}
    for r in picked.collect():
        by.setdefault(r["lang"], []).append((r["h"], r["t"]))
    return [(lang, t) for lang in sorted(by) for _, t in sorted(by[lang])[:per_class]]


class Network:
    """Both directions stacked: E (2, 3H, 256) input terms by byte, U (2, 3H, H), V (C, 2H), c (C)."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes, self.h = list(classes), hidden
        k = len(self.classes)
        self.p = {
            "E": rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(np.float32),
            "U": rng.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(np.float32),
            "V": rng.normal(0, 0.3, (k, 2 * hidden)).astype(np.float32),
            "c": np.zeros((k, 1), np.float32),
        }

    def states(self, x: np.ndarray, valid: np.ndarray, keep: bool = False):
        """x, valid: (T, N).  States (T, 2, H, N) in reading order of each direction, and what training needs."""
        (steps, n), h = x.shape, self.h
        E, U = self.p["E"], self.p["U"]
        out = np.empty((steps, 2, h, n), np.float32)
        s, kept = np.zeros((2, h, n), np.float32), []
        a = np.empty((2, 3 * h, n), np.float32)
        for t in range(steps):
            b = steps - 1 - t
            np.take(E[0], x[t], axis=1, out=a[0], mode="clip")
            np.take(E[1], x[b], axis=1, out=a[1], mode="clip")
            g = np.matmul(U, s)
            gates = a[:, : 2 * h] + g[:, : 2 * h]
            d = np.abs(gates)
            d += 1
            gates /= d
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :h], gates[:, h:]
            m = r * g[:, 2 * h :]
            m += a[:, 2 * h :]
            d = np.abs(m)
            d += 1
            m /= d
            new = s - m
            new *= z
            new += m
            new[1] *= valid[b]  # padding is read first from behind, and must leave no trace
            if keep:
                kept.append((s, g, z, r, m))
            out[t] = s = new
        return out, kept

    def logits(self, st: np.ndarray) -> np.ndarray:
        """(C, T, N)"""
        h = self.h
        f, b = st[:, 0], st[::-1, 1]
        return np.einsum("ch,thn->ctn", self.p["V"][:, :h], f, optimize=True) + np.einsum("ch,thn->ctn", self.p["V"][:, h:], b, optimize=True) + self.p["c"][:, :, None]

    def probabilities(self, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Sum over valid positions of the class probabilities: (C, N)."""
        st, _ = self.states(x, valid)
        h, (steps, n) = self.h, x.shape
        total = np.zeros((len(self.classes), n), np.float32)
        Vf, Vb, c = self.p["V"][:, :h], self.p["V"][:, h:], self.p["c"]
        for t in range(steps):
            e = np.exp(Vf @ st[t, 0] + Vb @ st[steps - 1 - t, 1] + c)
            e *= valid[t] / e.sum(axis=0)
            total += e
        return total

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[float, dict]:
        """Loss a position, and its gradient by backpropagation through time."""
        h, (steps, n) = self.h, x.shape
        st, kept = self.states(x, valid, keep=True)
        lo = self.logits(st)
        lo -= lo.max(axis=0)
        p = np.exp(lo)
        p /= p.sum(axis=0)
        weight = valid / valid.sum()
        loss = float(-(np.log(np.take_along_axis(p, y[None, None, :].repeat(steps, 1), 0)[0] + 1e-9) * weight).sum())
        p[y, :, np.arange(n)] -= 1
        d = p * weight
        V, U = self.p["V"], self.p["U"]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["c"] = d.sum(axis=(1, 2))[:, None]
        g["V"][:, :h] = np.einsum("ctn,thn->ch", d, st[:, 0], optimize=True)
        g["V"][:, h:] = np.einsum("ctn,thn->ch", d, st[::-1, 1], optimize=True)
        ds = np.empty_like(st)
        ds[:, 0] = np.einsum("ch,ctn->thn", V[:, :h], d, optimize=True)
        ds[:, 1] = np.einsum("ch,ctn->thn", V[:, h:], d, optimize=True)[::-1]
        back = np.zeros((2, h, n), np.float32)
        da = np.empty((2, 3 * h, n), np.float32)
        Ut = U.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            s, gg, z, r, m = kept[t]
            b = steps - 1 - t
            dn = ds[t] + back
            dn[1] *= valid[b]
            dm = dn * (1 - z) * (1 - np.abs(m)) ** 2
            dz = dn * (s - m) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dm * gg[:, 2 * h :] * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            da[:, :h], da[:, h : 2 * h], da[:, 2 * h :] = dz, dr, dm
            dg = da.copy()
            dg[:, 2 * h :] *= r
            back = dn * z + np.matmul(Ut, dg)
            g["U"] += np.matmul(dg, s.transpose(0, 2, 1))
            for k, at in ((0, x[t]), (1, x[b])):
                one = np.zeros((n, 256), np.float32)
                one[np.arange(n), at] = 1
                g["E"][k] += da[k] @ one
        return loss, g

    def train(self, rows: list[tuple[str, str]], steps: int = 220, batch: int = 96, length: int = 48, rate: float = 0.02, seed: int = 2) -> list[float]:
        rng = np.random.default_rng(seed)
        by = [[t.encode("utf-8", "surrogatepass") for lang, t in rows if lang == k] for k in self.classes]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses = []
        for i in range(1, steps + 1):
            y = rng.integers(len(self.classes), size=batch)
            x, valid = np.zeros((length, batch), np.uint8), np.zeros((length, batch), np.float32)
            for j, k in enumerate(y):
                data = by[k][rng.integers(len(by[k]))]
                at = rng.integers(max(1, len(data) - length + 1))
                part = np.frombuffer(data[at : at + length], np.uint8)
                x[: len(part), j], valid[: len(part), j] = part, 1
            loss, g = self.gradients(x, y, valid)
            losses.append(loss)
            step = rate * min(1.0, 2 * (1 - i / (steps + 1)))
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, w in self.p.items():
                a = g[k] * min(1.0, 1 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                w -= step * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
        return losses

    def predict(self, texts: list[str | None], segment: int = SEGMENT, width: int = WIDTH) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        sums = np.zeros((len(texts), len(self.classes)))
        sizes = np.zeros(len(texts), np.int64)
        held, owner, n = [], [], 0

        def flush() -> None:
            data = np.concatenate(held)
            x = data.reshape(-1, segment)
            own = np.concatenate([np.full(k, i) for i, k in owner])
            last = np.array([k for _, k in owner]).cumsum() - 1
            fill = np.full(len(x), segment)
            fill[last] = [f for f in tails]
            for a in range(0, len(x), width):
                part = np.ascontiguousarray(x[a : a + width].T)
                valid = (np.arange(segment)[:, None] < fill[None, a : a + width]).astype(np.float32)
                np.add.at(sums, own[a : a + width], self.probabilities(part, valid).T)

        tails: list[int] = []
        for i, t in enumerate(texts):
            if not t or not _LETTER.search(t) or not self.classes:
                continue
            data = t.encode("utf-8", "surrogatepass")
            sizes[i] = len(data)
            step = segment * width
            for a in range(0, len(data), step):  # a very long text goes through in parts of whole segments
                part = data[a : a + step]
                k = -(-len(part) // segment)
                x = np.zeros(k * segment, np.uint8)
                x[: len(part)] = np.frombuffer(part, np.uint8)
                held.append(x)
                owner.append((i, k))
                tails.append(len(part) - (k - 1) * segment)
                n += k
                if n >= 4 * width:
                    flush()
                    held.clear(), owner.clear(), tails.clear()
                    n = 0
        if held:
            flush()
        for i in np.flatnonzero(sizes):
            p = sums[i] / sizes[i]
            k = int(p.argmax())
            out[i] = (self.classes[k], float(min(1.0, p[k])))
        return out


def fit(docs: DataFrame, per_class: int = PER_CLASS, window: int = WINDOW, hidden: int = HIDDEN) -> Network:
    rows = training_rows(docs, per_class, window)
    net = Network(sorted({lang for lang, _ in rows}), hidden)
    if rows:
        net.train(rows)
    return net


def identify(docs: DataFrame, model: Network | None = None) -> DataFrame:
    """The columns of docs with held_out, lang_pred and score; the model is fitted to docs if none is given."""
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model or fit(docs))
    carry = [c for c in docs.columns if c.lower() not in ("held_out", "lang_pred", "score")]
    docs = docs.select(*carry, held_out(F.col("doc_id")).alias("held_out"))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
