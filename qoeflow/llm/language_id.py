"""Language identification by a bidirectional gated recurrent network over
bytes, trained in numpy by backpropagation through time.

A text's UTF-8 bytes are cut into segments of ``SEGMENT`` bytes; a forward and
a backward GRU read each segment, every byte position gets language
probabilities from both states, and a document's probabilities are the mean
over all its positions.  Every byte of every text is read.

The network is fitted on the driver on a bounded sample: about ``per_lang``
documents of each language, chosen by a hash of the doc_id (one row of each
id), with their whole texts: every segment is in the pool that training batches
are drawn from.  Documents whose
crc32(doc_id as text) mod 4 is 2 are held out.  Prediction runs in the tasks;
what is shipped there is the network's weights, whose size is fixed.

Defined results: null text or text without a letter is ``und`` with score 0;
a document without doc_id is neither held out nor learned from; without any
labelled text every document is ``und``; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qoeflow.llm.common import release, text_blocks

SEGMENT = 128
HIDDEN = 8
PER_LANG = 1500
STEPS = 400
BATCH = 128
#: Segments read side by side.
LANES = 1024
BLOCK_BYTES = 1 << 20


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def reverse_index(length: np.ndarray, width: int) -> np.ndarray:
    """Position that is read at each step backwards (padding stays last)."""
    t = np.arange(width)
    return np.where(t < length[:, None], length[:, None] - 1 - t, t)


class ByteGru:
    """Weights: wx (2*256, 3H) input rows by direction and byte, u (2, H, 3H),
    b (2, 1, 3H) recurrent, wo (2H, C) and bo (C,) output."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        s = 1 / np.sqrt(hidden)
        self.p = {"wx": rng.normal(0, 0.3, (512, 3 * hidden)), "u": rng.uniform(-s, s, (2, hidden, 3 * hidden)),
                  "b": np.zeros((2, 1, 3 * hidden)), "wo": rng.normal(0, 0.3, (2 * hidden, len(langs))),
                  "bo": np.zeros(len(langs))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, length: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (2, T, B, H) of byte segments x (B, T), aligned to positions."""
        n, width = x.shape
        h_size, p = self.h, self.p
        back = np.take_along_axis(x, reverse_index(length, width), 1)
        steps = np.concatenate([x, back.astype(np.int32) + 256]).T.astype(np.int32)   # (T, 2B)
        out = np.empty((2, width, n, h_size), np.float32)
        h = np.zeros((2, n, h_size), np.float32)
        for t in range(width):
            a = p["wx"].take(steps[t], axis=0).reshape(2, n, 3 * h_size)
            r = np.matmul(h, p["u"])
            r += p["b"]
            a[..., :2 * h_size] += r[..., :2 * h_size]
            gate = a[..., :2 * h_size]
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            keep, reset = gate[..., :h_size], gate[..., h_size:]
            new = a[..., 2 * h_size:]
            new += reset * r[..., 2 * h_size:]
            np.tanh(new, out=new)
            if tape is not None:
                tape.append((steps[t], h, keep.copy(), reset.copy(), new.copy(), r[..., 2 * h_size:].copy()))
            h = new + keep * (h - new)
            out[:, t] = h
        back_at = reverse_index(length, width).T
        out[1] = out[1][back_at, np.arange(n)[None, :]]
        return out

    def logits(self, states: np.ndarray) -> np.ndarray:
        wo, h = self.p["wo"], self.h
        return states[0] @ wo[:h] + states[1] @ wo[h:] + self.p["bo"]

    def gradients(self, x, length, label):
        """Mean cross-entropy over positions and its gradients, by
        backpropagation through time."""
        n, width = x.shape
        h_size, p, tape = self.h, self.p, []
        s = self.states(x, length, tape)
        z = self.logits(s)
        z -= z.max(-1, keepdims=True)
        e = np.exp(z)
        prob = e / e.sum(-1, keepdims=True)
        mask = (np.arange(width)[:, None] < length[None, :]).astype(np.float32)
        total = mask.sum()
        hit = prob[:, np.arange(n), label]
        loss = float(-(np.log(hit + 1e-9) * mask).sum() / total)
        dz = prob
        dz[:, np.arange(n), label] -= 1
        dz *= (mask / total)[..., None]
        g = {"bo": dz.sum((0, 1)), "wo": np.concatenate([
            np.tensordot(s[d], dz, axes=((0, 1), (0, 1))) for d in range(2)])}
        ds = np.stack([dz @ p["wo"][:h_size].T, dz @ p["wo"][h_size:].T])
        # the backward states were aligned to positions; undo it for its own steps
        ds[1] = ds[1][reverse_index(length, width).T, np.arange(n)[None, :]]
        g["wx"], g["u"], g["b"] = np.zeros_like(p["wx"]), np.zeros_like(p["u"]), np.zeros_like(p["b"])
        dh = np.zeros((2, n, h_size), np.float32)
        for t in range(width - 1, -1, -1):
            rows, h, keep, reset, new, rec = tape[t]
            dh = dh + ds[:, t]
            d_new = dh * (1 - keep) * (1 - new * new)
            d_keep = dh * (h - new) * keep * (1 - keep)
            d_reset = d_new * rec * reset * (1 - reset)
            d_in = np.concatenate([d_keep, d_reset, d_new], -1)
            d_rec = np.concatenate([d_keep, d_reset, d_new * reset], -1)
            np.add.at(g["wx"], rows, d_in.reshape(2 * n, -1))
            g["u"] += np.matmul(h.transpose(0, 2, 1), d_rec)
            g["b"] += d_rec.sum(1, keepdims=True)
            dh = dh * keep + np.matmul(d_rec, p["u"].transpose(0, 2, 1))
        return loss, g

    def fit(self, x, length, label, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 2):
        """Adam on random batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            _, g = self.gradients(x[pick], length[pick], label[pick])
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, w in self.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                w -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        return self

    def read(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sums (C, N) of the position probabilities of segments x (T, N).

        The same network as ``states``, with lanes innermost; the backward
        state stays zero until a lane's last byte."""
        width, n = x.shape
        h_size, p, c = self.h, self.p, len(self.langs)
        # sigmoid(v) = (1 + tanh(v / 2)) / 2: one tanh serves gates and candidates
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), h_size)
        wx = np.ascontiguousarray((p["wx"].reshape(2, 256, -1) * half).transpose(0, 2, 1))
        u = np.ascontiguousarray((p["u"] * half).transpose(0, 2, 1))
        b = (p["b"] * half).transpose(0, 2, 1)
        wo = np.ascontiguousarray(p["wo"].reshape(2, h_size, c).transpose(0, 2, 1))
        z = np.empty((width, c, n), np.float32)
        z[:] = p["bo"][:, None]
        h = np.zeros((2, h_size, n), np.float32)
        a, r = np.empty((2, 3 * h_size, n), np.float32), np.empty((2, 3 * h_size, n), np.float32)
        gate, reset = a[:, :2 * h_size], a[:, h_size:2 * h_size]
        keep, new, rec = a[:, :h_size], a[:, 2 * h_size:], r[:, 2 * h_size:]
        o = np.empty((2, c, n), np.float32)
        ragged = int(length.min()) < width
        for t in range(width):
            wx[0].take(x[t], axis=1, out=a[0], mode="clip")
            wx[1].take(x[width - 1 - t], axis=1, out=a[1], mode="clip")
            np.matmul(u, h, out=r)
            r += b
            gate += r[:, :2 * h_size]
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            rec *= reset
            new += rec
            np.tanh(new, out=new)
            h -= new
            h *= keep
            h += new
            if ragged:
                h[1] *= length > width - 1 - t
            np.matmul(wo, h, out=o)
            z[t] += o[0]
            z[width - 1 - t] += o[1]
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        if ragged:
            z *= (np.arange(width)[:, None] < length)[:, None, :]
        return z.sum(0, dtype=np.float64)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities (documents, languages); all zero for an
        empty text."""
        total = np.zeros((len(texts), len(self.langs)))
        count = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.cumsum(count) - count
        per = -(-count // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), per)
        off = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT
        length = np.minimum(count[doc] - off, SEGMENT)
        begin = first[doc] + off
        order = np.argsort(-length, kind="stable")      # lanes of like length together
        for at in range(0, len(order), LANES):
            lane = order[at:at + LANES]
            place = np.arange(int(length[lane[0]]))[:, None] + begin[lane]
            np.minimum(place, len(data) - 1, out=place)
            np.add.at(total, doc[lane], self.read(data[place], length[lane]).T)
        return total / np.maximum(count, 1)[:, None]


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = PER_LANG, steps: int = STEPS) -> ByteGru | None:
    """Network fitted on the sample described above; None without labelled text."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                        held_out(id_col).alias("out")).filter("not out and id is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = known.filter(draw < share[F.col("lang")]).filter(F.col("text").rlike("\\p{L}"))
    # an id counts once, however many rows have it: one row comes to the driver for each
    rows = (drawn.groupBy("id").agg(F.min_by(F.struct("lang", F.col("text").cast("binary").alias("text")),
                                             F.xxhash64("text", "lang")).alias("x")).select("id", "x.*").collect())
    rows = sorted((r["id"], r["lang"], bytes(r["text"])) for r in rows)
    if not rows:
        return None
    langs = sorted({r[1] for r in rows})
    # every segment of the whole texts, as in prediction
    parts = [(langs.index(lang), text[a:a + SEGMENT]) for _, lang, text in rows for a in range(0, len(text), SEGMENT)]
    x = np.zeros((len(parts), SEGMENT), np.uint8)
    for i, (_, part) in enumerate(parts):
        x[i, :len(part)] = np.frombuffer(part, np.uint8)
    length = np.array([len(part) for _, part in parts])
    label = np.array([k for k, _ in parts])
    # languages count alike however many segments they have
    pick = np.concatenate([np.resize(np.flatnonzero(label == k), np.bincount(label).max()) for k in range(len(langs))])
    return ByteGru(langs).fit(x[pick], length[pick], label[pick], steps=steps)


def predict(docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    def run(batches):
        for b in batches:
            letter = b.column("letter").to_pylist()
            lang, score = [], []
            for first, end, texts in text_blocks(b.column("text"), BLOCK_BYTES):
                texts = [t if ok else b"" for t, ok in zip(texts, letter[first:end])]
                if model is None:
                    lang += ["und"] * (end - first)
                    score += [0.0] * (end - first)
                    continue
                prob = model.pooled(texts)
                best = prob.argmax(1)
                for i in range(end - first):
                    ok = letter[first + i]
                    lang.append(model.langs[best[i]] if ok else "und")
                    score.append(min(1.0, float(prob[i, best[i]])) if ok else 0.0)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"),
                                   "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})
            release()
    letter = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("letter")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), letter,
                        F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
