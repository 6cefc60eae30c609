"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it.  Bytes are
embedded, learned filters slide over every chunk, and each filter's largest response
in the chunk stands for it.  The greatest and the mean response over the chunks feed
one logistic unit, so that long and short documents look alike.  Training is plain
back-propagation with Adam on a bounded, balanced sample of labelled rows.

Embedding and filters end as whole multiples of 1 / ``PARTS``.  In double precision their
products and sums are then exact, whatever order a processor's matrix kernel adds them in,
so that no score depends on the rows that are scored with it.

Defined results: null and empty texts are one chunk of padding and get a score; a text
of any length is scored in slices of chunks with bounded memory; repeated rows get
the same score; empty tables give empty tables; with only one label in the sample
the score leans to that label.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import in_parts, without

CHUNK, OVERLAP = 1024, 64
BLOCK, TAPS = 4, 4  # a filter sees TAPS blocks of BLOCK bytes and moves by one block
SLICE_CHUNKS = 512
#: Of a weight; a response has the square of it, and 2 ** 21 chunks of responses up to 256 still
#: add up exactly in the 53 bits of a double.
PARTS = 1 << 12


def chunks(text: bytes) -> np.ndarray:
    """(n, CHUNK) bytes; padded with zero bytes."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    padded = np.zeros(n * step + OVERLAP, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class ByteCNN:
    def __init__(self, embed: int = 8, filters: int = 32, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "table": rng.normal(0, 0.5, (256, embed)), "conv": rng.normal(0, 0.25, (BLOCK * embed, TAPS * filters)),
            "bias": np.zeros(filters), "head": rng.normal(0, 0.1, 2 * filters), "out": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.embed, self.filters = embed, filters
        self._to_parts()

    def _to_parts(self):
        for name, parts in (("table", PARTS), ("conv", PARTS), ("bias", PARTS * PARTS)):
            self.p[name] = np.round(self.p[name] * parts) / np.float32(parts)

    def responses(self, codes: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
        """(n, CHUNK) bytes -> (n, positions, filters) before the pooling, under the weights ``p``."""
        n = len(codes)
        blocks = p["table"].take(codes, axis=0).reshape(n * (CHUNK // BLOCK), BLOCK * self.embed)
        part = (blocks @ p["conv"]).reshape(n, CHUNK // BLOCK, TAPS, self.filters)
        m = CHUNK // BLOCK - TAPS + 1
        out = part[:, :m, 0] + part[:, 1 : m + 1, 1]
        for t in range(2, TAPS):
            out += part[:, t : m + t, t]
        return out

    def pooled(self, codes: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
        """Largest response of each filter in each chunk."""
        return np.concatenate([np.maximum(self.responses(codes[s : s + 64], p).max(1) + p["bias"], 0) for s in range(0, len(codes), 64)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        held, owner, acc = [], [], {}
        p = {k: v.astype(np.float64) for k, v in self.p.items()}

        def flush():
            for i, v in zip(owner, np.split(self.pooled(np.concatenate(held), p), np.cumsum([len(h) for h in held])[:-1])):
                top, total, n = acc.get(i, (0.0, 0.0, 0))
                acc[i] = np.maximum(top, v.max(0)), total + v.sum(0), n + len(v)
            held.clear()
            owner.clear()

        size = 0
        for i, text in enumerate(texts):
            c = chunks(text)
            for s in range(0, len(c), SLICE_CHUNKS):
                held.append(c[s : s + SLICE_CHUNKS])
                owner.append(i)
                size += len(held[-1])
                if size >= SLICE_CHUNKS:
                    flush()
                    size = 0
        if held:
            flush()
        for i, (top, total, n) in acc.items():
            z = math.fsum([*(np.concatenate((top, total / n)) * p["head"]).tolist(), float(p["out"][0])])
            out[i] = 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))
        return out

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 10, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 9) -> ByteCNN:
        if not texts:
            return self
        y = np.array(labels, np.float32)
        share = np.clip([(y == k).mean() for k in (0, 1)], 1e-3, None)
        weight = 0.5 / share[y.astype(int)]  # both labels count alike
        cut = [chunks(t) for t in texts]
        rng, moments, step = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(cut))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                grads = self._gradients([cut[i] for i in rows], y[rows], weight[rows])
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= (rate / (1 + step / 400)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        self._to_parts()
        return self

    def _gradients(self, cut, y, weight):
        codes, ends = np.concatenate(cut), np.cumsum([len(c) for c in cut])
        where = np.empty((len(codes), self.filters), np.int64)
        best = np.empty((len(codes), self.filters), np.float32)
        for s in range(0, len(codes), 64):
            r = self.responses(codes[s : s + 64], self.p)
            where[s : s + 64] = r.argmax(1)
            best[s : s + 64] = r.max(1)
        act = np.maximum(best + self.p["bias"], 0)
        d_act = np.zeros_like(act)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        f = self.filters
        for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
            part = act[a:b]
            top = part.argmax(0)
            feats = np.concatenate((part.max(0), part.mean(0)))
            z = float(feats @ self.p["head"] + self.p["out"][0])
            d = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(cut)
            g["head"] += d * feats
            g["out"] += d
            d_act[a + top, np.arange(f)] += d * self.p["head"][:f]
            d_act[a:b] += d * self.p["head"][f:] / (b - a)
        d_act *= act > 0
        g["bias"] += d_act.sum(0)
        c, k = np.nonzero(d_act)
        flow = d_act[c, k]
        seen = codes[c[:, None], where[c, k][:, None] * BLOCK + np.arange(BLOCK * TAPS)]  # (m, bytes of the filter)
        emb = self.p["table"][seen].reshape(len(c), TAPS, BLOCK * self.embed)
        conv = self.p["conv"].reshape(BLOCK * self.embed, TAPS, f)
        d_conv = np.zeros((f, TAPS, BLOCK * self.embed), np.float32)
        np.add.at(d_conv, k, flow[:, None, None] * emb)
        g["conv"] += d_conv.transpose(2, 1, 0).reshape(g["conv"].shape)
        d_emb = flow[:, None, None] * conv.transpose(2, 1, 0)[k]
        np.add.at(g["table"], seen.reshape(-1), d_emb.reshape(-1, self.embed))
        return g


def score(df: DataFrame, model: ByteCNN, text_col: str = "text", output: str = "score") -> DataFrame:
    """``df`` with the probability ``output`` that its label is 1 (in place of an input
    column of that name)."""
    df = without(df, output, keep=(text_col,))

    def run(batches):
        for batch in in_parts(batches):
            texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(texts), pa.float64())], [*batch.schema.names, output])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())]))
