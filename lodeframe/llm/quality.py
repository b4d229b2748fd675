"""A byte-level convolutional network for text quality, in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover it whole. Each byte has a learned vector; learned
filters run over windows of bytes in a chunk; every filter's rectified response is max-pooled over the chunk.
The document takes the mean, the largest and the least of its chunks' pooled responses, which one logistic unit
combines into a probability. Training is plain back-propagation with Adam; max-pooling sends a gradient only to the
window that won, so a step costs little more than a forward pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample

MOD, HELD, CUT = 5, 0, 0.3
ROWS = 2000  # labelled texts used for training, at most
CHUNK, OVERLAP, WIDTH, STRIDE, DIMS, FILTERS = 512, 64, 8, 2, 8, 24
BLOCK = 64  # chunks in memory at a time
SEED = "quality"


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(chunks x CHUNK bytes, bytes used in each); a text has one chunk at least."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, math.ceil((len(raw) - OVERLAP) / step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(raw)] = raw
    used = np.minimum(CHUNK, len(raw) - step * np.arange(n))
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step], used


@dataclass
class Net:
    emb: np.ndarray  # 256 x DIMS
    conv: np.ndarray  # WIDTH * DIMS x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 3 * FILTERS
    const: float

    @staticmethod
    def new(rng: np.random.Generator) -> Net:
        f = lambda *s, k: rng.normal(0, k, s).astype(np.float32)
        return Net(f(256, DIMS, k=0.5), f(WIDTH * DIMS, FILTERS, k=(2 / (WIDTH * DIMS)) ** 0.5), np.zeros(FILTERS, np.float32), f(3 * FILTERS, k=0.05), 0.0)

    def pool(self, c: np.ndarray, used: np.ndarray, where: bool = False):
        """Pooled responses of each chunk; with ``where`` also the byte windows that won."""
        x = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.emb[c], WIDTH, axis=1)[:, ::STRIDE].transpose(0, 1, 3, 2))
        k = x.shape[1]
        r = (x.reshape(-1, WIDTH * DIMS) @ self.conv).reshape(len(c), k, FILTERS)
        valid = np.maximum(1, (used - WIDTH) // STRIDE + 1)
        if (valid < k).any():
            r[np.arange(k)[None, :] >= valid[:, None]] = -np.inf
        if not where:
            return np.maximum(r.max(axis=1) + self.bias, 0)
        won = r.argmax(axis=1)
        top = np.take_along_axis(r, won[:, None], axis=1)[:, 0]
        return np.maximum(top + self.bias, 0), won

    def pooled(self, text: str | None) -> np.ndarray:
        c, used = chunks(text)
        return np.concatenate([self.pool(c[i : i + BLOCK], used[i : i + BLOCK]) for i in range(0, len(c), BLOCK)])

    def logit(self, h: np.ndarray) -> float:
        return float(np.concatenate([h.mean(axis=0), h.max(axis=0), h.min(axis=0)]) @ self.out + self.const)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Of many texts; chunks of short ones share blocks."""
        all_c, all_u, counts, out = [], [], [], []

        def flush() -> None:
            if counts:
                c, u = np.concatenate(all_c), np.concatenate(all_u)
                h = np.concatenate([self.pool(c[i : i + BLOCK], u[i : i + BLOCK]) for i in range(0, len(c), BLOCK)])
                at = np.cumsum([0, *counts[:-1]])
                v = np.concatenate([np.add.reduceat(h, at) / np.array(counts, np.float32)[:, None], np.maximum.reduceat(h, at), np.minimum.reduceat(h, at)], axis=1)
                out.extend((v @ self.out + self.const).tolist())
                for x in (all_c, all_u, counts):
                    x.clear()

        for t in texts:
            c, u = chunks(t)
            all_c.append(c)
            all_u.append(u)
            counts.append(len(c))
            if sum(counts) >= 8 * BLOCK:
                flush()
        flush()
        return np.array(out)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], labels: list[int], prior: float = 0.5, epochs: int = 8, batch: int = 32, rate: float = 4e-3) -> Net:
    """Fits the network to whole texts; ``prior`` is the share of label 1 where it will be used.

    Without rows of both classes the filters stay as drawn and the score is the prior's.
    """
    rng = np.random.default_rng(7)
    net, y = Net.new(rng), np.array(labels, dtype=np.float64)
    odds = math.log(prior / (1 - prior))
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.const = odds
        return net
    cut = [chunks(t) for t in texts]
    names = ("emb", "conv", "bias", "out")
    m = {k: np.zeros_like(getattr(net, k)) for k in names} | {"const": 0.0}
    v = {k: np.zeros_like(getattr(net, k)) for k in names} | {"const": 0.0}
    t, total = 0, epochs * math.ceil(len(y) / batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            g = {k: np.zeros_like(getattr(net, k)) for k in names} | {"const": 0.0}
            some = order[at : at + batch]
            for i in some:
                c, used = cut[i]
                hs, wons = zip(*(net.pool(c[j : j + BLOCK], used[j : j + BLOCK], True) for j in range(0, len(c), BLOCK)), strict=True)
                h, won = np.concatenate(hs), np.concatenate(wons)
                feats = np.concatenate([h.mean(axis=0), h.max(axis=0), h.min(axis=0)])
                d = np.float32(probability(feats @ net.out + net.const) - y[i])
                g["out"] += d * feats
                g["const"] += float(d)
                w = d * net.out.reshape(3, FILTERS)
                gh = np.repeat(w[:1] / len(h), len(h), axis=0)
                cols = np.arange(FILTERS)
                gh[h.argmax(axis=0), cols] += w[1]
                gh[h.argmin(axis=0), cols] += w[2]
                gh *= h > 0
                g["bias"] += gh.sum(axis=0)
                at_bytes = won[:, :, None] * STRIDE + np.arange(WIDTH)
                b = c[np.arange(len(c))[:, None, None], np.minimum(at_bytes, CHUNK - 1)]  # chunks x FILTERS x WIDTH
                x = net.emb[b].reshape(len(h), FILTERS, WIDTH * DIMS)
                g["conv"] += np.einsum("cf,cfk->kf", gh, x)
                np.add.at(g["emb"], b, (gh[:, :, None] * net.conv.T[None]).reshape(len(h), FILTERS, WIDTH, DIMS))
            t += 1
            lr = rate * (1 - 0.9 * t / total)
            for k in g:
                gk = g[k] / len(some) + (1e-4 * getattr(net, k) if k != "const" else 0)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk**2
                step = lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, getattr(net, k) - step)
    share = y.mean()
    net.const = float(net.const + odds - math.log(share / (1 - share)))
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Net:
    """A network from at most ``rows`` labelled texts outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", MOD, HELD, rows, SEED)
    share = labels.where((fold("doc_id", MOD) != HELD) & F.col("quality").isNotNull()).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return train([t for _, t, _ in sample], [y for _, _, y in sample], min(0.98, max(0.02, 0.5 if share is None else share)))


def score(docs: DataFrame, net: Net, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a null text counts as empty and has one blank chunk.

    Repeated rows and null ids are scored like any other; columns besides doc_id and text aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([probability(net.logits(b.column(1)[i : i + 256].to_pylist())) for i in range(0, b.num_rows, 256)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold("doc_id", MOD) == HELD).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )
