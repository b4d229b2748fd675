"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library's own trainer: one on windows of ordinary documents, one on toxic
text. Only documents carry labels and most of a toxic document reads like any other, so a trainer given whole toxic
documents would pick what both classes share. It is therefore given the stretches of toxic documents whose grams are
significantly and several times commoner there (a likelihood-ratio test that expects one false gram in all), a
character around each. The ordinary content follows at the same distances in both dictionaries, so a window without
such a stretch compresses to the same length under both, and a window with one is shorter under the toxic dictionary.

A document is cut into overlapping windows that cover it whole. How many windows save at least 1, 2, ... bytes, of how many,
goes through a logistic curve. Its features are cross-fitted: every labelled document is measured with dictionaries
that haven't seen it. The curve's cut is calibrated on them, and a score that doesn't tell the classes apart
rejects nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample

MOD, HELD, CUT = 3, 1, 0.7
ROWS = 2400  # labelled texts used for training, at most
WINDOW, STEP, LEVEL, MATCH, STEPS = 128, 112, 13, 5, 5
GRAM, FALSE, TIMES, CORE, AROUND, TOXIC, ORDINARY = 5, 1.0, 2, 0.4, 1, 4096, 1024
FOLDS = 3
APART = 10.83  # likelihood ratio of a cut that tells the classes apart at one in a thousand
SEED = "toxic"


def plain(text: str | None) -> bytes:
    """ASCII lower case, single spaces, a space at either end."""
    return b" " + b" ".join((text or "").encode().lower().split()) + b" "


def windows(raw: bytes, window: int = WINDOW, step: int = STEP) -> list[bytes]:
    return [raw[i : i + window] for i in range(0, max(1, len(raw) - (window - step)), step)]


def _codes(raw: bytes) -> np.ndarray:
    """A number for each gram of ``raw``, by position."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    if len(b) < GRAM:
        return np.empty(0, np.int64)
    return sum(b[k : len(b) - GRAM + 1 + k] << (8 * k) for k in range(GRAM))


def _spread(texts: list[bytes]) -> list[bytes]:
    """One text of each set of likely copies: texts that share one of three least hashes of 5 grams in a row."""
    seen: set = set()
    out = []
    for t in texts:
        c = _codes(t)
        if not len(c):
            continue
        with np.errstate(over="ignore"):
            far = np.int64(0)
            for k in range(5):
                far = far * np.int64(6364136223846793005) + c[min(len(c) - 1, k * GRAM) : len(c) - (4 - k) * GRAM if len(c) > 4 * GRAM else None][: max(1, len(c) - 4 * GRAM)]
            keys = {(k, int(((far + k) * np.int64(-7046029254386353131 + 2 * k) ^ (far >> 29)).min())) for k in range(3)}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every gram and the number of texts that hold it."""
    return np.unique(np.concatenate([np.unique(_codes(t)) for t in texts] or [np.empty(0, np.int64)]), return_counts=True)


def ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The likelihood-ratio statistic of ``a`` of ``n1`` against ``b`` of ``n0``."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    p = (a + b) / (n1 + n0)
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    return 2 * (part(a, n1 * p) + part(b, n0 * p) + part(n1 - a, n1 * (1 - p)) + part(n0 - b, n0 * (1 - p)))


def telling(toxic: list[bytes], ordinary: list[bytes], false: float = FALSE) -> tuple[np.ndarray, np.ndarray]:
    """Grams at least TIMES and significantly commoner in ``toxic`` texts, sorted, and their statistics; about ``false`` are so by chance."""
    (u, a), (v, b) = _counts(toxic), _counts(ordinary)
    if not len(u) or not len(v):
        return np.empty(0, np.int64), np.empty(0)
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    other = np.where(v[at] == u, b[at], 0)
    g = ratio(a, other, len(toxic), len(ordinary))
    good = (g >= 2 * math.log(len(u) / false)) & (a * len(ordinary) >= TIMES * (other + 0.5) * len(toxic))
    return u[good], g[good]


def stretches(toxic: list[bytes], grams: np.ndarray, worth: np.ndarray) -> list[bytes]:
    """Where telling grams follow each other: their core (grams around it only go along with it) and AROUND bytes."""
    out = []
    for t in toxic:
        c = _codes(t)
        hit = np.flatnonzero(np.isin(c, grams))
        if len(hit):
            for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                w = worth[np.searchsorted(grams, c[run])]
                core = run[w >= CORE * w.max()]
                out.append(t[max(0, core[0] - AROUND) : core[-1] + GRAM + AROUND])
    return out


def content(samples: list[bytes], size: int) -> bytes:
    """What the zstandard trainer keeps of ``samples``; of too few samples to train on, the distinct ones, commonest last."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size + 512, samples, k=16, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        out = b""
        for s, _ in sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0])):
            out = s + out if s not in out else out
        return out[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary content."""
    own = content(stretches(toxic, *telling(toxic, ordinary)), TOXIC)
    return own, content([w for t in ordinary for w in windows(t)], ORDINARY)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    shift: float

    def compressors(self) -> tuple:
        out = []
        for held in (self.ordinary, self.toxic + self.ordinary):
            p = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=WINDOW, dict_size=max(8, len(held)), min_match=MATCH,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            d = zstandard.ZstdCompressionDict(held.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        return tuple(out)

    def saved(self, text: str | None, both: tuple) -> list[int]:
        """Bytes that the toxic dictionary saves in each window."""
        a, b = both
        return [len(a.compress(w)) - len(b.compress(w)) for w in windows(plain(text))]

    def measures(self, text: str | None, both: tuple) -> list[float]:
        """Windows that save at least 1, ... STEPS bytes, bytes saved, and windows, as logarithms; the most saved."""
        d = Counter(self.saved(text, both))
        at_least = [math.log1p(sum(n for x, n in d.items() if x >= k)) for k in range(1, STEPS + 1)]
        return [*at_least, math.log1p(sum(x * n for x, n in d.items() if x > 0)), math.log(sum(d.values())), float(max(d))]

    def score(self, text: str | None, both: tuple) -> float:
        z = self.weights[0] + self.shift
        if self.toxic:
            z += sum(w * x for w, x in zip(self.weights[1:], self.measures(text, both), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve, constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * len(x)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray, prior: float) -> float | None:
    """The cut with the best F1 when a share ``prior`` of the population is labelled 1; midway between scores.

    None if what it rejects isn't significantly oftener labelled 1 than the rest, as with scores that are all the same.
    """
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    ones, zeros = y.sum(), (1 - y).sum()
    tp, fp = np.cumsum(y), np.cumsum(1 - y)
    f1 = 2 * tp / max(1, ones) * prior / (tp / max(1, ones) * prior + fp / max(1, zeros) * (1 - prior) + prior)
    ends = np.append(z[1:] != z[:-1], False)  # the last cut rejects all
    sure = (ratio(tp, fp, ones, zeros) >= APART) & (tp * zeros > fp * ones)
    f1 = np.where(ends & sure, f1, -1.0)
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if f1[k] > 0 else None


def train(texts: list[str], labels: list[int], prior: float = 0.1, cut: float = CUT) -> Model:
    """Dictionaries from all rows; the curve and its cut from measures by dictionaries of the other folds.

    Likely copies count once. Without rows of both classes, without telling grams, or with scores that don't tell the
    classes apart, every document scores the same, below the cut.
    """
    nothing = Model(b"", b"", (-3.0,), 0.0)
    kept: dict[int, list[bytes]] = {v: _spread([plain(t) for t, y in zip(texts, labels, strict=True) if y == v]) for v in (0, 1)}
    if not kept[0] or not kept[1]:
        return nothing
    toxic, ordinary = dictionaries(kept[1], kept[0])
    if not toxic:
        return nothing
    x, y = [], []
    for k in range(FOLDS):
        seen = {v: [t for i, t in enumerate(ts) if i % FOLDS != k] for v, ts in kept.items()}
        part = Model(*dictionaries(seen[1], seen[0]), (0.0,), 0.0)
        both = part.compressors()
        for v, ts in kept.items():
            x += [part.measures(t.decode(), both) for t in ts[k::FOLDS]]
            y += [v] * len(ts[k::FOLDS])
    x, y = np.array(x), np.array(y, float)
    w = logistic(x, y, 1e-3)
    if (at := best_cut(w[0] + x @ w[1:], y, prior)) is None:
        return nothing
    return Model(toxic, ordinary, tuple(w.tolist()), math.log(cut / (1 - cut)) - at)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, cut: float = CUT) -> Model:
    """A model from at most ``rows`` labelled texts outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", MOD, HELD, rows, SEED)
    share = labels.where((fold("doc_id", MOD) != HELD) & F.col("toxic").isNotNull()).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return train([t for _, t, _ in sample], [y for _, _, y in sample], min(0.9, max(0.01, share or 0.1)), cut)


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts have one window without content.

    Repeated rows and null ids are scored like any other; columns besides doc_id and text aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors()
        for b in batches:
            s = [model.score(t.as_py(), both) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold("doc_id", MOD) == HELD).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, columns as before."""
    both: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not both:
            both.extend(model.compressors())
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.filter(pa.array([model.score(t.as_py(), tuple(both)) < cut for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
