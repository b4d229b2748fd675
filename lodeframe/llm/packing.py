"""Packing documents into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows from their start; only the rest is packed. Pieces are
dealt by hash into groups of bounded size. In a group, pieces go in decreasing length into the open window with the
least remaining capacity that still holds them. A segment tree indexed by remaining capacity finds that window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts
from .tokens import encoder, forget

WINDOW, END, GROUP = 1024, 0, 4096

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, keep: bool = True) -> DataFrame:
    """The pieces of every row of ``docs``: full windows from the start and a rest, with a crc32 of their ids; ids is that of the document's.

    Unless ``keep``, a worker drops its encoder at the end of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        try:
            for b in batches:
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for at in range(0, b.num_rows, 256):  # few texts at a time as Python strings
                    texts = [t or "" for t in b.column(1)[at : at + 256].to_pylist()]
                    for doc, ids in zip(b.column(0)[at : at + 256].to_pylist(), enc.encode(texts), strict=True):
                        raw, n = np.append(ids, np.uint32(end)).astype("<u4").tobytes(), len(ids) + 1
                        whole = zlib.crc32(raw)
                        for s in range(0, n, window):
                            e = min(n, s + window)
                            for c, v in zip(out, (doc, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), n, whole), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        finally:
            del enc
            if not keep:
                forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE + ", ids long")


class Capacities:
    """Open windows by remaining capacity: counts at the leaves of a segment tree, sums above."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``need``, and that capacity."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up until a tree to the right holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        c = i - self.size
        self._add(c, -1)
        return self.open[c].pop(), c

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += by
            i >>= 1


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """The window and the offset of each piece; ``lengths`` in the order in which pieces are placed."""
    free, which, offset, n = Capacities(window), [], [], 0
    for x in lengths:
        if (found := free.take(x)) is None:
            found, n = (n, window), n + 1
        w, c = found
        which.append(w)
        offset.append(window - c)
        if c > x:
            free.put(c - x, w)
    return which, offset


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, group: int = GROUP, keep: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of every row.

    A null text is empty and has one piece, its end id. Repeated rows and null ids are packed like any other row.
    An empty table gives an empty result. sequence_id is group * 2^32 + number in the group; ties in length go by
    doc_id and start, so reruns agree. ``keep`` is that of ``pieces``.
    """
    n = parts(docs.count(), group)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        which, offset = best_fit(rows["length"].tolist(), window)
        return rows.assign(sequence_id=rows["_g"] * 2**32 + np.array(which, dtype=np.int64), offset=np.array(offset, dtype=np.int64)).drop(columns="_g")

    dealt = pieces(docs, tokenizer, window, end, keep).withColumn("_g", F.pmod(F.xxhash64("doc_id", "doc_tokens", "ids", "start"), F.lit(n)).cast("long")).drop("ids")
    return dealt.groupBy("_g").applyInPandas(run, PIECE + ", sequence_id long, offset long")
