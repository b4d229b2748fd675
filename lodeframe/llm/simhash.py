"""SimHash near-dedup by an inverted index over the positional bytes of the fingerprint.

A fingerprint has 8 bytes. Two that differ in at most 4 bits differ in at most 4 bytes, so at least 4 positional bytes
are shared: the guaranteed minimum. The index posts each distinct fingerprint under triples of positional bytes.
The triples form a covering: any 4 positions contain one of them, so a pair that shares 4 bytes meets in
some posting, and 24 bits a key keep postings short. For each pair that meets, shared positional bytes are tallied,
pairs that reach the minimum stay, and the bits are compared. Nothing is lost and nothing is guessed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

SHINGLE, SEED, BITS = 4, 42, 4
LEAST_SHARED = 8 - BITS
POSTING = 256


def covering() -> list[tuple[int, int, int]]:
    """Triples of 8 positions so that any 4 positions contain one of them (Turan's construction on 3 groups)."""
    groups = [i % 3 for i in range(8)]
    out = []
    for t in combinations(range(8), 3):
        n = [sum(groups[i] == g for i in t) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            out.append(t)
    return out


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of one text; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    flat, starts = b" ".join(words), [0, *ends]
    k = min(size, len(words))
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(flat[starts[i] : starts[i + k] - 1], seed) for i in range(n)], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):  # bounded memory for very long texts
        total += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, h) for every row; fp is the fingerprint as a signed long, h a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), size, seed) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps, b.column(2)], ["doc_id", "fp", "h"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash("text")).mapInArrow(run, "doc_id long, fp long, h long")


def _star(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A star for each connected class of one posting's fingerprints, by tally, count filter and comparison."""
    raw = fps.view(np.uint64)
    tally = (fps.view(np.uint8).reshape(-1, 1, 8) == fps.view(np.uint8).reshape(1, -1, 8)).sum(axis=2)
    near = (tally >= 8 - bits) & (np.bitwise_count(raw[:, None] ^ raw[None, :]) <= bits)
    np.fill_diagonal(near, False)
    out, free = [], near.any(axis=1)
    for i in np.flatnonzero(free):
        if not free[i]:
            continue
        free[i] = False
        todo = [i]
        while todo:
            met = np.flatnonzero(near[todo].any(axis=0) & free)
            free[met] = False
            out += [(int(fps[i]), int(fps[j])) for j in met]
            todo = met.tolist()
    return out


def _runs(bits: int):
    """Links within runs of equal (key, i, j) of sorted batches; a run may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64) for _ in range(4)]
        found: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            ab = np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

        def links(cols: list[np.ndarray], ends: np.ndarray) -> None:
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                found.extend(_star(np.unique(cols[3][s:e]), bits))

        for b in batches:
            cols = [np.concatenate([k, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for k, c in zip(kept, b.columns, strict=True)]
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            links(cols, new)
            at = new[-1] if len(new) else 0
            kept = [c[at:] for c in cols]
            if len(found) > 50_000:
                yield flush()
        links(kept, np.array([len(kept[0])]))
        yield flush()

    return run


def link_edges(fps: DataFrame, bits: int = BITS, posting: int = POSTING) -> DataFrame:
    """(a, b) over distinct fingerprints ``fps`` (fp long): edges whose classes are those of all links.

    A posting of more than ``posting`` fingerprints is cut into chunks by hash, and every pair of its chunks is a
    group of its own, so no task gets an unbounded posting and no pair is lost. Each group returns stars,
    not all its pairs.
    """
    if bits > BITS:
        raise ValueError("the triples cover at most 4 differing bytes")
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = [
        (F.lit(k << 24) + F.shiftleft(byte[x], 16) + F.shiftleft(byte[y], 8) + byte[z]).cast("long")
        for k, (x, y, z) in enumerate(covering())
    ]
    posts = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = posts.groupBy("key").count().where(F.col("count") > posting).select(
        F.col("key").alias("hot"), F.ceil(F.col("count") / posting).cast("long").alias("n")
    )
    hot = cut(hot, "postings")
    cold = posts.join(hot, F.col("key") == F.col("hot"), "left_anti").select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "fp")
    chunk = F.pmod(F.xxhash64("fp"), F.col("n"))
    split = (
        posts.join(hot, F.col("key") == F.col("hot"))
        .select("key", "fp", chunk.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("o"))
        .select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    )
    dealt = cold.unionByName(split).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_runs(bits), "a long, b long")


def _rooted(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, h) of every row, and (fp, least, root): each distinct fingerprint's class, named by its root fingerprint."""
    own = cut(fingerprints(docs), "fingerprints")
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    roots = components(link_edges(distinct.select("fp"), bits))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return own, cut(rooted, "rooted")  # read twice; joins on a root then are stages of their own, which can be split


def classes(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable through fingerprints that differ in at most ``bits`` bits.
    Null and empty texts, and texts without words, have fingerprint 0 and link like any other. Null doc_ids are kept
    and never name a class unless it has no other id. Repeated rows stay. An empty table gives an empty result.
    Columns besides doc_id and text aren't read.
    """
    own, rooted = _rooted(docs, bits)
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    by_fp = rooted.join(named, "root").select(F.col("fp").alias("_fp"), "component_id")
    return own.join(by_fp, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each class: the one of the smallest doc_id, nulls last; all columns of ``docs`` stay.

    Of rows that repeat that doc_id in the class the first in order of text stays. Classes are those of fingerprints, so
    a class without ids keeps a row of its own, and texts of different classes that share an id both stay.
    """
    own, rooted = _rooted(docs, bits)
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("least")), "names")
    named = rooted.select(F.col("fp").alias("_fp"), F.col("root")).join(least, "root")
    of = own.join(named, F.col("fp") == F.col("_fp")).where(F.col("doc_id").eqNullSafe(F.col("least")))
    of = of.select("root", F.col("doc_id").alias("_keep"), F.col("h").alias("_h")).distinct()  # an id and a text have one class
    all_rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_d"))
    all_rows = all_rows.select("_d", F.col("_d.doc_id").cast("long").alias("_i"), _text_hash("_d.text"))
    kept = all_rows.join(of, F.col("_i").eqNullSafe(F.col("_keep")) & (F.col("h") == F.col("_h")))
    one = kept.groupBy("root").agg(F.min_by("_d", F.struct(F.coalesce(F.col("_d.text"), F.lit("")), F.xxhash64("_d"))).alias("_d"))
    return one.select(*[F.col("_d").getField(c).alias(c) for c in docs.columns])
