"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies, target / source size. Its whole part
is given outright. The fractional parts are rounded by the pivotal method (Deville & Tille 1998): two undecided
documents meet, one takes mass from the other until one of them is 0 or 1. Documents meet in order of size, so
the words taken stay close to the target and not only the number of documents. A source is dealt by hash into
chunks of bounded size; each chunk leaves at most one undecided document, and these residuals meet again, level by
level, in a reduction tree, until one per source is left.
"""

from __future__ import annotations

import math
import random
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, parts

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
CHUNK = 1024


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Words to take from each source: by weight, at most ``cap`` times its size, the excess reshared.

    Sources go by code point, null last. Resharing ends when no source is above its cap or none is left to take
    more. Sources without words get 0.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), list(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def pivot(probs: list[float], rng: random.Random, last: bool) -> list[float]:
    """The sequential pivotal method over ``probs`` in the given order; at most one entry stays fractional.

    With ``last`` that one is rounded too. Entries come out 0.0 or 1.0 otherwise.
    """
    out, held = list(probs), -1
    eps = 1e-9
    for j, p in enumerate(probs):
        if p <= eps or p >= 1 - eps:
            out[j] = float(round(p))
            continue
        if held < 0:
            held = j
            continue
        a, b = out[held], p
        total = a + b
        if total < 1 - eps:
            keep, drop = (held, j) if rng.random() * total < a else (j, held)
            out[drop], out[keep] = 0.0, total
            held = keep
        elif total <= 1 + eps:
            keep, drop = (held, j) if rng.random() * total < a else (j, held)
            out[keep], out[drop], held = 1.0, 0.0, -1
        else:
            keep, drop = (held, j) if rng.random() * (2 - total) < 1 - b else (j, held)
            out[keep], out[drop] = 1.0, total - 1
            held = drop
    if last and held >= 0:
        out[held] = 1.0 if rng.random() < out[held] else 0.0
    return out


def _level(seed: int, level: int, final: set):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        source, chunk = key
        rows = rows.sort_values(["size", "doc_id", "h"], kind="stable")
        source = None if source is None or source != source else source
        rng = random.Random(zlib.crc32(f"{seed}:{level}:{source!r}:{chunk}".encode()))
        p = pivot(rows["p"].tolist(), rng, source in final)
        return rows.assign(p=p)[["doc_id", "source", "size", "h", "p"]]

    return run


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 42, chunk: int = CHUNK
) -> DataFrame:
    """(doc_id, source, size, h, source_size, target, copies, taken) for every row of ``docs``.

    size: words of the text, 0 for null. h: a hash of the text, so that rows that share an id are dealt apart unless they
    are copies. copies: whole copies the mix takes, taken = copies * size. Reruns agree: draws depend on the
    seed, the source and the chunk alone, and rows that agree in id, source, size and text are interchangeable. An empty table gives an empty result. A null source is a source of its own, a null or repeated
    doc_id is an ordinary row. Only one row per source reaches the driver; sources must be few enough for that.
    """
    spark = docs.sparkSession
    sized = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("text").alias("h"),
        ),
        "mix-sizes",
    )
    found = {r["source"]: (r["w"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()}
    target = targets({s: w for s, (w, _) in found.items()}, weights, share, cap)
    rate = {s: target[s] / w if w else 0.0 for s, (w, _) in found.items()}
    whole = {s: math.floor(x + 1e-9) for s, x in rate.items()}
    chunks = {s: parts(n, chunk) for s, (_, n) in found.items()}
    plan = F.broadcast(  # a row for each source
        spark.createDataFrame(
            [(s, w, float(target[s]), whole[s], max(0.0, rate[s] - whole[s]), chunks[s]) for s, (w, _) in found.items()],
            "_s string, source_size long, target double, whole long, p double, n int",
        )
    )
    start = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "h", "p", F.pmod(F.xxhash64("doc_id", "size", "h"), F.col("n")).cast("int").alias("chunk")
    )
    schema = "doc_id long, source string, size long, h long, p double"
    level, done = 0, []
    while True:
        final = {s for s, n in chunks.items() if n == 1}
        out = cut(start.groupBy("source", "chunk").applyInPandas(_level(seed, level, final), schema), f"mix-{level}")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.where(~undecided))
        if len(final) == len(chunks):
            break
        level += 1
        chunks = {s: parts(n, chunk) for s, n in chunks.items()}
        n = F.broadcast(spark.createDataFrame(list(chunks.items()), "_s string, n int"))
        start = out.where(undecided).join(n, F.col("source").eqNullSafe(F.col("_s"))).select(
            "doc_id", "source", "size", "h", "p", F.pmod(F.xxhash64("doc_id", "size", "h", F.lit(level)), F.col("n")).cast("int").alias("chunk")
        )
    rounded = done[0]
    for x in done[1:]:
        rounded = rounded.unionByName(x)
    copies = (F.col("whole") + F.col("p0")).cast("long")
    return (
        rounded.withColumnRenamed("p", "p0")
        .join(plan, F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "source", "size", "h", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    )


def take(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; columns as before.

    Rows are matched by doc_id, source, size and a hash of the text. Rows that agree in these are copies: each takes the mean of
    their copies, and as many rows as remain, in hashed order, one more. A row's copies follow from its group's totals
    alone, but for that remainder, which is dealt in up to 4,096 parts.
    """
    mixed = mix(docs, **how).groupBy("doc_id", "source", "size", "h").agg(F.sum("copies").alias("_c"), F.count("*").alias("_n"))
    kept = docs.columns
    own = docs.select(
        F.struct(*[docs[c] for c in kept]).alias("_d"),
        F.col("doc_id").cast("long").alias("_i"),
        F.col("source").cast("string").alias("_s"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_w"),
        F.xxhash64("text").alias("_t"),
    )
    key = ["_i", "_s", "_w", "_t"]
    on = own["_i"].eqNullSafe(mixed["doc_id"]) & own["_s"].eqNullSafe(mixed["source"]) & (own["_w"] == mixed["size"]) & (own["_t"] == mixed["h"])
    both = own.join(mixed, on).select("_d", *key, "_c", "_n")
    once = both.where("_n = 1").select("_d", F.col("_c").alias("_k"))
    # Copies of one document: numbered within parts of their group, a part's first number from the sizes of the parts.
    many = both.where("_n > 1").withColumn("_p", F.pmod(F.xxhash64("_d"), F.lit(4096)))
    sizes = many.groupBy(*key, "_p").agg(F.count("*").alias("_m"))
    starts = sizes.select(*[F.col(c).alias(f"{c}2") for c in [*key, "_p"]], (F.sum("_m").over(Window.partitionBy(*key).orderBy("_p")) - F.col("_m")).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*key, "_p").orderBy(F.xxhash64("_d")))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in [*key, "_p"]])
    dealt = many.withColumn("_r", place).join(starts, same).select("_d", F.expr("_c div _n + if(_o + _r <= _c % _n, 1, 0)").alias("_k"))
    return once.unionByName(dealt).where("_k > 0").select(F.explode(F.expr("array_repeat(_d, cast(_k as int))")).alias("_d")).select(
        *[F.col("_d").getField(c).alias(c) for c in kept]
    )
