"""Near-duplicate vectors by collision counting over one-dimensional projections.

Unit vectors are rotated onto an orthonormal basis whose first axes spread the data most. Two vectors whose cosine
reaches the threshold are at most ``radius`` apart, and the squared differences of all projections add up to the
squared distance, so at most floor(radius^2 / half^2) projections can differ by more than ``half``. In each
projection, sorted, a window of that half width around the query gives its collisions; a pair with fewer
collisions than the guaranteed number can't be a link. This calibrates the count to a recall of one: no
link is lost. Pairs that pass are verified by their cosine in double precision.

Vectors of a label are dealt into tiles by cuts along the leading axes; tiles farther apart than the radius never
meet. A tile that is too full is split by hash, so no task gets an unbounded one. Of two tiles that meet, one is sent to
the other. Equal vectors are one point. Tasks return the number of links of each point and a star for each linked class, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

COSINE, HALF, TILE, AXES, SAMPLE, VISITORS = 0.93, 0.1, 1024, 8, 20000, 16


def _points(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the vectors that can link."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))  # -0.0 is 0.0
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
        .where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & good)
        .select("vec_id", "label", plain.alias("embedding"))
    )


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows over their length, scaled first so that no square overflows."""
    m = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def basis(gram: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the axes of greatest spread first."""
    return np.linalg.eigh(gram)[1][:, ::-1]


def guaranteed(dims: int, cosine: float = COSINE, half: float = HALF) -> tuple[float, int]:
    """(radius, collisions that a pair at the threshold can't miss)."""
    squared = 2 - 2 * cosine + 1e-9
    return math.sqrt(squared), max(0, dims - math.floor(squared / (half * half)))


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """For each row of ``a``, in how many columns each row of ``b`` lies in the window around it."""
    tally = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        line = b[order, k]
        low, high = np.searchsorted(line, a[:, k] - half, "left"), np.searchsorted(line, a[:, k] + half, "right")
        if (high - low).sum() * 4 < len(a) * len(b):
            rows = np.repeat(np.arange(len(a)), high - low)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            tally[rows, order[at]] += 1  # a row meets a column's entry once
        else:  # wide windows: the same, read off ranks
            rank = np.empty(len(b), np.int64)
            rank[order] = np.arange(len(b))
            tally += (rank[None, :] >= low[:, None]) & (rank[None, :] < high[:, None])
    return tally


def links(a: np.ndarray, b: np.ndarray, turn: np.ndarray, cosine: float = COSINE, half: float = HALF) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` whose cosine reaches the threshold; counted first, then verified."""
    ua, ub = unit(a), unit(b)
    _, least = guaranteed(a.shape[1], cosine, half)
    i, j = np.nonzero(collisions(ua @ turn, ub @ turn, half) >= least)
    good = np.zeros(len(i), bool)
    for at in range(0, len(i), 65536):
        s = slice(at, at + 65536)
        x, y = a[i[s]], b[j[s]]
        top = np.abs(x).max(axis=1) * np.abs(y).max(axis=1)
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        good[s] = ((x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= cosine) & (top > 0)
    return i[good], j[good]


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for d, m in _matrices(b.column(0)):
            u = unit(m)
            total[d] = total.get(d, 0) + u.T @ u
    for d, g in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([g.ravel().tolist()], pa.list_(pa.float64()))], ["dims", "gram"])


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), np.stack([flat[ends[i] - d : ends[i]] for i in at])


def _cuts(points: list[np.ndarray], least: int, axes: int, depth: int = 0) -> tuple | None:
    """A tree of median cuts over sampled coordinates: (axis, value, left, right); None for a leaf."""
    m = np.array(points)
    if len(m) < 2 * least or depth >= 16:
        return None
    axis = int(np.argmax(m[:, :axes].max(axis=0) - m[:, :axes].min(axis=0)))
    value = float(np.median(m[:, axis]))
    left = m[:, axis] <= value
    if left.all() or not left.any():
        return None
    return axis, value, _cuts(m[left], least, axes, depth + 1), _cuts(m[~left], least, axes, depth + 1)


def _leaf(tree: tuple | None, x: np.ndarray) -> int:
    at = 1
    while tree is not None:
        right = x[tree[0]] > tree[1]
        at, tree = 2 * at + right, tree[3 if right else 2]
    return at


def classes(vectors: DataFrame, cosine: float = COSINE, half: float = HALF, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors link only under one label. Null vectors and labels, zero vectors and vectors with a null or non-finite
    component have no links and are classes of their own, as are vectors of other lengths than each other's; a null
    vec_id links with nothing. An empty table gives an empty result. Other columns aren't read.
    """
    spark = vectors.sparkSession
    valid = cut(_points(vectors).withColumn("h", F.xxhash64("label", "embedding")), "vectors")
    # Equal vectors are found among those whose hash repeats; whole vectors of the others aren't shuffled for it.
    again = cut(valid.groupBy("h").count().where("count > 1").select(F.col("h").alias("_h")), "repeats")
    twice = valid.join(again, F.col("h") == F.col("_h"), "left_semi")
    equal = cut(twice.groupBy("label", "embedding").agg(F.min("vec_id").alias("point"), F.count("*").alias("copies")), "equal")
    alone = valid.join(again, F.col("h") == F.col("_h"), "left_anti")
    points = cut(
        alone.select("label", "embedding", F.col("vec_id").alias("point"), F.lit(1).cast("long").alias("copies"))
        .unionByName(equal.select("label", "embedding", "point", "copies")).withColumn("dims", F.size("embedding")), "points",
    )
    same = equal.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), "point")
    members = alone.select("vec_id", F.col("vec_id").alias("point")).unionByName(
        twice.join(same, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e"))).select("vec_id", "point")
    )
    turns = {r["dims"]: basis(np.array(r["gram"]).reshape(r["dims"], -1)) for r in _sum_gram(points).collect()}  # a row for each length
    n = points.count()
    sample = points.select("label", "dims", "embedding").orderBy(F.xxhash64("point")).limit(SAMPLE).collect() if n else []
    held: dict = {}
    for r in sample:
        held.setdefault((r["label"], r["dims"]), []).append((unit(np.array([r["embedding"]])) @ turns[r["dims"]])[0])
    each = max(1, round(tile * len(sample) / max(1, n)))
    trees = {k: _cuts(v, each, min(AXES, k[1])) for k, v in held.items()}
    shared = spark.sparkContext.broadcast((turns, trees))
    axes = AXES

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, trees = shared.value
        for b in batches:
            leaf, coords = [], []
            for label, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                c = (unit(np.array([x])) @ turns[len(x)])[0]
                leaf.append(_leaf(trees.get((label, len(x))), c))
                coords.append([*c[:axes].tolist(), *[0.0] * (axes - len(c[:axes]))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64()), pa.array(coords, pa.list_(pa.float64()))], [*b.schema.names, "leaf", "coords"])

    placed = cut(
        points.select("point", "label", "embedding", "copies", "dims").mapInArrow(
            place, "point long, label long, embedding array<double>, copies long, dims int, leaf long, coords array<double>"
        ), "placed",
    )
    full = placed.groupBy("label", "dims", "leaf").count().select(
        F.col("label").alias("_l"), F.col("dims").alias("_d"), F.col("leaf").alias("_f"), F.ceil(F.col("count") / tile).cast("long").alias("n")
    )
    dealt = cut(
        placed.join(full, (F.col("label") == F.col("_l")) & (F.col("dims") == F.col("_d")) & (F.col("leaf") == F.col("_f")))
        .withColumn("tile", F.xxhash64("label", "dims", "leaf", F.pmod(F.xxhash64("point"), "n")))
        .select("point", "label", "embedding", "copies", "dims", "coords", "tile"), "dealt",
    )
    ends = [f(F.col("coords")[k]).alias(f"{name}{k}") for k in range(axes) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = dealt.groupBy("label", "dims", "tile").agg(*ends)
    a, b = boxes.alias("a"), boxes.alias("b")
    gap = sum(
        (F.pow(F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")), 2) for k in range(axes)), F.lit(0.0)
    )
    near = (F.col("a.label") == F.col("b.label")) & (F.col("a.dims") == F.col("b.dims")) & (F.col("a.tile") <= F.col("b.tile"))
    meets = cut(a.join(b, near & (gap <= 2 - 2 * cosine + 1e-9)).select(F.col("a.tile").alias("s"), F.col("b.tile").alias("t")), "meets")

    def bundle(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["embedding"].to_numpy()).astype("<f8")
        half = x.astype("<f4")  # half the bytes, where no value loses any
        return pd.DataFrame([{
            "tile": rows["tile"].iloc[0], "dims": rows["dims"].iloc[0], "ids": rows["point"].to_numpy(np.int64).tobytes(),
            "copies": rows["copies"].to_numpy(np.int64).tobytes(), "data": (half if np.array_equal(half.astype("<f8"), x) else x).tobytes(),
        }])

    tiles = cut(dealt.select("tile", "dims", "point", "copies", "embedding").groupBy("tile").applyInPandas(bundle, "tile long, dims int, ids binary, copies binary, data binary"), "tiles")

    def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, copies = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64)
        kind = "<f4" if len(row["data"]) == 4 * len(ids) * row["dims"] else "<f8"
        return ids, copies, np.frombuffer(row["data"], kind).astype("<f8").reshape(-1, row["dims"])

    def compare(host: pa.Table, visitors: pa.Table) -> pa.Table:
        """Links between one tile and those that meet it here: each comes once, to be compared with the host."""
        turns, _ = shared.value
        out: list[list[np.ndarray]] = [[], [], []]
        plain = lambda t, mark: t.rename_columns([c.removeprefix(mark) for c in t.column_names])
        for h in plain(host, "h_").to_pylist():
            ids_a, n_a, x = opened(h)
            for v in (row for b in plain(visitors, "g_").to_batches(max_chunksize=1) for row in b.to_pylist()):
                same, (ids_b, n_b, y) = v["tile"] == h["tile"], opened(v)
                i, j = links(x, y, turns[h["dims"]], cosine, half)
                if same:
                    i, j = i[i < j], j[i < j]
                deg_a, deg_b = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                np.add.at(deg_a, i, n_b[j])
                np.add.at(deg_b, j, n_a[i])
                root = _classes(i, j if same else j + len(x), len(x) + (0 if same else len(y)))
                ids = ids_a if same else np.concatenate([ids_a, ids_b])
                deg = deg_a + deg_b if same else np.concatenate([deg_a, deg_b])
                hit = np.flatnonzero(deg)
                for c, found in zip(out, (ids[hit], ids[root[hit]], deg[hit]), strict=True):
                    c.append(found)
        return pa.table([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out], names=["a", "b", "n"])

    # A tile that meets many is host to VISITORS of them at a time, so no group is unbounded.
    often = meets.groupBy("s").count().select(F.col("s").alias("_s"), F.ceil(F.col("count") / VISITORS).cast("long").alias("_n"))
    seats = cut(meets.join(often, F.col("s") == F.col("_s")).select("s", "t", F.pmod(F.xxhash64("t"), "_n").alias("seat")), "seats")
    names = tiles.columns
    hosts = seats.select("s", "seat").distinct().join(tiles, F.col("s") == F.col("tile")).select(F.col("s").alias("hs"), F.col("seat").alias("hseat"), *[F.col(c).alias(f"h_{c}") for c in names])
    guests = seats.join(tiles, F.col("t") == F.col("tile")).select(F.col("s").alias("gs"), F.col("seat").alias("gseat"), *[F.col(c).alias(f"g_{c}") for c in names])
    met = cut(hosts.groupBy("hs", "hseat").cogroup(guests.groupBy("gs", "gseat")).applyInArrow(compare, "a long, b long, n long"), "links")
    degree = met.groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(met.select("a", "b"))
    named = (
        points.select(F.col("point").alias("_p"), "copies")
        .join(degree, F.col("_p") == F.col("a"), "left").join(roots, F.col("_p") == F.col("node"), "left")
        .select("_p", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "_p").alias("component_id"))
    )
    linked = members.join(cut(named, "named"), F.col("point") == F.col("_p")).select("vec_id", "n_links", "component_id")
    bad = _rest(vectors)
    return linked.unionByName(bad).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _rest(vectors: DataFrame) -> DataFrame:
    """The rows that can't link, each a class of its own."""
    ok = (
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    )
    alone = vectors.where(~F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"))
    return alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))


def _sum_gram(points: DataFrame) -> DataFrame:
    """The Gram matrix of unit vectors for each length, summed entry by entry."""
    each = points.select("embedding").mapInArrow(_gram, "dims int, gram array<double>").select("dims", F.posexplode("gram").alias("k", "x"))
    summed = each.groupBy("dims", "k").agg(F.sum("x").alias("x"))
    return summed.groupBy("dims").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("gram"))


def _classes(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index linked with each of ``n`` points, by hooking and halving over all links at once."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
