"""Outlier detectors over a feature vector (key, x array<double>); each gives (key, score), higher is odder."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import distance, total
from ..functions.hashing import draw
from .kernels import nearest
from .ranks import quantile_row


def standardise(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, x): missing cells at the exact median, then population z-scores; a constant column is all 0."""
    med = quantile_row(df, {f"_m{i}": c for i, c in enumerate(columns)}, [0.5]).first()  # one row, read once: plans stay small
    filled = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(med[f"_m{i}"][0])).alias(f"_f{i}") for i, c in enumerate(columns)])
    n = range(len(columns))
    stats = filled.agg(*[F.avg(f"_f{i}").alias(f"_a{i}") for i in n], *[F.stddev_pop(f"_f{i}").alias(f"_s{i}") for i in n])
    z = [F.when(F.col(f"_s{i}") > 0, (F.col(f"_f{i}") - F.col(f"_a{i}")) / F.col(f"_s{i}")).otherwise(F.lit(0.0)) for i in n]
    return filled.crossJoin(F.broadcast(stats)).select(key, F.array(*z).alias("x"))


def squared_distance(v: DataFrame, key: str) -> DataFrame:
    """The squared distance to the mean, which is 0."""
    return v.select(key, total(F.transform("x", lambda a: a * a)).alias("score"))


def histogram_score(v: DataFrame, key: str, bins: int = 10) -> DataFrame:
    """Sum over columns of -ln of the bin's relative height (Goldstein & Dengel 2012)."""
    cells = v.select(key, F.posexplode("x").alias("c", "a"))
    ends = cells.groupBy("c").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))  # a row for each column
    index = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("a") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int"))).otherwise(0)
    placed = cells.join(F.broadcast(ends), "c").select(key, "c", index.alias("b"))
    n = placed.groupBy("c", "b").agg(F.count("*").alias("n"))
    height = n.select("c", "b", (F.col("n") / F.max("n").over(Window.partitionBy("c"))).alias("h"))
    return placed.join(F.broadcast(height), ["c", "b"]).groupBy(key).agg(F.sum(-F.log("h")).alias("score"))


def knn_distance(neighbours: DataFrame, key: str, k: int) -> DataFrame:
    """The distance to the k-th neighbour."""
    return neighbours.where(F.col("rank") == k).select(key, F.col("d").alias("score"))


def local_outlier_factor(neighbours: DataFrame, key: str, k: int) -> DataFrame:
    """Breunig et al. (2000), over the table of k nearest neighbours."""
    kd = neighbours.where(F.col("rank") == k).select(F.col(key).alias("_k"), F.col("d").alias("kd"))
    reach = neighbours.join(kd, F.col("neighbour") == F.col("_k")).select(key, "neighbour", F.greatest("d", "kd").alias("r"))
    lrd = reach.groupBy(key).agg((1 / F.greatest(F.avg("r"), F.lit(1e-10))).alias("lrd"))
    other = lrd.select(F.col(key).alias("_k"), F.col("lrd").alias("o"))
    return neighbours.join(other, F.col("neighbour") == F.col("_k")).groupBy(key).agg(F.avg("o").alias("m")).join(lrd, key).select(key, (F.col("m") / F.col("lrd")).alias("score"))


def angle_variance(v: DataFrame, neighbours: DataFrame, key: str) -> DataFrame:
    """Minus the variance of distance-weighted angles over pairs of neighbours (Kriegel et al. 2008)."""
    own = v.select(F.col(key).alias("_q"), F.col("x").alias("qx"))
    other = v.select(F.col(key).alias("_p"), F.col("x").alias("px"))
    d = neighbours.join(own, F.col(key) == F.col("_q")).join(other, F.col("neighbour") == F.col("_p")).select(
        key, "rank", F.zip_with("px", "qx", lambda a, b: a - b).alias("u")
    )
    a, b = d.alias("a"), d.alias("b")
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    w = dot("a.u", "a.u") * dot("b.u", "b.u")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.rank") < F.col("b.rank")))
    return pairs.select(F.col(f"a.{key}").alias(key), F.when(w > 0, dot("a.u", "b.u") / w).alias("g")).groupBy(key).agg((-F.coalesce(F.var_pop("g"), F.lit(0.0))).alias("score"))


def projections(n: int, dims: int, seed: int = 42) -> list[list[float]]:
    """Sparse directions with about sqrt(dims) entries of +1 or -1, drawn by md5."""
    import hashlib

    keep = max(1, round(math.sqrt(dims)))
    out = []
    for p in range(n):
        order = sorted(range(dims), key=lambda j: hashlib.md5(f"{seed}:axis:{p}:{j}".encode()).hexdigest())[:keep]
        out.append([(1.0 if int(hashlib.md5(f"{seed}:sign:{p}:{j}".encode()).hexdigest()[0], 16) < 8 else -1.0) if j in order else 0.0 for j in range(dims)])
    return out


def loda(v: DataFrame, key: str, directions: list[list[float]], bins: int = 10) -> DataFrame:
    """The mean of -ln of histogram density over sparse projections (Pevny 2016)."""
    p = F.array(*[F.array(*[F.lit(x) for x in d]) for d in directions])
    cells = v.select(key, F.posexplode(F.transform(p, lambda d: total(F.zip_with(d, "x", lambda a, b: a * b)))).alias("c", "a")).withColumn("a", F.round("a", 9))
    ends = cells.groupBy("c").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    index = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("a") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int"))).otherwise(0)
    placed = cells.join(F.broadcast(ends), "c").select(key, "c", index.alias("b"))
    n = placed.groupBy("c", "b").agg(F.count("*").alias("n"))
    density = n.select("c", "b", (F.col("n") / F.sum("n").over(Window.partitionBy("c"))).alias("h"))
    return placed.join(F.broadcast(density), ["c", "b"]).groupBy(key).agg(F.avg(-F.log("h")).alias("score"))


def covariance(v: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population covariance) in one aggregation; dims squared numbers reach the driver."""
    cols = [F.avg(F.col("x")[i]) for i in range(dims)] + [F.covar_pop(F.col("x")[i], F.col("x")[j]) for i in range(dims) for j in range(i + 1)]
    row = v.agg(*cols).first()
    cov = np.zeros((dims, dims))
    cov[np.tril_indices(dims)] = row[dims:]
    return np.array(row[:dims]), cov + np.tril(cov, -1).T


def _project(v: DataFrame, key: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    m = [float(a) for a in mean]
    p = [sum(((F.col("x")[i] - m[i]) * float(axes[i, k]) for i in range(len(m))), F.lit(0.0)) for k in range(axes.shape[1])]
    return v.select(key, F.array(*p).alias("x"))


def pca(v: DataFrame, key: str, dims: int, k: int) -> DataFrame:
    """(key, x): centred data on the k axes of greatest variance; signs make each axis's largest entry positive."""
    mean, cov = covariance(v, dims)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    return _project(v, key, mean, axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)]))


def mahalanobis(v: DataFrame, key: str, dims: int, share: float = 0.95) -> DataFrame:
    """The squared distance in the axes that hold ``share`` of the variance, with 1e-6 on the diagonal."""
    mean, cov = covariance(v, dims)
    val, axes = np.linalg.eigh(cov)
    val, axes = val[::-1], axes[:, ::-1]
    k = int(np.searchsorted(np.cumsum(val) / max(val.sum(), 1e-300), share - 1e-12) + 1)
    scaled = axes[:, :k] / np.sqrt(val[:k] + 1e-6)
    return squared_distance(_project(v, key, mean, scaled), key)


def depth(v: DataFrame, key: str, dims: int) -> DataFrame:
    """The distance from the coordinate-wise median in the plane of the first two axes."""
    p = pca(v, key, dims, 2)
    m = quantile_row(p, {"a": F.col("x")[0], "b": F.col("x")[1]}, [0.5]).first()
    return p.select(key, distance(F.col("x"), F.array(*[F.lit(m[c][0]) for c in "ab"])).alias("score"))


def cblof(v: DataFrame, key: str, k: int = 8, share: float = 0.9, ratio: float = 5.0, seed: int = 42) -> DataFrame:
    """The distance to the nearest large cluster's centre (He et al. 2003); clusters by MLlib k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vec = v.select(key, "x", array_to_vector("x").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=10).fit(vec)
    sizes = {r["prediction"]: r["count"] for r in model.transform(vec).groupBy("prediction").count().collect()}
    order = sorted(sizes, key=lambda c: (-sizes[c], c))
    n, run, large = sum(sizes.values()), 0, []
    for i, c in enumerate(order):
        large.append(c)
        run += sizes[c]
        if run >= share * n or (i + 1 < len(order) and sizes[c] >= ratio * sizes[order[i + 1]]):
            break
    centres = [[float(x) for x in model.clusterCenters()[c]] for c in large]
    return v.select(key, F.array_min(F.array(*[distance(F.col("x"), F.array(*[F.lit(x) for x in c])) for c in centres])).alias("score"))


def isolation_forest(v: DataFrame, key: str, trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """2^(-mean path / c(sample)) over random trees (Liu et al. 2008), each grown from ``sample`` hashed rows."""
    rows = v.orderBy(draw(seed, key), key).limit(sample * trees).select("x").collect()  # bounded by sample * trees
    data = np.array([r[0] for r in rows], float)
    rng = np.random.default_rng(seed)

    def c(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(m: np.ndarray, deep: int):
        if deep <= 0 or len(m) < 2:
            return len(m)
        j = int(rng.integers(m.shape[1]))
        lo, hi = m[:, j].min(), m[:, j].max()
        if lo == hi:
            return len(m)
        t = float(rng.uniform(lo, hi))
        return (j, t, grow(m[m[:, j] < t], deep - 1), grow(m[m[:, j] >= t], deep - 1))

    n = min(sample, len(data))
    forest = [grow(data[rng.choice(len(data), n, replace=False)], math.ceil(math.log2(max(2, n)))) for _ in range(trees)] if len(data) else []
    shared = v.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.empty((0, 1))
        total = np.zeros(len(m))
        for tree in shared.value:
            todo = [(tree, np.arange(len(m)), 0)]
            while todo:
                node, at, deep = todo.pop()
                if isinstance(node, int):
                    total[at] += deep + c(node)
                elif len(at):
                    left = m[at, node[0]] < node[1]
                    todo += [(node[2], at[left], deep + 1), (node[3], at[~left], deep + 1)]
        return pd.Series(2 ** (-total / max(1, len(shared.value)) / max(c(n), 1e-9)))

    return v.select(key, score("x").alias("score"))


def gather(scores: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, method, score)."""
    out = None
    for name, df in scores.items():
        one = df.select(key, F.lit(name).alias("method"), "score")
        out = one if out is None else out.unionByName(one)
    return out


def flags(scores: DataFrame, percent: float = 99.0) -> DataFrame:
    """Adds flag: the score is strictly above the method's own percentile."""
    cuts = quantile_row(scores, {"_c": "score"}, [percent / 100], "method").collect()  # a row for each method
    cut = F.coalesce(*[F.when(F.col("method") == r["method"], F.lit(r["_c"][0])) for r in cuts], F.lit(None).cast("double"))
    return scores.withColumn("flag", (F.col("score") > cut).cast("int"))


def vote(flagged: DataFrame, key: str, least: int) -> DataFrame:
    """(key, votes, is_outlier)."""
    return flagged.groupBy(key).agg(F.sum("flag").alias("votes")).withColumn("is_outlier", (F.col("votes") >= least).cast("int"))


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("method").agg(F.sum("flag").alias("n"))


def flag_correlation(flagged: DataFrame, key: str, methods: list[str]) -> DataFrame:
    """(a, b, r): Pearson of 0/1 flags."""
    from .stats import pearson

    return pearson(flagged.groupBy(key).pivot("method", methods).agg(F.max("flag")), methods)


def neighbours(v: DataFrame, key: str, k: int) -> DataFrame:
    return nearest(v, v, key, "x", k)
