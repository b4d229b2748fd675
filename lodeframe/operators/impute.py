"""Filling missing cells, and scoring how well a filler restores hidden ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantile_row, running, with_rank
from .stats import correlation


def fill(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """Missing cells at the column's exact median, or mean."""
    return apply_fill(df, fit_fill(df, columns, how), columns)


def fit_fill(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """One row of what ``apply_fill`` puts into gaps: fitted on a training table, it fills any other."""
    if how == "median":
        q = quantile_row(df, {f"_v{i}": c for i, c in enumerate(columns)}, [0.5])
        return q.select(*[F.col(f"_v{i}")[0].alias(f"_v{i}") for i in range(len(columns))])
    return df.agg(*[F.avg(c).alias(f"_v{i}") for i, c in enumerate(columns)])


def apply_fill(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with its gaps filled by the row that ``fit_fill`` gave, which is read once."""
    row = stats.first()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(row[f"_v{i}"]).cast("double")) for i, c in enumerate(columns)}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns])


def _nearest_donors(z: np.ndarray, y: np.ndarray, p: np.ndarray, j: int, axis: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ask, row, d, reach): for each row of ``z`` the k nearest rows of ``y`` that have column j, in order of d and p; and how far along
    ``axis`` anything as near can lie, infinite where fewer than k were found.

    A squared distance is at least that along ``axis`` times all columns / those of the ask. Each ask meets the rows next to it
    along the axis, more of them until none outside can be as near; asks or rows without the axis meet everything.
    """
    width = z.shape[1]
    have = np.flatnonzero(~np.isnan(y[:, j]))
    have = have[np.argsort(y[have, axis], kind="stable")]
    n, place, spot, centre = len(have), y[have, axis], z[:, axis], np.zeros(len(z), int)
    most, reach = np.full(len(z), np.inf), np.full(len(z), np.inf)
    near = np.full(len(z), min(n, 64))
    if not n:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), reach
    whole = np.isnan(spot) | bool(np.isnan(place).any())
    near[whole] = n
    centre[~whole] = np.searchsorted(place, spot[~whole])
    held = [c for c in range(width) if not np.isnan(z[:, c]).all()]
    own = (~np.isnan(z)).sum(axis=1)
    data = {c: np.ascontiguousarray(y[have, c]) for c in held}
    full = {c for c in held if not np.isnan(data[c]).any() and not np.isnan(z[:, c]).any()}
    todo, out = np.argsort(spot, kind="stable"), []
    while len(todo):
        todo = todo[np.argsort(near[todo], kind="stable")]
        later, at = [], 0
        while at < len(todo):
            size = int(near[todo[min(len(todo) - 1, at + max(1, 32768 // int(near[todo[at]])) - 1)]])
            ask = todo[at : at + max(1, 32768 // size)]
            at += len(ask)
            lo = np.clip(centre[ask] - size // 2, 0, n - size)
            to = lo[:, None] + np.arange(size)
            d, shared = np.zeros(to.shape), np.zeros(to.shape)
            for c in held:
                gap = z[ask, c][:, None] - data[c][to]
                gap *= gap
                if c not in full:
                    both = ~np.isnan(gap)
                    shared += both
                    gap[~both] = 0.0
                d += gap
            shared += len(full)
            d = np.where(shared > 0, d * width / np.maximum(shared, 1), np.inf)
            most[ask] = np.partition(d, k - 1, axis=1)[:, k - 1] if size >= k else np.inf
            reach[ask] = far = np.sqrt(most[ask] * own[ask] / width) * (1 + 1e-9) + 4 * np.spacing(np.abs(spot[ask]))
            with np.errstate(invalid="ignore"):
                left, right = np.searchsorted(place, spot[ask] - far), np.searchsorted(place, spot[ask] + far, "right")
            done = (size == n) | ((left >= lo) & (right <= lo + size))
            again = ask[~done]
            half = np.maximum(centre[again] - left[~done], right[~done] - centre[again])
            near[again] = np.minimum(n, np.clip(2 * half + 2, size + 1, 4 * size))
            later.append(again)
            r, c = np.nonzero((d <= most[ask][:, None]) & np.isfinite(d) & done[:, None])
            out.append((ask[r], have[to[r, c]], d[r, c]))
        todo = np.concatenate(later)
    r, c, d = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((p[c], d, r))
    r, c, d = r[order], c[order], d[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first], d[first], np.where(np.isnan(reach), np.inf, reach)


def _rows(t: pa.Table, key: str, values: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and their rows of values as a matrix with nan in gaps."""
    p, x = t[key].to_numpy(), t[values].combine_chunks()
    return p, x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(p), -1)


def knn_fill(df: DataFrame, key: str, columns: list[str], k: int = 5, block: int = 16384) -> DataFrame:
    """Missing cells at the mean of the k nearest rows of the whole table that have the column.

    The squared distance over columns both rows have is scaled by all columns / shared columns. ``key`` is a unique
    number; ties go by it. A cell without such rows takes the column's mean. Rows are cut into ranges of the column with the
    largest spread and of like size, a range of many equal values into parts; rows without that column are parts that all cells meet. A cell
    meets its own part first, and is filled there if nothing outside can be as near; the others meet all ranges that their k-th distance reaches.
    """
    df = df.persist()  # read for the spread, the ranges and their sizes, by the search and for the result
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(F.col(key).cast("long").alias("p"), x.alias("x"))
    about = df.agg(F.count("*").alias("n"), *[F.coalesce(F.var_pop(c) * F.count(c) / F.count("*"), F.lit(0.0)).alias(f"_s{i}") for i, c in enumerate(columns)]).first()
    axis = int(np.argmax(np.nan_to_num(np.array(about[1:], float), nan=0.0)))
    place, n = F.col("x")[axis], max(1, -(-about["n"] // block))
    cuts = sorted(set(df.approxQuantile(columns[axis], [i / n for i in range(1, n)], 1 / (8 * n)))) if n > 1 else []
    edges = np.array(cuts, float)

    @F.pandas_udf("int")
    def range_of(v: pd.Series) -> pd.Series:
        """How many of the edges are below; -1 without a value."""
        return pd.Series(np.where(v.isna(), -1, np.searchsorted(edges, v.to_numpy(float))).astype("int32"))

    ranged = rows.withColumn("_r", range_of(place))
    counts = {r["_r"]: r["count"] for r in ranged.groupBy("_r").count().collect()}  # a row for each range
    parts = {r: -(-c // (2 * block)) for r, c in counts.items()}
    split = [r for r in parts if parts[r] > 1]
    pieces = F.coalesce(F.create_map(*[F.lit(v) for r in split for v in (r, parts[r])])[F.col("_r")], F.lit(1)) if split else F.lit(1)
    base = ranged.withColumn("_g", F.pmod(F.xxhash64("p"), pieces.cast("long")).cast("int"))
    one = -1 not in counts  # only then can a cell be done with in its own range

    def inside(part: tuple, t: pa.Table) -> pa.Table:
        """The cells of a part: (q, j, v) of those that are filled; the others with their row z and the ranges t that they reach."""
        p, y = _rows(t, "p", "x")
        o, out = part[0].as_py(), []
        for j in range(len(columns)):
            mine = np.flatnonzero(gaps(t, j))
            if not len(mine):
                continue
            r, c, _, reach = _nearest_donors(y[mine], y, p, j, axis, k)
            spot = y[mine, axis]
            low, high = np.searchsorted(edges, spot - reach), np.searchsorted(edges, spot + reach)
            done = np.isfinite(reach) & (low == o) & (high == o) if one and parts[o] == 1 else np.zeros(len(mine), bool)
            total = np.bincount(r, y[c, j], len(mine))
            met = [None if f or o < 0 or not np.isfinite(d) else [a, b] for f, d, a, b in zip(done, reach, low.tolist(), high.tolist(), strict=True)]
            z = [None if f else y[i].tolist() for f, i in zip(done, mine, strict=True)]
            cells = pa.table({"q": pa.array(p[mine]), "j": pa.array(np.full(len(mine), j, np.int32)), "v": pa.array(total / k, mask=~done)})
            out.append(cells.append_column("z", pa.array(z, pa.list_(pa.float64()))).append_column("t", pa.array(met, pa.list_(pa.int32()))))
        return pa.concat_tables(out) if out else pa.table({"q": pa.array([], pa.int64()), "j": pa.array([], pa.int32()), "v": pa.array([], pa.float64()), "z": pa.array([], pa.list_(pa.float64())), "t": pa.array([], pa.list_(pa.int32()))})

    def gaps(t: pa.Table, j: int) -> np.ndarray:
        return pc.is_null(pc.list_element(t["x"].combine_chunks(), j)).to_numpy(zero_copy_only=False)

    def outside(asks: pa.Table, t: pa.Table) -> pa.Table:
        """(q, j, p, d, v): for each asked cell (q, z, j) the k nearest of a part."""
        out = []
        if len(asks) and len(t):
            (q, z), (p, y), js = _rows(asks, "q", "z"), _rows(t, "p", "x"), asks["j"].to_numpy()
            for j in np.unique(js).tolist():
                mine = np.flatnonzero(js == j)
                r, c, d, _ = _nearest_donors(z[mine], y, p, j, axis, k)
                out.append((q[mine[r]], np.full(len(r), j, np.int32), p[c], d, y[c, j]))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        return pa.table({name: np.concatenate([e, *x]) for name, e, *x in zip(("q", "j", "p", "d", "v"), empty, *out, strict=True)})

    own = base.groupBy("_r", "_g").applyInArrow(inside, "q long, j int, v double, z array<double>, t array<int>").persist()  # read for what is filled and for what isn't
    every = F.array(*[F.lit(r) for r in sorted(counts)]) if counts else F.array().cast("array<int>")
    left = own.where(F.col("z").isNotNull())
    met = F.filter(every, lambda r: F.col("t").isNull() | (r < 0) | ((r >= F.col("t")[0]) & (r <= F.col("t")[1])))
    asked = left.select("q", "z", "j", F.explode(met).alias("_r")).withColumn("_g", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))))
    found = asked.groupBy("_r", "_g").cogroup(base.groupBy("_r", "_g")).applyInArrow(outside, "q long, j int, p long, d double, v double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("q", "j").orderBy("d", "p"))).where(F.col("rank") <= k)
    cells = own.where(F.col("z").isNull()).select("q", "j", "v").unionByName(best.groupBy("q", "j").agg(F.avg("v").alias("v")))
    fills = cells.groupBy("q").agg(*[F.max(F.when(F.col("j") == i, F.col("v"))).alias(f"_v{i}") for i in range(len(columns))])
    means = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    filled = df.join(fills, F.col(key).cast("long") == F.col("q"), "left").crossJoin(F.broadcast(means))
    at = {c: i for i, c in enumerate(columns)}
    return filled.select(*[F.coalesce(F.col(c).cast("double"), f"_v{at[c]}", f"_m{at[c]}").alias(c) if c in at else df[c] for c in df.columns])


def _moments(df: DataFrame, columns: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, sums, cross products) in one aggregation."""
    d = len(columns)
    prod = [F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(d) for j in range(i + 1)]
    row = df.agg(F.count("*"), *[F.sum(c) for c in columns], *prod).first()
    g = np.zeros((d, d))
    g[np.tril_indices(d)] = [x or 0.0 for x in row[1 + d :]]
    return float(row[0]), np.array([x or 0.0 for x in row[1 : 1 + d]], float), g + np.tril(g, -1).T


def solve(gram: np.ndarray, right: np.ndarray, n: float, kind: str, alpha: float, noise: float = 0.0) -> np.ndarray:
    """Coefficients of centred data from its Gram matrix: ridge, lasso (coordinate descent) or bayesian ridge (evidence)."""
    d = len(right)
    if kind == "ridge":
        return np.linalg.solve(gram + alpha * np.eye(d), right)
    if kind == "lasso":
        w = np.zeros(d)
        for _ in range(200):
            old = w.copy()
            for j in range(d):
                if gram[j, j] > 1e-12:
                    r = right[j] - gram[j] @ w + gram[j, j] * w[j]
                    w[j] = np.sign(r) * max(0.0, abs(r) - alpha * n) / gram[j, j]
            if np.abs(w - old).max() < 1e-9:
                break
        return w
    if kind == "bayesian":
        beta, lam, val = 1.0 / max(noise / max(n, 1), 1e-12), 1.0, np.linalg.eigvalsh(gram)
        w = np.zeros(d)
        for _ in range(50):
            w = np.linalg.solve(gram + lam / beta * np.eye(d), right)
            gamma = (beta * val / (lam + beta * val)).sum()
            lam = gamma / max(w @ w, 1e-12)
            beta = max(n - gamma, 1e-6) / max(noise - 2 * w @ right + w @ gram @ w, 1e-12)
        return w
    raise ValueError(kind)


def chained_linear(df: DataFrame, columns: list[str], kind: str = "lasso", alpha: float = 0.1, rounds: int = 3, initial: str = "mean") -> DataFrame:
    """Round-robin linear regressions (van Buuren & Groothuis-Oudshoorn 2011), in one aggregation for each column and round.

    Each column with gaps is regressed on the others over the rows that have it, which gives new values for its gaps.
    """
    marks = {c: f"_miss_{i}" for i, c in enumerate(columns)}
    now = fill(df.select("*", *[F.col(c).isNull().alias(m) for c, m in marks.items()]), columns, initial)
    gaps = now.agg(*[F.max(F.col(m).cast("int")) for m in marks.values()]).first()
    todo = [c for c, g in zip(columns, gaps, strict=True) if g]
    now = now.persist()  # read once for each column and round; each step reads the one before, not the whole lineage
    for _ in range(rounds):
        for c in todo:
            others = [x for x in columns if x != c]
            n, s, g = _moments(now.where(~F.col(marks[c])), [*others, c])
            if n < 2:
                continue
            m = s / n
            centred = g - n * np.outer(m, m)
            sd = np.sqrt(np.maximum(np.diag(centred)[:-1] / n, 1e-12))
            w = solve(centred[:-1, :-1] / np.outer(sd, sd), centred[:-1, -1] / sd, n, kind, alpha, centred[-1, -1]) / sd
            guess = sum((F.lit(float(a)) * (F.col(x) - float(b)) for a, x, b in zip(w, others, m[:-1], strict=True)), F.lit(float(m[-1])))
            last, now = now, now.withColumn(c, F.when(F.col(marks[c]), guess).otherwise(F.col(c))).persist()
            now.count()
            last.unpersist()
    return now.select(*df.columns)


def chained_trees(df: DataFrame, columns: list[str], rounds: int = 1, trees: int = 10, seed: int = 42, initial: str = "median") -> DataFrame:
    """As ``chained_linear`` with MLlib random forests in place of lines (Stekhoven & Buhlmann 2012)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    marks = {c: f"_miss_{i}" for i, c in enumerate(columns)}
    now = fill(df.select("*", *[F.col(c).isNull().alias(m) for c, m in marks.items()]), columns, initial)
    gaps = now.agg(*[F.max(F.col(m).cast("int")) for m in marks.values()]).first()
    now = now.persist()
    for _ in range(rounds):
        for c in [c for c, g in zip(columns, gaps, strict=True) if g]:
            vec = VectorAssembler(inputCols=[x for x in columns if x != c], outputCol="_f")
            both = vec.transform(now)
            model = RandomForestRegressor(featuresCol="_f", labelCol=c, predictionCol="_p", numTrees=trees, maxDepth=5, seed=seed).fit(both.where(~F.col(marks[c])))
            last, now = now, model.transform(both).withColumn(c, F.when(F.col(marks[c]), F.col("_p")).otherwise(F.col(c))).drop("_f", "_p").persist()
            now.count()
            last.unpersist()
    return now.select(*df.columns)


def chained_logistic(df: DataFrame, column: str, others: list[str], kinds: int) -> DataFrame:
    """Fills a categorical int column (0..kinds-1) by multinomial regression on the others; refuses anything else."""
    if kinds < 2:
        raise ValueError(f"{column} is not categorical")
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=others, outputCol="_f").transform(fill(df, others))
    model = LogisticRegression(featuresCol="_f", labelCol=column, predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r", maxIter=50).fit(ready.where(F.col(column).isNotNull()))
    return model.transform(ready).withColumn(column, F.coalesce(F.col(column).cast("int"), F.col("_p").cast("int"))).select(*df.columns)


def hide(df: DataFrame, mask: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with the cells of ``mask`` (key, column) null."""
    hidden = mask.groupBy(F.col(key).alias("_k")).agg(F.collect_set("column").alias("_h"))
    j = df.join(hidden, F.col(key) == F.col("_k"), "left")
    return j.select(*[F.when(~F.coalesce(F.array_contains("_h", c), F.lit(False)), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def reconstruction(cells: DataFrame, group: str = "column") -> DataFrame:
    """Per column over (column, actual, pred): spearman, wasserstein, variance_ratio, nrmse.

    Constant sides give rank correlation 0, no variance gives ratio 1, no range gives 0.
    """
    r = with_rank(with_rank(cells, "actual", "ra", group), "pred", "rp", group)
    main = r.groupBy(group).agg(
        F.coalesce(correlation("ra", "rp"), F.lit(0.0)).alias("spearman"),
        F.when(F.var_pop("actual") > 0, F.var_pop("pred") / F.var_pop("actual")).otherwise(1.0).alias("variance_ratio"),
        F.when(F.max("actual") > F.min("actual"), F.sqrt(F.avg(F.pow(F.col("actual") - F.col("pred"), 2))) / (F.max("actual") - F.min("actual"))).otherwise(0.0).alias("nrmse"),
    )
    # The distance of two samples of one size is the area between their distribution functions.
    sides = cells.select(group, F.inline(F.array(*[F.struct(F.col(c).alias("v"), F.lit(s).alias("s")) for c, s in (("actual", 1), ("pred", -1))])))
    n = sides.groupBy(group, "v").agg(F.sum("s").alias("s"), F.count_if(F.col("s") == 1).alias("n"))
    gap = F.abs(F.col("before_s") + F.col("s")) * (F.col("next") - F.col("v"))
    w = running(n, "v", ["s", "n"], group).groupBy(group).agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.max("all_n")).alias("wasserstein"))
    return main.join(w, group)


def overall(scores: DataFrame) -> DataFrame:
    """Unweighted means over columns; without columns the ratio is 1 and the rest 0."""
    return scores.agg(*[F.coalesce(F.avg(c), F.lit(1.0 if c == "variance_ratio" else 0.0)).alias(c) for c in ("spearman", "wasserstein", "variance_ratio", "nrmse")])


def choose(scored: DataFrame, task: str = "regression") -> DataFrame:
    """The best candidate of (candidate, spearman, nrmse): 0.7 rho - 0.3 nrmse at most, or nrmse at least."""
    value = 0.7 * F.col("spearman") - 0.3 * F.col("nrmse") if task == "regression" else -F.col("nrmse")
    return scored.agg(F.max_by("candidate", F.struct(value.alias("v"), "candidate")).alias("candidate"))
