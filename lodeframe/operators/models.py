"""Models: MLlib behind one registry, folds as a column, stacking, calibration, resampling, random kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw, uniform

INTEGERS = frozenset({"maxDepth", "numTrees", "maxIter", "maxBins", "minInstancesPerNode", "seed", "subsamplingSeed"})


def estimator(name: str, **params):
    """An MLlib estimator by name; params named there are set, whole numbers for those that need them, others ignored.

    Boosters stand for the boosting libraries, random forests for forests and extra trees, linear SVM for kernel machines:
    they are analogues and don't claim the same quality.
    """
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    kinds = {
        "ridge_reg": lambda: R.LinearRegression(elasticNetParam=0.0, regParam=1.0), "lasso_reg": lambda: R.LinearRegression(elasticNetParam=1.0, regParam=0.1),
        "rf_reg": lambda: R.RandomForestRegressor(numTrees=20, seed=42), "lgbm_reg": lambda: R.GBTRegressor(maxIter=10, seed=42),
        "xgb_reg": lambda: R.GBTRegressor(maxIter=10, maxDepth=4, seed=42), "cb_reg": lambda: R.GBTRegressor(maxIter=10, maxDepth=6, seed=42),
        "lr_clf": lambda: C.LogisticRegression(maxIter=50), "rf_clf": lambda: C.RandomForestClassifier(numTrees=20, seed=42),
        "lgbm_clf": lambda: C.OneVsRest(classifier=C.GBTClassifier(maxIter=5, seed=42)), "svc_clf": lambda: C.OneVsRest(classifier=C.LinearSVC(maxIter=20)),
        "ridge_clf": lambda: C.OneVsRest(classifier=C.LinearSVC(maxIter=20, regParam=0.1)),
    }
    made = kinds[name]()
    known = {p.name for p in made.params}
    return made.copy({made.getParam(k): int(float(v)) if k in INTEGERS else v for k, v in params.items() if k in known})


def vectors(df: DataFrame, x: str = "x") -> DataFrame:
    return df.withColumn("features", array_to_vector(x))


def out_of_fold(df: DataFrame, fitted, key: str, folds: int) -> DataFrame:
    """(key, pred): each fold predicted by a model of the others; ``fitted(train)`` gives a function test -> (key, pred)."""
    out = None
    for k in range(folds):
        part = fitted(df.where(F.col("fold") != k))(df.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def _reduced(train: DataFrame, params: dict):
    """(table with features, function that adds them): principal axes come first where params have pca_n_components."""
    k = params.get("pca_n_components")
    if not k:
        return vectors(train), vectors
    from pyspark.ml.feature import PCA

    axes = PCA(k=int(float(k)), inputCol="_all", outputCol="features").fit(train.withColumn("_all", array_to_vector("x")))
    apply = lambda df: axes.transform(df.withColumn("_all", array_to_vector("x")))
    return apply(train), apply


def regressor(name: str, label: str, key: str, **params):
    def fit(train: DataFrame):
        ready, apply = _reduced(train, params)
        model = estimator(name, **params).setLabelCol(label).setFeaturesCol("features").setPredictionCol("_p").fit(ready)
        return lambda test: model.transform(apply(test)).select(key, F.col("_p").alias("pred"))

    return fit


def probabilities(name: str, label: str, key: str, classes: int, weight: str | None = None, **params):
    """As ``regressor``; pred is an array of the probability of each class 0..classes-1.

    Models without probabilities give the softmax of their raw scores, one-vs-rest models that of each class's score.
    """
    from .metrics import softmax

    def fit(train: DataFrame):
        ready, apply = _reduced(train, params)
        est = estimator(name, **params).setLabelCol(label).setFeaturesCol("features")
        if weight and est.hasParam("weightCol"):
            est = est.setWeightCol(weight)
        model = est.fit(ready)

        def predict(test: DataFrame) -> DataFrame:
            t = model.transform(apply(test))
            p = vector_to_array("probability") if "probability" in t.columns else softmax(vector_to_array("rawPrediction"))
            padded = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce(F.get(p, i), F.lit(0.0)))
            return t.select(key, padded.alias("pred"))

        return predict

    return fit


def classifier(name: str, label: str, key: str, weight: str | None = None, **params):
    """As ``probabilities``; pred is that of label 1."""
    whole = probabilities(name, label, key, 2, weight, **params)

    def fit(train: DataFrame):
        predict = whole(train)
        return lambda test: predict(test).select(key, F.col("pred")[1].alias("pred"))

    return fit


def thresholded(fitted, train: DataFrame, test: DataFrame, threshold: float) -> DataFrame:
    """(key, pred, guess): fitted on all of ``train``, label 1 where its probability reaches ``threshold`` on ``test``."""
    return fitted(train)(test).withColumn("guess", (F.col("pred") >= threshold).cast("int"))


def multiplied(pred, multipliers: list[float]):
    """The first class whose probability times its multiplier is greatest."""
    scaled = F.zip_with(pred, F.array(*[F.lit(float(m)) for m in multipliers]), lambda p, m: p * m)
    return (F.array_position(scaled, F.array_max(scaled)) - 1).cast("int")


def class_multipliers(df: DataFrame, label: str, pred: str, classes: int, places: int = 50, rounds: int = 500) -> list[float]:
    """Multipliers of class probabilities with the best macro F1, by the simplex method, clipped to [0.1, 10].

    Rows are counted by label and by their probabilities in steps of 1 / ``places``, a table whose size doesn't grow with
    the rows; it is read back.
    """
    from .metrics import nelder_mead

    steps = [F.round(F.col(pred)[i] * places).cast("int").alias(f"p{i}") for i in range(classes)]
    rows = df.groupBy(*steps, F.col(label).cast("int").alias("y")).count().collect()
    if not rows:
        return [1.0] * classes
    p, y, n = np.array([[r[f"p{i}"] for i in range(classes)] for r in rows], float), np.array([r["y"] for r in rows]), np.array([r["count"] for r in rows], float)

    def loss(m: np.ndarray) -> float:
        guess = (p * np.clip(m, 0.1, 10.0)).argmax(axis=1)
        f1 = []
        for c in range(classes):
            tp, said, have = n[(guess == c) & (y == c)].sum(), n[guess == c].sum(), n[y == c].sum()
            f1.append(2 * tp / (said + have) if said + have else 0.0)
        return -float(np.mean(f1))

    return np.clip(nelder_mead(loss, np.ones(classes), rounds=rounds), 0.1, 10.0).tolist()


def stack_classes(df: DataFrame, bases: dict, key: str, label: str, folds: int, classes: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """((key, pred, guess), (base, class, weight), multipliers): a logistic model on out-of-fold class probabilities.

    ``bases`` are of ``probabilities``. The multipliers are those of the stacked model's own probabilities.
    """
    from pyspark.ml.classification import LogisticRegression

    wide = df.select(key, F.col(label).cast("int").alias("_y"))
    for name, fit in bases.items():
        wide = wide.join(out_of_fold(df, fit, key, folds).withColumnRenamed("pred", name), key)
    ready = vectors(wide.select(key, "_y", F.concat(*bases).alias("x")))
    model = LogisticRegression(labelCol="_y", maxIter=50, regParam=0.01, family="multinomial").fit(ready)
    p = vector_to_array("probability")
    pred = model.transform(ready).select(key, "_y", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce(F.get(p, i), F.lit(0.0))).alias("pred"))
    m = class_multipliers(pred, "_y", "pred", classes)
    coef = model.coefficientMatrix.toArray()
    weights = [(b, c, float(np.abs(coef[:, i * classes + c]).mean())) for i, b in enumerate(bases) for c in range(classes)]
    return pred.select(key, "pred", multiplied(F.col("pred"), m).alias("guess")), df.sparkSession.createDataFrame(weights, "base string, class int, weight double"), m


def stack(df: DataFrame, bases: dict, key: str, label: str, folds: int, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((key, pred), (base, weight)): ridge on out-of-fold predictions of the bases, from one Gram aggregation."""
    from .impute import _moments, solve

    wide = df.select(key, F.col(label).cast("double").alias("_y"))
    for name, fit in bases.items():
        wide = wide.join(out_of_fold(df, fit, key, folds).withColumnRenamed("pred", name), key)
    cols = list(bases)
    n, s, g = _moments(wide, [*cols, "_y"])
    m = s / n
    c = g - n * np.outer(m, m)
    w = solve(c[:-1, :-1], c[:-1, -1], n, "ridge", alpha)
    pred = sum((F.lit(float(a)) * (F.col(x) - float(b)) for a, x, b in zip(w, cols, m[:-1], strict=True)), F.lit(float(m[-1])))
    weights = df.sparkSession.createDataFrame([(x, float(a)) for x, a in zip(cols, w, strict=True)], "base string, weight double")
    return wide.select(key, pred.alias("pred")), weights


def calibrate(scores: DataFrame, label: str, score: str) -> DataFrame:
    """Adds calibrated: a logistic curve of the score (Platt 1999) by Newton's method, one small aggregation a step."""
    a, b = 1.0, 0.0
    kept = scores.select(label, score).persist()  # read once for each step
    for _ in range(15):
        z = F.lit(a) * F.col(score) + F.lit(b)
        p = 1 / (1 + F.exp(-z))
        e, h, s = F.col(label) - p, p * (1 - p), F.col(score)
        g1, g0, h11, h10, h00 = kept.agg(F.sum(e * s), F.sum(e), F.sum(h * s * s), F.sum(h * s), F.sum(h)).first()
        step = np.linalg.solve(np.array([[h11 + 1e-6, h10], [h10, h00 + 1e-6]]), np.array([g1, g0]))
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    kept.unpersist()
    return scores.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(a) * F.col(score) + F.lit(b)))))


def random_kernels(n: int, seed: int = 42) -> list[tuple[list[float], int, float]]:
    """(weights, dilation, bias quantile): windows of nine, two thirds -1 and one third 2 (Dempster et al. 2021)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        w = np.full(9, -1.0)
        w[rng.choice(9, 3, replace=False)] = 2.0
        out.append((w.tolist(), int(2 ** rng.integers(0, 3)), float(rng.uniform(0.1, 0.9))))
    return out


def kernel_features(df: DataFrame, key: str, values: str, n: int = 64, seed: int = 42, pools: tuple[str, ...] = ("ppv",)) -> DataFrame:
    """(key, x): for each kernel the share of positive responses (ppv), and with "max" or "mean" those too (Tan et al. 2022).

    The bias of a kernel is a quantile of its response on the series itself.
    """
    kernels = random_kernels(n, seed)

    def features(v: np.ndarray) -> np.ndarray:
        """Of series of one length, a row for each: every kernel runs over all of them at once."""
        out = []
        for w, d, q in kernels:
            p = np.pad(v, ((0, 0), (4 * d, 4 * d)))
            r = sum(a * p[:, k * d : k * d + v.shape[1]] for k, a in enumerate(w))
            r = r - np.quantile(r, q, axis=1, keepdims=True)
            up = r > 0
            out.append(up.mean(axis=1))
            out += [r.max(axis=1)] * ("max" in pools)
            out += [np.where(up, r, 0.0).sum(axis=1) / np.maximum(up.sum(axis=1), 1)] * ("mean" in pools)
        return np.stack(out, axis=1)

    return _by_length(df, key, values, features)


def _by_length(df: DataFrame, key: str, values: str, features, rows: int = 1024) -> DataFrame:
    """(key, x): ``features`` of matrices of series of one length, up to ``rows`` at a time."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), rows):
                pdf = whole.iloc[at : at + rows]
                size = pdf[values].map(len).to_numpy()
                x: list = [None] * len(pdf)
                for n in np.unique(size):
                    mine = np.flatnonzero(size == n)
                    got = features(np.stack(pdf[values].iloc[mine].to_numpy()).astype(float)).tolist()
                    for i, row in zip(mine, got, strict=True):
                        x[i] = row
                yield pd.DataFrame({key: pdf[key].to_numpy(), "x": x})

    return df.select(key, values).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, x array<double>")


def competing_kernels(df: DataFrame, key: str, values: str, groups: int = 8, kernels: int = 8, seed: int = 42) -> DataFrame:
    """(key, x): how often each random kernel of a group gives the strongest response (Dempster et al. 2023)."""
    bank = np.random.default_rng(seed).normal(size=(groups, kernels, 9))
    bank -= bank.mean(axis=2, keepdims=True)

    def features(v: np.ndarray) -> np.ndarray:
        w = np.lib.stride_tricks.sliding_window_view(np.pad(v, ((0, 0), (4, 4))), 9, axis=1)
        best = np.einsum("stk,gjk->sgtj", w, bank, optimize=True).argmax(axis=3)
        return (best[..., None] == np.arange(kernels)).mean(axis=2).reshape(len(v), groups * kernels)

    return _by_length(df, key, values, features, 64)


def dilated_shapelets(df: DataFrame, key: str, values: str, n: int = 32, length: int = 9, seed: int = 42) -> DataFrame:
    """(key, x): least distance, its place and the share of close windows for n random dilated shapelets (Guillaume 2022)."""
    rng = np.random.default_rng(seed)
    source = [np.array(r[0], float) for r in df.orderBy(draw(seed, key), key).limit(n).select(values).collect()]
    shapes = []
    for v in source:
        d = int(2 ** rng.integers(0, 3))
        if len(v) >= (length - 1) * d + 1:
            s = int(rng.integers(0, len(v) - (length - 1) * d))
            shapes.append((v[s : s + (length - 1) * d + 1 : d], d))

    def features(v: np.ndarray) -> np.ndarray:
        out = []
        for s, d in shapes:
            if v.shape[1] < (length - 1) * d + 1:
                out += [np.zeros(len(v))] * 3
                continue
            w = np.lib.stride_tricks.sliding_window_view(v, (length - 1) * d + 1, axis=1)[:, :, ::d]
            r = np.abs(w - s).sum(axis=2)
            low = r.min(axis=1)
            out += [low, r.argmin(axis=1) / r.shape[1], (r <= 1.25 * low[:, None] + 1e-12).mean(axis=1)]
        return np.stack(out, axis=1) if out else np.zeros((len(v), 0))

    return _by_length(df, key, values, features)


def perceptron(df: DataFrame, label: str, layers: list[int], rounds: int = 50, seed: int = 42):
    """MLlib's multilayer perceptron; layers are the sizes from input to output."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers, maxIter=rounds, seed=seed).fit(vectors(df))


def perceptron_regressor(df: DataFrame, label: str, hidden: int = 16, rounds: int = 40, rate: float = 0.05, seed: int = 42):
    """A one-layer network for regression on x, by Adam over whole-table gradients; gives a function test -> with pred.

    Each round is one pass in which a task adds up the gradient of its rows; a row for each partition reaches the driver.
    """
    d, mean = df.agg(F.max(F.size("x")), F.avg(F.col(label).cast("double"))).first()
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, (2 / max(1, d or 1)) ** 0.5, (d or 1, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.array(float(mean or 0.0))]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]

    def layers(x: np.ndarray, w: list) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ w[0] + w[1], 0.0)
        return h, h @ w[2] + w[3]

    def gradient(w: list):
        def run(batches):
            total, n = np.zeros(sum(a.size for a in w)), 0
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["x"].to_numpy()).astype(float)
                    h, p = layers(x, w)
                    e = p - pdf["_y"].to_numpy(float)
                    back = e[:, None] * w[2][None] * (h > 0)
                    total += np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), h.T @ e, [e.sum()]])
                    n += len(x)
            yield pd.DataFrame({"g": [total.tolist()], "n": [n]})

        return run

    ready = df.select("x", F.col(label).cast("double").alias("_y")).persist()
    for t in range(1, rounds + 1):
        parts = ready.mapInPandas(gradient(w), "g array<double>, n long").collect()
        n = max(1, sum(r["n"] for r in parts))
        flat, at = sum(np.array(r["g"]) for r in parts) / n, 0
        for i, a in enumerate(w):
            g = flat[at : at + a.size].reshape(a.shape)
            at += a.size
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] = a - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    ready.unpersist()

    @F.pandas_udf("double")
    def predict(x: pd.Series) -> pd.Series:
        return pd.Series(layers(np.stack(x.to_numpy()).astype(float), w)[1]) if len(x) else pd.Series([], dtype=float)

    return lambda test: test.withColumn("pred", predict("x"))


def search(df: DataFrame, space: dict[str, tuple[float, float]], trials: int, score, seed: int = 42) -> list[dict]:
    """A trial log: params by hashed draws, value by ``score(params)``; a failing trial is logged and scored None."""
    import hashlib

    log = []
    for t in range(trials):
        u = lambda name, t=t: int(hashlib.md5(f"{seed}:{t}:{name}".encode()).hexdigest()[:8], 16) / 2**32
        params = {k: lo + (hi - lo) * u(k) for k, (lo, hi) in space.items()}
        try:
            log.append({"number": t, "value": float(score(params)), "state": "COMPLETE", "params": {k: str(v) for k, v in params.items()}})
        except Exception as e:  # noqa: BLE001  a trial may fail; the log says how
            log.append({"number": t, "value": None, "state": f"FAIL: {type(e).__name__}", "params": {k: str(v) for k, v in params.items()}})
    return log


def tomek_links(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(a, b) with a < b: each the other's nearest neighbour, of opposite classes."""
    near = neighbours.where("rank = 1").select(F.col(key).alias("a"), F.col("neighbour").alias("b"))
    back = near.select(F.col("b").alias("a2"), F.col("a").alias("b2"))
    y = lambda c, n: labels.select(F.col(key).alias(c), F.col(label).alias(n))
    both = near.join(back, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))).where("a < b").select("a", "b")
    return both.join(y("a", "ya"), "a").join(y("b", "yb"), "b").where("ya <> yb").select("a", "b")


def edited_neighbours(neighbours: DataFrame, labels: DataFrame, key: str, label: str, k: int = 3) -> DataFrame:
    """(key, keep): rows most of whose k neighbours share their label."""
    y = labels.select(F.col(key).alias("_n"), F.col(label).alias("_y"))
    own = labels.select(key, F.col(label).alias("_own"))
    j = neighbours.where(F.col("rank") <= k).join(y, F.col("neighbour") == F.col("_n")).join(own, key)
    return j.groupBy(key).agg((F.sum((F.col("_y") == F.col("_own")).cast("int")) * 2 > F.count("*")).alias("keep"))


def synthetic_minority(v: DataFrame, neighbours: DataFrame, key: str, copies: int, seed: int = 42) -> DataFrame:
    """(source, neighbour, copy, x): points between minority rows and hashed neighbours of theirs (Chawla et al. 2002)."""
    k = neighbours.agg(F.max("rank")).first()[0] or 1
    want = v.select(key, "x", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy")).withColumn("_r", F.floor(uniform(f"{seed}:pick", key, "copy") * k).cast("int") + 1)
    n = neighbours.select(F.col(key).alias("_k"), F.col("neighbour"), F.col("rank").alias("_rank"))
    other = v.select(F.col(key).alias("_o"), F.col("x").alias("_y"))
    j = want.join(n, (F.col(key) == F.col("_k")) & (F.col("_r") == F.col("_rank"))).join(other, F.col("neighbour") == F.col("_o"))
    u = uniform(f"{seed}:gap", key, "copy")
    return j.withColumn("_u", u).select(F.col(key).alias("source"), "neighbour", "copy", F.zip_with("x", "_y", lambda a, b: a + (b - a) * F.col("_u")).alias("x"))


def adaptive_minority(v: DataFrame, among: DataFrame, own: DataFrame, labels: DataFrame, key: str, label: str, ratio: float = 1.0, seed: int = 42, minority: int = 1) -> DataFrame:
    """(source, neighbour, copy, x): as ``synthetic_minority``, more copies for rows with more of the other class around (He et al. 2008).

    ``among`` are the neighbours of minority rows among all rows, ``own`` those among minority rows, which copies lie
    towards. A row's copies are its share of opposite neighbours among all such shares, times ``ratio`` times the
    difference of class sizes, rounded half up.
    """
    y = labels.select(F.col(key).alias("_n"), F.col(label).alias("_y"))
    hard = among.join(y, F.col("neighbour") == F.col("_n")).groupBy(key).agg(F.avg((F.col("_y") != minority).cast("double")).alias("_r"))
    every = hard.agg(F.sum("_r").alias("_all"))
    sizes = labels.agg(F.sum(F.when(F.col(label) == minority, -1).otherwise(1)).alias("_gap"))
    g = hard.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(sizes)).select(key, F.floor(F.col("_r") / F.col("_all") * F.greatest(F.lit(0), "_gap") * ratio + 0.5).cast("int").alias("_g"))
    same = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("_s"))  # at most k
    want = v.join(g.where("_g > 0"), key).join(same, key).select(key, "x", "_s", F.explode(F.sequence(F.lit(1), F.col("_g"))).alias("copy"))
    picked = want.withColumn("_p", F.get("_s", F.floor(uniform(f"{seed}:pick", key, "copy") * F.size("_s")).cast("int"))["neighbour"])
    other = v.select(F.col(key).alias("_o"), F.col("x").alias("_z"))
    j = picked.join(other, F.col("_p") == F.col("_o")).withColumn("_u", uniform(f"{seed}:gap", key, "copy"))
    return j.select(F.col(key).alias("source"), F.col("_p").alias("neighbour"), "copy", F.zip_with("x", "_z", lambda a, b: a + (b - a) * F.col("_u")).alias("x"))


def resampled(df: DataFrame, key: str, label: str, how: str, k: int = 5, minority: int = 1) -> DataFrame:
    """(x, label) of ``df`` (key, x, label): "none", "smote", "adasyn", "enn", "tomek", "smote_enn" or "smote_tomek"."""
    return resamplings(df, key, label, (how,), k, minority)[0][how]


def resamplings(df: DataFrame, key: str, label: str, hows: tuple[str, ...], k: int = 5, minority: int = 1) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """({how: (x, label)}, tables written for them): each way of ``resampled``; ways share the neighbours and made rows that they have in common.

    Neighbours and made rows are written, so that no plan on top searches again or carries theirs along; the caller
    releases them when it has read the ways.
    """
    from ..llm.common import cut
    from .kernels import nearest

    held: list[DataFrame] = []

    def kept(t: DataFrame) -> DataFrame:
        held.append(cut(t, "neighbours"))
        return held[-1]

    own = kept(df.select(F.col(key).cast("long").alias("id"), "x", F.col(label).cast("int").alias("label")))
    grown, near = {"none": own}, {}
    if any("smote" in how or how == "adasyn" for how in hows):
        few = own.where(F.col("label") == minority)
        n = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
        gap = max(0, max(n.values(), default=0) - n.get(minority, 0))
        if gap and n.get(minority, 0) > 1:
            among = kept(nearest(few, few, "id", "x", k))  # of fewer than k others all

            def with_made(new: DataFrame) -> DataFrame:
                made = new.select((-1 - F.xxhash64("source", "copy").bitwiseAND(F.lit((1 << 62) - 1))).alias("id"), "x", F.lit(minority).alias("label"))
                return kept(own.unionByName(made))

            if "adasyn" in hows:
                grown["adasyn"] = with_made(adaptive_minority(few, kept(nearest(few, own, "id", "x", k)), among, own, "id", "label", minority=minority))
            if any("smote" in how for how in hows):
                every = synthetic_minority(few, among, "id", -(-gap // n[minority]))
                grown["smote"] = with_made(every.orderBy(draw(42, "source", "copy"), "source", "copy").limit(gap))  # as many as the classes differ by

    def cleaned(way: str, on: str) -> DataFrame:
        t = grown.get(on, own)
        if on not in near:
            near[on] = kept(nearest(t, t, "id", "x", 3))  # the first of them is the nearest, which is all that links ask for
        if way == "enn":
            keep = edited_neighbours(near[on], t, "id", "label", 3)
            return t.join(keep.where("keep").select("id"), "id", "left_semi")
        links = tomek_links(near[on], t, "id", "label")
        bad = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
        return t.join(bad, "id", "left_anti")

    ways = {}
    for how in hows:
        on, _, way = how.rpartition("_") if how.endswith(("enn", "tomek")) else (how, "", "")
        ways[how] = (cleaned(way, on or "none") if way else grown.get(on, own)).select("x", "label")
    return ways, held
