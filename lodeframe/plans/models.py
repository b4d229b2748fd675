"""Queries over models and explanations. They are trained, so rows alone are compared; tests hold their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators import impute, metrics, outliers, prep, ranks, stats
from ..operators import models as M
from .inputs import COLUMNS, orders_table, series
from .registry import query


def _data(spark, sf, folds: int = 3):
    """(id, x, target, fold): standardised orders with folds; kept, as training reads it many times."""
    t = orders_table(spark, sf)
    v = outliers.standardise(t, "id", COLUMNS).join(t.select("id", "target"), "id")
    return prep.stratified_folds(v, "id", "target", folds).persist()


def _binary(spark, sf, folds: int = 3):
    w = series(spark, sf).select("id", F.col("values").alias("x"), F.col("label").cast("int").alias("label"))
    return prep.stratified_folds(w, "id", "label", folds).persist()


def _regression(name: str, **params):
    def run(spark, sf):
        d = _data(spark, sf)
        p = M.out_of_fold(d, M.regressor(name, "target", "id", **params), "id", 3)
        q = p.join(d.select("id", "target"), "id").withColumn("guess", metrics.apply_cuts(F.col("pred"), [0.5, 1.5, 2.5, 3.5]))
        return metrics.weighted_kappa(q, "target", "guess", [0, 1, 2, 3, 4])

    return run


def _classification(name: str, **params):
    def run(spark, sf):
        d = _binary(spark, sf)
        w = stats.class_shares(d, "label").select("label", F.col("weight").alias("w"))
        p = M.out_of_fold(d.join(F.broadcast(w), "label"), M.classifier(name, "label", "id", "w", **params), "id", 3)
        q = p.join(d.select("id", "label"), "id")
        return metrics.best_threshold(metrics.binary_sweep(q, "label", "pred"))

    return run


for _name in ("ridge_reg", "lasso_reg", "rf_reg", "lgbm_reg"):
    _f = _regression(_name, numTrees="5", maxIter="3")
    _f.__name__ = f"model_{_name}"
    query()(_f)
for _name in ("lr_clf", "rf_clf", "svc_clf"):
    _f = _classification(_name, numTrees="5", maxIter="10")
    _f.__name__ = f"model_{_name}"
    query()(_f)


@query()
def model_mlp_clf(spark, sf):
    d = _binary(spark, sf)
    model = M.perceptron(d.where("fold <> 0"), "label", [64, 8, 2], 20)
    p = model.transform(M.vectors(d.where("fold = 0"))).select("id", "label", F.col("prediction").cast("int").alias("guess"))
    return metrics.summary(p, "label", "guess")


@query()
def stacking(spark, sf):
    bases = {"ridge": M.regressor("ridge_reg", "target", "id"), "forest": M.regressor("rf_reg", "target", "id", numTrees="5")}
    return M.stack(_data(spark, sf), bases, "id", "target", 3)[1]


@query()
def calibration(spark, sf):
    d = _binary(spark, sf)
    p = M.out_of_fold(d, M.classifier("rf_clf", "label", "id", numTrees="5"), "id", 3).join(d.select("id", "label"), "id")
    return M.calibrate(p, "label", "pred").select("id", "pred", "calibrated")


@query()
def rocket_features(spark, sf):
    return M.kernel_features(series(spark, sf), "id", "values", 32)


@query()
def multirocket_features(spark, sf):
    return M.kernel_features(series(spark, sf), "id", "values", 16, pools=("ppv", "max", "mean"))


@query()
def hydra_features(spark, sf):
    return M.competing_kernels(series(spark, sf), "id", "values")


@query()
def rdst_features(spark, sf):
    return M.dilated_shapelets(series(spark, sf), "id", "values", 16)


@query()
def trial_search(spark, sf):
    d = _data(spark, sf)

    def score(p: dict) -> float:
        fit = M.regressor("ridge_reg", "target", "id", regParam=p["regParam"])(d.where("fold <> 0"))
        q = fit(d.where("fold = 0")).join(d.select("id", "target"), "id")
        return -q.agg(F.avg(F.pow(F.col("pred") - F.col("target"), 2))).first()[0]

    from ..sources.tables import TRIAL_SCHEMA, best_trial

    log = M.search(d, {"regParam": (0.01, 2.0)}, 3, score)
    return best_trial(spark.createDataFrame([("ridge", t["number"], t["value"], t["state"], t["params"]) for t in log], TRIAL_SCHEMA)).select("study", "number", "value")


def _scorer(spark, sf):
    """(predict, features): a ridge line over orders that turns (.., x) into (.., pred)."""
    d = _data(spark, sf)
    n, s, g = impute._moments(d.select(*[F.col("x")[i].alias(c) for i, c in enumerate(COLUMNS)], F.col("target").cast("double").alias("y")), [*COLUMNS, "y"])
    import numpy as np

    m = s / n
    c = g - n * np.outer(m, m)
    w = impute.solve(c[:-1, :-1], c[:-1, -1], n, "ridge", 1.0)
    line = sum((F.col("x")[i] * float(a) for i, a in enumerate(w)), F.lit(float(m[-1])))
    return (lambda df: df.withColumn("pred", line)), d


@query()
def surrogate_tree(spark, sf):
    predict, d = _scorer(spark, sf)
    model, agree = X.surrogate_tree(predict(d).withColumn("pred", (F.col("pred") > 2.0).cast("int")), "pred", COLUMNS, 3)
    return spark.createDataFrame([(r, float(p), float(agree)) for r, p in X.tree_rules(model, COLUMNS)], "rule string, outcome double, fidelity double")


@query()
def feature_importances(spark, sf):
    predict, d = _scorer(spark, sf)
    model, _ = X.surrogate_tree(predict(d).withColumn("pred", (F.col("pred") > 2.0).cast("int")), "pred", COLUMNS, 3)
    return X.importances(model, COLUMNS, spark)


@query()
def lore_rule(spark, sf):
    predict, d = _scorer(spark, sf)
    x = list(d.orderBy("id").first()["x"])
    cut = ranks.quantiles(predict(d), {"pred": "pred"}, [0.5]).first()["value"]
    r = X.local_rule(spark, lambda df: predict(df).withColumn("pred", (F.col("pred") > cut).cast("int")), x, [0.5] * 5, COLUMNS, 400)
    return spark.createDataFrame([(r["rule"], r["counterfactual"], float(r["fidelity"]))], "rule string, counterfactual string, fidelity double")


@query()
def local_linear(spark, sf):
    predict, d = _scorer(spark, sf)
    return X.local_linear(spark, predict, list(d.orderBy("id").first()["x"]), [0.5] * 5, COLUMNS, 300)


@query()
def kernel_shap(spark, sf):
    predict, d = _scorer(spark, sf)
    return X.kernel_shap(predict, list(d.orderBy("id").first()["x"]), X.background(d, "id", 50).select("x"), COLUMNS)
