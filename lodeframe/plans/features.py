"""Queries over prepared features: the extractor, fusion, chains fitted on one half, noise, multipliers."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..operators import chain, extract, metrics, prep
from ..operators import models as M
from .inputs import COLUMNS, PRED, SERIES, orders_table, predictions, series
from .models import _binary, _data
from .registry import near, query
from .registry import near_sql as R
from .tables import SPLIT

N = 64  # values of a series


@query(f"""WITH {SPLIT}, t AS (SELECT tab.*, "Split" FROM tab JOIN split USING (id)), """ + ", ".join(
    f"s_{c} AS (SELECT avg({c}) AS m, stddev_pop({c}) AS s, quantile_cont({c}, 0.5) AS q FROM t WHERE \"Split\" = 'Train')" for c in COLUMNS
) + " SELECT id, " + ", ".join(R(f"(coalesce({c}, (SELECT q FROM s_{c})) - (SELECT m FROM s_{c})) / (SELECT s FROM s_{c})", 4) + f" AS {c}" for c in COLUMNS) + ' FROM t WHERE "Split" = \'Test\'')
def preprocess_apply(spark, sf):
    """Scaled and filled by what the training half says, for the test half."""
    t = orders_table(spark, sf)
    s = prep.stratified_split(t, "id", "target")
    made = chain.fit(s.where("Split = 'Train'"), COLUMNS).apply(s.where("Split = 'Test'"), "id")
    return made.select("id", *[near(F.col("x")[i], 4).alias(c) for i, c in enumerate(COLUMNS)])


@query()
def preprocess_axes(spark, sf):
    s = prep.stratified_split(orders_table(spark, sf), "id", "target")
    return chain.fit(s.where("Split = 'Train'"), COLUMNS, "mean", 2).apply(s.where("Split = 'Test'"), "id")


U = lambda what: f"(('0x' || substr(md5('42:{what}:' || id::varchar || ':' || k::varchar), 1, 8))::bigint / 4294967296.0)"


@query(f"WITH {SERIES} SELECT id, k AS pos, {R(f'v[k + 1] + 0.01 * sqrt(-2 * ln(1 - {U("r")})) * cos(2 * pi() * {U("a")})', 6)} AS x FROM series CROSS JOIN (SELECT unnest(range(64))::int AS k)")
def jitter(spark, sf):
    noisy = prep.jitter(series(spark, sf), "id", "values", 0.01)
    return noisy.select("id", F.posexplode("values").alias("pos", "x")).withColumn("x", near("x", 6))


@query(f"WITH {SERIES} SELECT id, len(list_concat(v, v[1:8]))::int AS n, round(list_sum(list_concat(v, v[1:8])), 6) AS total, round(list_concat(v, v[1:8])[65], 6) AS x64 FROM series")
def stacked_columns(spark, sf):
    from ..functions.arrays import total

    s = series(spark, sf).select("id", "values")
    j = prep.stack_columns([s, s.select("id", F.slice("values", 1, 8).alias("values"))], "id", "values")
    return j.select("id", F.size("values").alias("n"), F.round(total(F.col("values")), 6).alias("total"), F.round(F.col("values")[64], 6).alias("x64"))


@query("""WITH r AS (SELECT unnest(range(3))::int AS round) SELECT round, vec_id AS id, row_number() OVER (PARTITION BY round ORDER BY md5('42:' || round::varchar || ':' || vec_id::varchar), vec_id) AS place FROM embeddings, r""")
def resample_indices(spark, sf):
    return prep.resample_indices(series(spark, sf), "id", 3)


@query(f"""WITH {PRED}, p AS (SELECT id, [prob, 0.8 * (1 - prob), 0.2 * (1 - prob)] AS p FROM pred), q AS (SELECT id, [p[1] * 0.5, p[2], p[3] * 4.0] AS q FROM p)
  SELECT id, (list_position(q, list_max(q)) - 1)::int AS guess FROM q""")
def multipliers_apply(spark, sf):
    p = F.col("prob")
    return predictions(spark, sf).select("id", M.multiplied(F.array(p, 0.8 * (1 - p), 0.2 * (1 - p)), [0.5, 1.0, 4.0]).alias("guess"))


POOLS9 = ("mean", "min", "max", "std", "slope", "crossings", "above", "median", "iqr")


@query("WITH o AS (SELECT unnest(['mean', 'min', 'max', 'std', 'slope', 'crossings', 'above', 'median', 'iqr']) AS pool, unnest(range(9)) AS i), p AS (SELECT level::int AS level, unnest(range((2 ^ level)::bigint))::int AS part FROM (SELECT unnest(range(3)) AS level)), "
       "r AS (SELECT level, part, pool, row_number() OVER (PARTITION BY level, part ORDER BY md5('42:' || level::varchar || ':' || part::varchar || ':' || pool)) AS r FROM o, p) SELECT level, part, pool FROM r WHERE level = 0 OR r <= 6")
def sampled_operators(spark, sf):
    rows = [(lv, p, o) for lv in range(3) for p in range(2**lv) for o in extract.sample_operators(POOLS9, 6, lv, p)]
    return spark.createDataFrame(rows, "level int, part int, pool string")


def _chosen(spark, sf):
    s = prep.stratified_split(series(spark, sf), "id", "label")
    train = s.where("Split = 'Train'")
    return s, extract.choose(train, "id", "values", "label", N)


@query()
def extracted_features(spark, sf):
    """The selected features of the test half, chosen by the training half: only these are computed there."""
    s, wanted = _chosen(spark, sf)
    return extract.extract(s.where("Split = 'Test'"), "id", "values", wanted, N)


@query()
def selected_features(spark, sf):
    wanted = _chosen(spark, sf)[1]
    rows = [(i, f.name(), f.length, f.dilation, f.level, f.part) for i, f in enumerate(wanted)]
    return spark.createDataFrame(rows, "i int, name string, length int, dilation int, level int, part int")


@query()
def fused_features(spark, sf):
    """Two channels, the series and its negative, extracted and put side by side."""
    s = series(spark, sf).select("id", "values")
    f = [x for x in extract.catalogue(N, 1) if x.level == 0 and x.representation == "original"]
    both = [s, s.select("id", F.transform("values", lambda v: -v).alias("values"))]
    return extract.fuse([extract.extract(c, "id", "values", f, N, 1) for c in both], "id")


@query()
def thresholded_guess(spark, sf):
    """The threshold of the best macro F1 out of fold on the training half, applied to the test half."""
    s = prep.stratified_split(_binary(spark, sf), "id", "label")
    train, test = s.where("Split = 'Train'"), s.where("Split = 'Test'")
    fit = M.classifier("lr_clf", "label", "id", maxIter="10")
    out = M.out_of_fold(train, fit, "id", 3).join(train.select("id", "label"), "id")
    t = metrics.best_threshold(metrics.binary_sweep(out, "label", "pred")).first()["threshold"]
    return M.thresholded(fit, train, test, float(t))


@query()
def class_probabilities(spark, sf):
    d = _data(spark, sf)
    return M.out_of_fold(d, M.probabilities("lr_clf", "target", "id", 5, maxIter="5", pca_n_components="3"), "id", 3)


@query()
def stacking_classes(spark, sf):
    d = _data(spark, sf)
    bases = {"logistic": M.probabilities("lr_clf", "target", "id", 5, maxIter="5"), "forest": M.probabilities("rf_clf", "target", "id", 5, numTrees="5")}
    p, _, _ = M.stack_classes(d, bases, "id", "target", 3, 5)
    return metrics.summary(p.join(d.select("id", F.col("target").cast("int").alias("target")), "id"), "target", "guess")


@query()
def model_mlp_reg(spark, sf):
    d = _data(spark, sf)
    p = M.perceptron_regressor(d.where("fold <> 0"), "target", 8, 15)(d.where("fold = 0"))
    q = p.withColumn("guess", functools.reduce(lambda a, b: a + b, [(F.col("pred") > c).cast("int") for c in (0.5, 1.5, 2.5, 3.5)]))
    return metrics.weighted_kappa(q, "target", "guess", [0, 1, 2, 3, 4])
