"""Queries over outlier detectors and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute as I
from ..operators import outliers as O
from ..operators import prep
from .inputs import COLUMNS, HOLES, TAB, orders_table, read
from .kernels import NEAR, _near
from .registry import query

SUP = ["acct", "nation", "n"]
V = """raw AS (SELECT s_suppkey AS id, s_acctbal AS acct, s_nationkey::double AS nation, coalesce(n, 0)::double AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey),
st AS (SELECT avg(acct) AS a0, stddev_pop(acct) AS s0, avg(nation) AS a1, stddev_pop(nation) AS s1, avg(n) AS a2, stddev_pop(n) AS s2 FROM raw),
z AS (SELECT id, [(acct - a0) / s0, (nation - a1) / s1, (n - a2) / s2] AS x FROM raw, st)"""


def vectors(spark, sf):
    n = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = read(spark, sf, "supplier").join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    raw = s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acct"), F.col("s_nationkey").cast("double").alias("nation"), F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    return O.standardise(raw, "id", SUP)


def _r(df, n=6):
    return df.withColumn("score", F.round("score", n))


@query(f"WITH {V} SELECT id, round(list_sum(list_transform(x, lambda a: a * a)), 6) AS score FROM z")
def od_sq_mean(spark, sf):
    return _r(O.squared_distance(vectors(spark, sf), "id"))


HBOS = f"""{V}, c AS (SELECT id, k, x[k + 1] AS a FROM z CROSS JOIN (SELECT unnest(range(3)) AS k)), e AS (SELECT k, min(a) AS lo, max(a) AS hi FROM c GROUP BY 1),
b AS (SELECT id, k, least(9, floor((a - lo) / ((hi - lo) / 10)))::int AS b FROM c JOIN e USING (k)), h AS (SELECT k, b, count(*) / max(count(*)) OVER (PARTITION BY k) AS h FROM b GROUP BY 1, 2),
hbos AS (SELECT id, sum(-ln(h)) AS score FROM b JOIN h USING (k, b) GROUP BY 1)"""


@query(f"WITH {HBOS} SELECT id, round(score, 6) AS score FROM hbos")
def od_hbos(spark, sf):
    return _r(O.histogram_score(vectors(spark, sf), "id"))


@query(f"WITH {NEAR} SELECT id, round(d, 6) AS score FROM near WHERE rank = 5")
def od_knn(spark, sf):
    return _r(O.knn_distance(_near(spark, sf), "id", 5))


LOF = f"""{NEAR}, kd AS (SELECT id, d AS kd FROM near WHERE rank = 5), lrd AS (SELECT n.id, 1 / greatest(avg(greatest(n.d, k.kd)), 1e-10) AS lrd FROM near n JOIN kd k ON n.neighbour = k.id GROUP BY 1),
lof AS (SELECT n.id, avg(o.lrd) / any_value(s.lrd) AS score FROM near n JOIN lrd o ON n.neighbour = o.id JOIN lrd s ON n.id = s.id GROUP BY 1)"""


@query(f"WITH {LOF} SELECT id, round(ln(score), 5) AS score FROM lof")
def od_lof(spark, sf):
    lof = O.local_outlier_factor(_near(spark, sf), "id", 5)  # in logarithms, as copies of a vector make it very large
    return _r(lof.withColumn("score", F.log("score")), 5)


@query(f"""WITH {NEAR}, u AS (SELECT n.id, n.rank, list_transform(range(64), lambda k: b.v[k + 1] - a.v[k + 1]) AS u FROM near n JOIN series a ON n.id = a.id JOIN series b ON n.neighbour = b.id),
  g AS (SELECT a.id, list_dot_product(a.u, b.u) / nullif(list_dot_product(a.u, a.u) * list_dot_product(b.u, b.u), 0) AS g FROM u a JOIN u b ON a.id = b.id AND a.rank < b.rank) SELECT id, round(-ln(1 + coalesce(var_pop(g), 0)), 5) AS score FROM g GROUP BY 1""")
def od_abod(spark, sf):
    from .inputs import series

    s = series(spark, sf).select("id", F.col("values").alias("x"))
    a = O.angle_variance(s, _near(spark, sf), "id")
    return _r(a.withColumn("score", -F.log(1 - F.col("score"))), 5)


DIRS = O.projections(8, 3)
LODA = f"""{V}, dirs AS (SELECT unnest(range({len(DIRS)})) AS k, unnest({DIRS}) AS d), c AS (SELECT id, k, round(list_sum(list_transform(range(3), lambda i: d[i + 1] * x[i + 1])), 9) AS a FROM z, dirs),
e AS (SELECT k, min(a) AS lo, max(a) AS hi FROM c GROUP BY 1), b AS (SELECT id, k, least(9, floor((a - lo) / ((hi - lo) / 10)))::int AS b FROM c JOIN e USING (k)),
h AS (SELECT k, b, count(*) / sum(count(*)) OVER (PARTITION BY k) AS h FROM b GROUP BY 1, 2), loda AS (SELECT id, avg(-ln(h)) AS score FROM b JOIN h USING (k, b) GROUP BY 1)"""


@query(f"WITH {LODA} SELECT id, round(score, 6) AS score FROM loda")
def od_loda(spark, sf):
    return _r(O.loda(vectors(spark, sf), "id", DIRS))


SCORES = f"""{HBOS}, dirs AS (SELECT unnest(range({len(DIRS)})) AS k, unnest({DIRS}) AS d), lc AS (SELECT id, k, round(list_sum(list_transform(range(3), lambda i: d[i + 1] * x[i + 1])), 9) AS a FROM z, dirs),
le AS (SELECT k, min(a) AS lo, max(a) AS hi FROM lc GROUP BY 1), lb AS (SELECT id, k, least(9, floor((a - lo) / ((hi - lo) / 10)))::int AS b FROM lc JOIN le USING (k)),
lh AS (SELECT k, b, count(*) / sum(count(*)) OVER (PARTITION BY k) AS h FROM lb GROUP BY 1, 2), loda AS (SELECT id, avg(-ln(h)) AS score FROM lb JOIN lh USING (k, b) GROUP BY 1),
scores AS (SELECT id, 'hbos' AS method, round(score, 6) AS score FROM hbos UNION ALL SELECT id, 'loda', round(score, 6) FROM loda UNION ALL SELECT id, 'sq', round(list_sum(list_transform(x, lambda a: a * a)), 6) FROM z),
flags AS (SELECT id, s.method, score, (score > c.c)::int AS flag FROM scores s JOIN (SELECT method, quantile_cont(score, 0.9) AS c FROM scores GROUP BY 1) c USING (method)),
votes AS (SELECT id, sum(flag)::bigint AS votes, (sum(flag) >= 2)::int AS is_outlier FROM flags GROUP BY 1)"""


def _flags(spark, sf):
    return O.flags(O.gather({"hbos": od_hbos(spark, sf), "loda": od_loda(spark, sf), "sq": od_sq_mean(spark, sf)}, "id"), 90.0)


@query(f"WITH {SCORES} SELECT id, method, score, flag FROM flags")
def od_flags(spark, sf):
    return _flags(spark, sf)


@query(f"WITH {SCORES} SELECT id, votes, is_outlier FROM votes")
def od_vote(spark, sf):
    return O.vote(_flags(spark, sf), "id", 2)


@query(f"WITH {SCORES} SELECT method, sum(flag)::bigint AS n FROM flags GROUP BY 1")
def od_flag_counts(spark, sf):
    return O.flag_counts(_flags(spark, sf))


@query(f"""WITH {SCORES}, w AS (SELECT id, max(flag) FILTER (method = 'hbos') AS hbos, max(flag) FILTER (method = 'loda') AS loda, max(flag) FILTER (method = 'sq') AS sq FROM flags GROUP BY 1)
  SELECT 'hbos' AS a, 'loda' AS b, round(CASE WHEN stddev_pop(hbos) * stddev_pop(loda) > 0 THEN corr(hbos, loda) END, 6) AS r FROM w UNION ALL SELECT 'hbos', 'sq', round(CASE WHEN stddev_pop(hbos) * stddev_pop(sq) > 0 THEN corr(hbos, sq) END, 6) FROM w UNION ALL SELECT 'loda', 'sq', round(CASE WHEN stddev_pop(loda) * stddev_pop(sq) > 0 THEN corr(loda, sq) END, 6) FROM w""")
def od_flag_corr(spark, sf):
    return O.flag_correlation(_flags(spark, sf), "id", ["hbos", "loda", "sq"]).withColumn("r", F.round("r", 6))


@query()
def od_mahalanobis(spark, sf):
    return O.mahalanobis(vectors(spark, sf), "id", 3)


@query()
def od_depth(spark, sf):
    return O.depth(vectors(spark, sf), "id", 3)


@query()
def od_cblof(spark, sf):
    return O.cblof(vectors(spark, sf), "id", 4)


@query()
def od_isolation_forest(spark, sf):
    return O.isolation_forest(vectors(spark, sf), "id", trees=20)


@query()
def pca_2d(spark, sf):
    return O.pca(vectors(spark, sf), "id", 3, 2)


@query(f"WITH {TAB}, m AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in HOLES) + " FROM tab) SELECT id, " + ", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in HOLES) + " FROM tab, m")
def median_fill(spark, sf):
    return I.fill(orders_table(spark, sf), HOLES).select("id", *[F.round(c, 6).alias(c) for c in HOLES])


@query(f"WITH {TAB}, m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in HOLES) + " FROM tab) SELECT id, " + ", ".join(f"round(coalesce({c}, m_{c}), 5) AS {c}" for c in HOLES) + " FROM tab, m")
def mean_fill(spark, sf):
    return I.fill(orders_table(spark, sf), HOLES, "mean").select("id", *[F.round(c, 5).alias(c) for c in HOLES])


@query(f"WITH {TAB} SELECT id, " + ", ".join(f"({c} IS NULL)::int AS {c}_missing" for c in HOLES) + " FROM tab")
def missing_indicators(spark, sf):
    return I.indicators(orders_table(spark, sf), HOLES).select("id", *[f"{c}_missing" for c in HOLES])


@query()
def knn_fill(spark, sf):
    return I.knn_fill(orders_table(spark, sf), "id", COLUMNS, 5)


@query()
def chained_ridge(spark, sf):
    return I.chained_linear(orders_table(spark, sf), COLUMNS, "ridge", 1.0, rounds=2)


@query()
def chained_lasso(spark, sf):
    return I.chained_linear(orders_table(spark, sf), COLUMNS, "lasso", 0.01, rounds=2)


@query()
def chained_bayesian(spark, sf):
    return I.chained_linear(orders_table(spark, sf), COLUMNS, "bayesian", rounds=1)


@query()
def chained_forest(spark, sf):
    return I.chained_trees(orders_table(spark, sf), COLUMNS, rounds=1, trees=3)


RECON = f"""{TAB}, cells AS (SELECT id, target, col AS "column", val AS actual, pred FROM (SELECT id, target, 'price' AS col, price AS val, n_lines * 10000 AS pred FROM tab UNION ALL SELECT id, target, 'n_lines', n_lines, price / 10000 FROM tab)),
r AS (SELECT *, rank() OVER (PARTITION BY "column" ORDER BY actual) + (count(*) OVER (PARTITION BY "column", actual) - 1) / 2 AS ra, rank() OVER (PARTITION BY "column" ORDER BY pred) + (count(*) OVER (PARTITION BY "column", pred) - 1) / 2 AS rp FROM cells),
m AS (SELECT "column", corr(ra, rp) AS spearman, var_pop(pred) / var_pop(actual) AS variance_ratio, sqrt(avg((actual - pred) ^ 2)) / (max(actual) - min(actual)) AS nrmse FROM r GROUP BY 1),
a AS (SELECT "column", actual, row_number() OVER (PARTITION BY "column" ORDER BY actual) AS k FROM cells), p AS (SELECT "column", pred, row_number() OVER (PARTITION BY "column" ORDER BY pred) AS k FROM cells),
w AS (SELECT "column", avg(abs(actual - pred)) AS wasserstein FROM a JOIN p USING ("column", k) GROUP BY 1)"""


def _recon(spark, sf):
    t = orders_table(spark, sf)
    return I.reconstruction(t.select(F.lit("price").alias("column"), F.col("price").alias("actual"), (F.col("n_lines") * 10000).alias("pred")).unionByName(
        t.select(F.lit("n_lines").alias("column"), F.col("n_lines").alias("actual"), (F.col("price") / 10000).alias("pred"))
    ))


@query(f'WITH {RECON} SELECT "column", round(spearman, 6) AS spearman, round(wasserstein, 4) AS wasserstein, round(variance_ratio, 6) AS variance_ratio, round(nrmse, 6) AS nrmse FROM m JOIN w USING ("column")')
def reconstruction_scores(spark, sf):
    return _recon(spark, sf).select("column", F.round("spearman", 6).alias("spearman"), F.round("wasserstein", 4).alias("wasserstein"), F.round("variance_ratio", 6).alias("variance_ratio"), F.round("nrmse", 6).alias("nrmse"))


@query()
def imputer_search(spark, sf):
    t = orders_table(spark, sf)
    mask = prep.cell_mask(t, "id", HOLES)
    hidden = I.hide(t, mask, "id", COLUMNS)
    rows = None
    for name, f in {"mean": lambda d: I.fill(d, HOLES, "mean"), "median": lambda d: I.fill(d, HOLES), "ridge": lambda d: I.chained_linear(d, COLUMNS, "ridge", 1.0, 1)}.items():
        pred = prep.melt(f(hidden), "id", HOLES).withColumnRenamed("value", "pred")
        cells = mask.withColumnRenamed("value", "actual").join(pred, ["id", "column"])
        one = I.overall(I.reconstruction(cells)).withColumn("candidate", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return I.choose(rows)
