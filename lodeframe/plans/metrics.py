"""Queries over predictions: confusion, reports, cut points, thresholds, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .inputs import PRED, predictions, read
from .registry import query

CUT = "(score > 0.5)::int + (score > 1.5)::int + (score > 2.5)::int"


def _labelled(spark, sf):
    return predictions(spark, sf).withColumn("guess", M.apply_cuts(F.col("score"), [0.5, 1.5, 2.5]))


@query(f"WITH {PRED} SELECT id, {CUT} AS guess, least(3, greatest(0, round_even(score, 0)))::int AS rounded FROM pred")
def cut_points_apply(spark, sf):
    return _labelled(spark, sf).select("id", "guess", M.round_label(F.col("score")).alias("rounded"))


@query(f"WITH {PRED} SELECT cls AS truth, " + ", ".join(f"count(*) FILTER ({CUT} = {k}) AS pred_{k}" for k in range(4)) + " FROM pred GROUP BY 1")
def confusion(spark, sf):
    return M.confusion_wide(_labelled(spark, sf), "cls", "guess", [0, 1, 2, 3])


@query(f"""WITH {PRED}, g AS (SELECT cls, {CUT} AS guess FROM pred), l AS (SELECT unnest(range(4))::int AS label), r AS (SELECT label, count(*) FILTER (cls = label AND guess = label) AS tp,
  count(*) FILTER (guess = label) AS pr, count(*) FILTER (cls = label) AS su FROM l, g GROUP BY 1) SELECT label, round(CASE WHEN pr > 0 THEN tp / pr ELSE 0 END, 6) AS precision,
  round(CASE WHEN su > 0 THEN tp / su ELSE 0 END, 6) AS recall, round(CASE WHEN pr + su > 0 THEN 2 * tp / (pr + su) ELSE 0 END, 6) AS f1, su AS support FROM r""")
def class_report(spark, sf):
    return M.class_report(_labelled(spark, sf), "cls", "guess").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {PRED}, g AS (SELECT cls, {CUT} AS guess FROM pred), l AS (SELECT unnest(range(4))::int AS label), r AS (SELECT label, count(*) FILTER (cls = label AND guess = label) AS tp,
  count(*) FILTER (guess = label) AS pr, count(*) FILTER (cls = label) AS su FROM l, g GROUP BY 1), f AS (SELECT *, CASE WHEN pr + su > 0 THEN 2 * tp / (pr + su) ELSE 0 END AS f1 FROM r)
  SELECT round(sum(tp) / sum(su), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * su) / sum(su), 6) AS weighted_f1 FROM f""")
def score_summary(spark, sf):
    s = M.summary(_labelled(spark, sf), "cls", "guess")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query(f"""WITH {PRED}, g AS (SELECT cls AS i, {CUT} AS j FROM pred), o AS (SELECT sum((i - j) ^ 2) AS o, count(*) AS t FROM g), a AS (SELECT i, count(*) AS n FROM g GROUP BY 1), b AS (SELECT j, count(*) AS n FROM g GROUP BY 1),
  e AS (SELECT sum((i - j) ^ 2 * a.n * b.n) AS e FROM a, b) SELECT round(1 - o * t / e, 6) AS qwk FROM o, e""")
def qwk(spark, sf):
    return M.weighted_kappa(_labelled(spark, sf), "cls", "guess", [0, 1, 2, 3]).withColumn("qwk", F.round("qwk", 6))


SWEEP = f"""{PRED}, grid AS (SELECT round((0.1 + 0.01 * k)::double, 6) AS threshold FROM (SELECT unnest(range(81)) AS k)), c AS (SELECT threshold, count(*) FILTER (prob >= threshold AND truth = 1) AS tp,
  count(*) FILTER (prob >= threshold AND truth = 0) AS fp, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS n FROM grid, pred GROUP BY 1),
sweep AS (SELECT threshold, (2 * tp / (tp + fp + p) + 2 * (n - fp) / ((n - fp) + (p - tp) + n)) / 2 AS macro_f1 FROM c)"""


@query(f"WITH {SWEEP} SELECT threshold, round(macro_f1, 6) AS macro_f1 FROM sweep")
def threshold_sweep(spark, sf):
    return M.binary_sweep(predictions(spark, sf), "truth", "prob").withColumn("macro_f1", F.round("macro_f1", 6))


@query(f"WITH {SWEEP} SELECT threshold, round(macro_f1, 6) AS macro_f1 FROM sweep ORDER BY round(macro_f1, 9) DESC, threshold LIMIT 1")
def best_threshold(spark, sf):
    s = M.binary_sweep(predictions(spark, sf), "truth", "prob").withColumn("macro_f1", F.round("macro_f1", 9))
    return M.best_threshold(s).withColumn("macro_f1", F.round("macro_f1", 6))


@query(f"""WITH {PRED}, k AS (SELECT c AS label, (cls = c)::int AS y, abs(score - c) AS d FROM pred CROSS JOIN (SELECT unnest(range(4))::int AS c)), r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY -round(d, 6)) +
  (count(*) OVER (PARTITION BY label, round(d, 6)) - 1) / 2 AS r FROM k) SELECT label, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r GROUP BY 1""")
def roc_auc_ovr(spark, sf):
    p = predictions(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), (F.col("cls") == c).cast("int").alias("y"), (-F.round(F.abs(F.col("score") - c), 6)).alias("s")) for c in range(4)])).alias("k"))
    return M.roc_auc(p.select("k.*"), "y", "s", "label").withColumn("auc", F.round("auc", 6))


@query(f"""WITH {PRED}, a AS (SELECT prob AS threshold, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS n FROM pred GROUP BY 1)
  SELECT threshold, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr FROM a WINDOW w AS (ORDER BY threshold DESC)""")
def roc_curve(spark, sf):
    return M.roc_curve(predictions(spark, sf), "truth", "prob").withColumns({c: F.round(c, 6) for c in ("tpr", "fpr")})


@query(f"WITH {PRED} SELECT round(avg(-ln(least(1 - 1e-15, greatest(1e-15, CASE WHEN truth = 1 THEN prob ELSE 1 - prob END)))), 6) AS log_loss FROM pred")
def log_loss(spark, sf):
    return M.log_loss(predictions(spark, sf), "truth", "prob").withColumn("log_loss", F.round("log_loss", 6))


@query(f"""WITH {PRED}, s AS (SELECT id, [score, prob, 1.0 - prob] AS s FROM pred), e AS (SELECT id, list_transform(s, lambda x: exp(x - list_aggregate(s, 'max'))) AS e FROM s)
  SELECT id, round(e[1] / list_sum(e), 6) AS a, round(e[2] / list_sum(e), 6) AS b, round(e[3] / list_sum(e), 6) AS c FROM e""")
def softmax(spark, sf):
    p = predictions(spark, sf).select("id", M.softmax(F.array("score", "prob", 1.0 - F.col("prob"))).alias("p"))
    return p.select("id", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate("abc")])


@query("SELECT o_orderpriority AS model, round(avg(o_totalprice), 4) AS value, row_number() OVER (ORDER BY round(avg(o_totalprice), 4) DESC, o_orderpriority)::int AS rank FROM orders GROUP BY 1")
def leaderboard(spark, sf):
    s = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    return M.leaderboard(s, "model", "value")


@query()
def searched_cuts(spark, sf):
    cuts, q = M.search_cuts(predictions(spark, sf), "cls", "score")
    return spark.createDataFrame([(*map(float, cuts), float(q))], "c0 double, c1 double, c2 double, qwk double")
