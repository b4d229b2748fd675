"""Metrics, cut points and thresholds over (truth, prediction) columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_wide(df: DataFrame, truth: str, pred: str, labels: list) -> DataFrame:
    """A row for each truth, a column for each of ``labels``, zeros where none fell."""
    wide = df.groupBy(F.col(truth).alias("truth")).pivot(pred, labels).count()
    return wide.select("truth", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("long").alias(f"pred_{x}") for x in labels])


def weighted_kappa(df: DataFrame, truth: str, pred: str, labels: list[int]) -> DataFrame:
    """(qwk): 1 - sum(w O) / sum(w E) with squared label distances over a fixed label set; 1 if nothing can differ."""
    n = confusion(df, truth, pred).where(F.col("truth").isin(labels) & F.col("pred").isin(labels))
    w = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    observed = n.agg(F.sum(w("truth", "pred") * F.col("n")).cast("double").alias("o"), F.sum("n").cast("double").alias("t"))
    a = n.groupBy(F.col("truth").alias("i")).agg(F.sum("n").alias("na"))
    b = n.groupBy(F.col("pred").alias("j")).agg(F.sum("n").alias("nb"))
    expected = a.crossJoin(b).agg(F.sum(w("i", "j") * F.col("na") * F.col("nb")).cast("double").alias("e"))  # labels squared
    return observed.crossJoin(expected).select(F.when(F.col("e") > 0, 1 - F.col("o") * F.col("t") / F.col("e")).otherwise(1.0).alias("qwk"))


def apply_cuts(score: Column, cuts: list[float]) -> Column:
    """The number of cut points strictly exceeded."""
    return reduce(lambda a, b: a + b, [(score > c).cast("int") for c in cuts])


def round_label(score: Column, low: int = 0, high: int = 3) -> Column:
    """Half to even, clipped."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.bround(score).cast("int")))


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support); a zero denominator gives 0."""
    n = confusion(df, truth, pred)
    t = n.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = n.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    z = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    both = t.join(p, "label", "full").na.fill(0, ["support", "tp", "predicted"])
    return both.select("label", z(F.col("tp"), F.col("predicted")).alias("precision"), z(F.col("tp"), F.col("support")).alias("recall"),
                       z(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support")


def summary(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(accuracy, macro_f1, weighted_f1)."""
    r = class_report(df, truth, pred)
    n = F.sum("support")
    return r.agg((F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"))


def binary_sweep(df: DataFrame, truth: str, prob: str, low: float = 0.10, high: float = 0.90, steps: int = 81) -> DataFrame:
    """(threshold, macro_f1) for each threshold, from one aggregation over binned scores.

    Rows are counted by the number of thresholds they reach, so the sweep itself sees a table of ``steps`` rows.
    """
    step = (high - low) / (steps - 1)
    grid = [round(low + i * step, 6) for i in range(steps)]
    reach = F.size(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: F.col(prob) >= g))
    binned = df.groupBy(reach.alias("k")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    levels = df.sparkSession.createDataFrame([(i + 1, g) for i, g in enumerate(grid)], "i int, threshold double")
    tp, fp = F.sum(F.when(F.col("k") >= F.col("i"), F.col("pos")).otherwise(0)), F.sum(F.when(F.col("k") >= F.col("i"), F.col("neg")).otherwise(0))
    c = levels.crossJoin(binned).groupBy("i", "threshold").agg(tp.alias("tp"), fp.alias("fp"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    z = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    f1 = z(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p"))
    tn, fn = F.col("n") - F.col("fp"), F.col("p") - F.col("tp")
    return c.select("threshold", ((f1 + z(2 * tn, tn + fn + F.col("n"))) / 2).alias("macro_f1"))


def best_threshold(sweep: DataFrame, default: float = 0.5) -> DataFrame:
    """(threshold, macro_f1): the first best; the default where no threshold scores above 0."""
    best = sweep.agg(F.max_by(F.struct("threshold", "macro_f1"), F.struct("macro_f1", -F.col("threshold"))).alias("b"))
    return best.select(F.when(F.col("b.macro_f1") > 0, F.col("b.threshold")).otherwise(default).alias("threshold"), F.col("b.macro_f1").alias("macro_f1"))


def roc_auc(df: DataFrame, truth: str, score: str, *by: str) -> DataFrame:
    """(by.., auc) by average ranks (Mann-Whitney); null with one class only."""
    at = df.groupBy(*by, score).agg(F.count("*").alias("c"), F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    p, n = F.sum("p"), F.sum("n")
    s = F.sum(F.col("p") * (F.col("before_c") + (F.col("c") + 1) / 2))
    return running(at, score, ["c"], *by).groupBy(*by).agg(F.when((p > 0) & (n > 0), (s - p * (p + 1) / 2) / (p * n)).alias("auc"))


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score, falling."""
    at = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    rate = lambda c: (F.col(f"all_{c}") - F.col(f"before_{c}")) / F.col(f"all_{c}")
    return running(at, "threshold", ["p", "n"]).select("threshold", rate("p").alias("tpr"), rate("n").alias("fpr"))


def log_loss(df: DataFrame, truth: str, prob: str, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.when(F.col(truth) == 1, F.col(prob)).otherwise(1 - F.col(prob))))
    return df.agg(F.avg(-F.log(p)).alias("log_loss"))


def softmax(scores: Column) -> Column:
    from ..functions.arrays import let, total

    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return let(e, lambda v: F.transform(v, lambda x: x / total(v)))


def leaderboard(scores: DataFrame, model: str, value: str) -> DataFrame:
    """Adds rank, best first, ties by name."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), model)))  # a row for each model


def search_cuts(df: DataFrame, truth: str, score: str, start=(0.5, 1.5, 2.5), reach: float = 0.5, step: float = 0.05, passes: int = 3) -> tuple[list[float], float]:
    """(cuts, qwk) by a coordinate grid search; one table of (score to 4 places, truth) counts is read back.

    Each search of a cut is centred on where the cut is, so that passes can travel. Candidates keep the cuts ascending and within the range of scores; only strict improvements are taken.
    """
    rows = df.groupBy(F.round(score, 4).alias("s"), F.col(truth).alias("t")).count().collect()
    s, t, n = (np.array([r[k] for r in rows], dtype=float) for k in range(3))
    k = int(t.max()) + 1 if len(t) else 1

    def qwk(cuts: list[float]) -> float:
        p = sum((s > c).astype(int) for c in cuts)
        o = np.zeros((max(k, len(cuts) + 1),) * 2)
        np.add.at(o, (t.astype(int), p), n)
        i = np.arange(len(o))
        w = (i[:, None] - i[None, :]) ** 2
        e = np.outer(o.sum(1), o.sum(0)) / max(1.0, o.sum())
        return 1.0 if (w * e).sum() == 0 else float(1 - (w * o).sum() / (w * e).sum())

    cuts = list(start)
    best = qwk(cuts)
    for _ in range(passes):
        for j in range(len(cuts)):
            centre = cuts[j]
            for d in np.arange(-reach, reach + step / 2, step):
                new = [*cuts]
                new[j] = float(np.clip(centre + d, s.min(), s.max())) if len(s) else centre
                if all(a < b for a, b in zip(new, new[1:], strict=False)) and (q := qwk(new)) > best:
                    cuts, best = new, q
    return cuts, best


def nelder_mead(f, start: np.ndarray, scale: float = 0.25, rounds: int = 500, tol: float = 1e-6) -> np.ndarray:
    """The simplex method of Nelder and Mead (1965)."""
    x = [np.array(start, float)] + [np.array(start, float) + scale * e for e in np.eye(len(start))]
    y = [f(p) for p in x]
    for _ in range(rounds):
        order = np.argsort(y, kind="stable")
        x, y = [x[i] for i in order], [y[i] for i in order]
        if abs(y[-1] - y[0]) < tol and np.abs(x[-1] - x[0]).max() < tol:
            break
        m = np.mean(x[:-1], axis=0)
        r = m + (m - x[-1])
        fr = f(r)
        if fr < y[0]:
            e = m + 2 * (m - x[-1])
            x[-1], y[-1] = (e, fe) if (fe := f(e)) < fr else (r, fr)
        elif fr < y[-2]:
            x[-1], y[-1] = r, fr
        else:
            c = m + 0.5 * ((r if fr < y[-1] else x[-1]) - m)
            fc = f(c)
            if fc < min(fr, y[-1]):
                x[-1], y[-1] = c, fc
            else:
                x = [x[0]] + [x[0] + 0.5 * (p - x[0]) for p in x[1:]]
                y = [y[0]] + [f(p) for p in x[1:]]
    return x[int(np.argmin(y))]
