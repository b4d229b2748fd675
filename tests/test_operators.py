"""Hand-computed values, invariants and edge cases of the mining operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.functions import arrays as A
from lodeframe.operators import chain, explain, extract, impute, intervals, kernels, metrics, models, outliers, patterns, prep, ranks, series, stats
from lodeframe.sources import tables


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_cut_points(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (2.5,), (9.0,)], "p double")
    assert [r[0] for r in df.select(metrics.apply_cuts(F.col("p"), [0.5, 1.5, 2.5])).collect()] == [0, 1, 2, 3]


def test_audit(spark):
    df = spark.createDataFrame([(4.9,), (5.0,), (22.0,), (22.1,), (None,)], "`a-b` double")
    assert [r[0] for r in prep.audit_ranges(df, {"a-b": (5, 22)}).collect()] == [None, 5, 22, None, None]


def test_best_split(spark):
    df = spark.createDataFrame([(0, 1.0, 0), (0, 2.0, 0), (0, 3.0, 1), (0, 4.0, 1), (1, 1.0, 0), (1, 1.0, 1), (1, 1.0, 0)], "shapelet int, d double, label int")
    got = {r[0]: (r[1], r[2]) for r in kernels.best_split(df, "shapelet").collect()}
    assert got[0][0] == pytest.approx(1.0, abs=1e-9) and got[0][1] == 2.5 and got[1] == (0.0, 0.0)


def test_bound_is_no_less_than_any_gain(spark):
    rng = np.random.default_rng(1)
    rows = [(0, float(d), int(y)) for d, y in zip(rng.normal(size=40), rng.integers(0, 2, 40), strict=True)]
    seen, unseen = rows[:25], rows[25:]
    s = "shapelet int, d double, label int"
    bound = kernels.entropy_bound(spark.createDataFrame(seen, s), "shapelet", sum(y == 0 for _, _, y in unseen), sum(y for _, _, y in unseen)).first()["bound"]
    assert bound >= kernels.best_split(spark.createDataFrame(rows, s), "shapelet").first()["gain"] - 1e-9


def test_kernels_of_arrays(spark):
    a = arr(1, 3, 5, 7)
    r = one(spark, A.paa(a, 2), A.paa(a, 3), A.slope(arr(0, 2, 4)), F.sqrt(A.variance(arr(1, 3))), A.crossings(arr(0, 2, 0, 2)), A.above_mean(arr(0, 0, 0, 4)), A.histogram_quantile(arr(5, 5), 0.5))
    assert tuple(r) == ([2.0, 6.0], None, 2.0, 1.0, 1.0, 0.25, 5.0)
    w = one(spark, A.windows(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("double")), 3, 4), A.windows(arr(1, 2), 3))
    assert w[0] == [[0, 4, 8], [1, 5, 9]] and w[1] == []


def test_partitions_and_counts():
    assert [p[2:] for p in intervals.partitions(10, 3) if p[0] == 2] == [(0, 3), (3, 6), (6, 8), (8, 10)]
    assert len(intervals.grid(200)) == 15 and intervals.feature_count()["total"] == 6648


def test_fisher(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 2.0), (1, 4.0), (1, 6.0)], "label int, value double").withColumn("f", F.lit(1))
    assert intervals.fisher(df, "label", "f").first()["fisher"] == pytest.approx(16 / (2 * 2 + 2 * 2))


def test_patterns(spark):
    seqs = spark.createDataFrame([(0, "LLH"), (1, "LLM")], "id int, seq string")
    f = patterns.frequent(seqs, 0.5)
    assert {r["pattern"] for r in patterns.maximal(f).collect()} == {"LLH", "LLM"}
    n = {r["pattern"]: r["n"] for r in f.collect()}
    assert all(n[p] <= n[p[1:]] and n[p] <= n[p[:-1]] for p in n if len(p) > 1)
    assert patterns.gap_pattern("LH", 2) == "L.{0,1}H"
    g = {r["pattern"] for r in patterns.frequent_gapped(spark.createDataFrame([(0, "LMH")], "id int, seq string"), 0.1, 2).collect()}
    assert "LH" in g and patterns.frequent(seqs.limit(0), 0.5).count() == 0


def test_kappa(spark):
    q = lambda rows: metrics.weighted_kappa(spark.createDataFrame(rows, "t int, p int"), "t", "p", [0, 1, 2, 3]).first()[0]
    assert q([(0, 0), (1, 1), (3, 3)]) == 1.0 and q([(0, 3), (3, 0)]) == -1.0


def test_weights_and_percentiles(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 4.0)], "y int, x double")
    assert {r["y"]: round(r["weight"], 4) for r in stats.class_shares(df, "y").collect()} == {0: 0.6667, 1: 2.0}
    assert stats.box_summary(df, "x").first()["median"] == 2.5
    assert outliers.flags(df.select(F.lit("m").alias("method"), F.col("x").alias("score")), 100.0).agg(F.sum("flag")).first()[0] == 0


def test_interpolation_and_spikes(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "k int, t int, x double")
    assert [r["filled"] for r in series.interpolate(df, "k", "t", "x").orderBy("t").collect()] == [1, 1, 2, 3, 3]
    flat = spark.createDataFrame([(0, i, 100.0 if i == 5 else float(i)) for i in range(11)], "k int, t int, x double")
    assert [r["t"] for r in series.removed_values(series.remove_spikes(flat, "k", "t", "x"), "x").collect()] == [5]
    empty = df.limit(0)
    assert series.interpolate(empty, "k", "t", "x").count() == 0


def test_redundant_is_not_greedy(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    b = a + 0.25 * rng.normal(size=300)
    c = b + 0.25 * rng.normal(size=300) + 0.12 * rng.normal(size=300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, strict=True)], "a double, b double, c double")
    assert {r[0] for r in prep.redundant_columns(df, ["a", "b", "c"], 0.9).collect()} >= {"b", "c"}


def test_reconstruction(spark):
    df = spark.createDataFrame([("c", 0.0, 1.0), ("c", 10.0, 9.0), ("k", 1.0, 1.0), ("k", 1.0, 2.0)], "column string, actual double, pred double")
    r = {x["column"]: x for x in impute.reconstruction(df).collect()}
    assert r["c"]["nrmse"] == pytest.approx(0.1) and r["k"]["spearman"] == 0 and r["k"]["variance_ratio"] == 1 and r["k"]["nrmse"] == 0
    w = spark.createDataFrame([("c", 0.0, 1.0), ("c", 1.0, 2.0)], "column string, actual double, pred double")
    assert impute.reconstruction(w).first()["wasserstein"] == 1.0


def test_discords(spark):
    p = spark.createDataFrame([(0, i, float(d), 0) for i, d in enumerate([1, 9, 8, 2, 7])], "id long, pos int, dist double, nn int")
    assert [(r["pos"], r["dist"]) for r in kernels.discords(p, "id", 4, 2).orderBy("rank").collect()] == [(1, 9.0), (4, 7.0)]


def test_dtw():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.normal(size=20), rng.normal(size=20)
        d = kernels.dtw(a, b, 3)
        assert d == pytest.approx(kernels.dtw(b, a, 3)) and d <= np.sqrt(((a - b) ** 2).sum()) + 1e-9 and kernels.dtw(a, a, 3) == 0


def test_envelope_bounds_dtw(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    a, b = df.select(F.col("id").alias("i"), F.col("v").alias("x")), df.select(F.col("id").alias("j"), F.col("v").alias("y"))
    for r in a.join(b, F.col("i") < F.col("j")).select("x", "y", kernels.envelope_bound(F.col("x"), F.col("y"), 2).alias("lb")).collect():
        assert r["lb"] <= kernels.dtw(np.array(r["x"]), np.array(r["y"]), 2) + 1e-9


def test_stl_adds_up():
    y = np.sin(np.arange(60) * 2 * np.pi / 7) + np.arange(60) / 20
    t, s, r = series.stl(y, 7)
    assert np.allclose(t + s + r, y) and np.abs(r).mean() < 0.2


def test_burg():
    rng = np.random.default_rng(4)
    x = np.zeros(2000)
    for i in range(2, 2000):
        x[i] = 0.6 * x[i - 1] - 0.3 * x[i - 2] + rng.normal()
    a = intervals.burg(x, 2)
    assert a == pytest.approx([0.6, -0.3], abs=0.06)


def test_kernel_shap_adds_up(spark):
    bg = spark.createDataFrame([([0.0, 0.0, 0.0],), ([1.0, 1.0, 1.0],)], "x array<double>")
    predict = lambda df: df.withColumn("pred", 2 * F.col("x")[0] - F.col("x")[1])
    phi = {r["feature"]: r["phi"] for r in explain.kernel_shap(predict, [3.0, 1.0, 5.0], bg, ["a", "b", "c"]).collect()}
    assert phi["a"] == pytest.approx(5.0) and phi["b"] == pytest.approx(-0.5) and phi["c"] == pytest.approx(0.0, abs=1e-9)


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 3).cast("int").alias("y"))
    runs = [sorted(map(tuple, prep.stratified_split(df.repartition(n), "id", "y").collect())) for n in (1, 7, 32)]
    assert runs[0] == runs[1] == runs[2] and sum(r[2] == "Test" for r in runs[0]) == 60


def test_linear_fills_restore_a_line(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), None if i % 4 == 0 else float(3 * x + 1)) for i, x in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    for kind, alpha in (("ridge", 1e-6), ("lasso", 1e-6), ("bayesian", 0.0)):
        got = impute.chained_linear(df, ["a", "b"], kind, alpha, 1).collect()
        assert all(r["b"] == pytest.approx(3 * r["a"] + 1, abs=1e-2) for r in got)
    with pytest.raises(ValueError):
        impute.chained_logistic(df, "b", ["a"], 1)


def test_isolation_finds_the_far_point(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2).tolist()) for i in range(200)] + [(200, [9.0, 9.0])]
    v = spark.createDataFrame(rows, "id long, x array<double>")
    for f in (lambda: outliers.isolation_forest(v, "id", trees=30), lambda: outliers.mahalanobis(v, "id", 2), lambda: outliers.squared_distance(v, "id"), lambda: outliers.depth(v, "id", 2)):
        assert f().orderBy(F.desc("score")).first()["id"] == 200


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', float("nan"), 0), (2, None, 1.5, 1)], "id long, t string, x double, y int")
    tables.write_csv(df, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), "id long, t string, x double, y int").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 'a "b", c', None, 0), (2, None, 1.5, 1)]
    both = prep.tag_and_union(df.limit(1).withColumn("is_outlier", F.lit(1)), df.where("id = 2"))
    tables.write_split(both, str(tmp_path / "split"))
    h = tables.read_split(spark, str(tmp_path / "split"), "id", "y", ("is_outlier",))
    assert h.x_test.columns == ["id", "t", "x"] and h.y_train.count() == 1
    with pytest.raises(tables.MissingInput, match="two.*three"):
        tables.read_all(spark, {"one": str(tmp_path / "split"), "two": str(tmp_path / "no"), "three": str(tmp_path / "none")})
    tables.append_trials(spark, str(tmp_path / "log"), "s", models.search(df, {"a": (0.0, 1.0)}, 3, lambda p: 1 / 0 if p["a"] > 0.9 else p["a"]))
    assert tables.best_trial(spark.read.schema(tables.TRIAL_SCHEMA).parquet(str(tmp_path / "log"))).count() == 1
    assert tables.typed({"a": "3.0", "b": "x", "c": "[1]"}, frozenset({"a"})) == {"a": 3, "b": "x", "c": [1]}
    assert tables.reshape_params({"n_units_l1": "8", "n_units_l0": "16", "pca_n_components": "4", "lr": 0.1}) == ({"lr": 0.1, "hidden": [16, 8]}, 4)


def test_stream_equals_table(spark, tmp_path, sf_dir):
    from lodeframe.streaming.grid import half_hours, start

    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    ev.repartition(1).write.parquet(str(tmp_path / "in"))
    q = start(half_hours(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), "ts", "value", "event_type"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("bucket", "event_type", "n").collect()}
    want = {tuple(r) for r in half_hours(ev, "ts", "value", "event_type").select("bucket", "event_type", "n").collect()}
    assert got <= want and len(got) > 0.9 * len(want)


def test_lore_rule_cuts_at_the_median_of_the_table(spark, sf_dir, monkeypatch):
    from lodeframe.plans import models as M

    held = {}
    monkeypatch.setattr(M.X, "local_rule", lambda spark, predict, *a: held.update(f=predict) or {"rule": "", "counterfactual": "", "fidelity": 1.0})
    M.lore_rule(spark, sf_dir)
    _, d = M._scorer(spark, sf_dir)
    n, above = held["f"](d).selectExpr("count(*)", "sum(pred)").first()
    assert abs(above - n / 2) <= 1


def test_knn_fill_searches_all_rows(spark):
    import numpy as np

    from lodeframe.operators import impute

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(2600, 3)), 2)
    gaps = rng.random((2600, 3)) < 0.1
    own = [(i, *(None if m else float(v) for v, m in zip(r, g, strict=True))) for i, (r, g) in enumerate(zip(x, gaps, strict=True))]
    got = {r["id"]: r for r in impute.knn_fill(spark.createDataFrame(own, "id long, a double, b double, c double"), "id", ["a", "b", "c"], 3, block=700).collect()}
    assert len(got) == len(own)
    for i in range(0, 2600, 5):
        both = ~gaps[i] & ~gaps
        n = both.sum(axis=1)
        d = np.where(n > 0, np.where(both, (x - x[i]) ** 2, 0).sum(axis=1) * 3 / np.maximum(n, 1), np.inf)
        for j, c in enumerate("abc"):
            want = x[i, j]
            if gaps[i, j]:
                near = [r for r in np.lexsort((np.arange(2600), d)) if not gaps[r, j] and np.isfinite(d[r])][:3]
                want = x[near, j].mean() if near else x[~gaps[:, j], j].mean()
            assert abs(got[i][c] - want) < 1e-9


def test_hashed_ranks_and_running_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None, "a", "b"][i % 3], float(rng.integers(0, 40)) if i % 7 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    from lodeframe.functions.hashing import draw

    got = {r["id"]: (r["_r"], r["_n"]) for r in ranks.hashed(df, draw(1, "id"), "id", "g").collect()}
    import hashlib

    for g in (None, "a", "b"):
        own = sorted((hashlib.md5(f"1:{i}".encode()).hexdigest(), i) for i, h, _ in rows if h == g)
        assert all(got[i] == (k + 1, len(own)) for k, (_, i) in enumerate(own))
    counts = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("c"))
    for r in ranks.running(counts, "v", ["c"], "g").collect():
        own = [v for _, g, v in rows if g == r["g"] and v is not None]
        above = [v for v in own if v > r["v"]]
        assert r["before_c"] == sum(v < r["v"] for v in own) and r["all_c"] == len(own) and r["next"] == (min(above) if above else None)
    assert ranks.running(counts.limit(0), "v", ["c"], "g").count() == 0


@pytest.mark.parametrize("accuracy", [100_000, 50])
def test_quantiles_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)  # groups of that many rows go by brackets
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=1501), "b": rng.integers(0, 5, 977).astype(float), "c": np.array([3.5])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.99, 1.0]
    got = {r["g"]: r["q"] for r in ranks.quantile_row(df, {"q": "v"}, shares, "g").collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        assert got[g] == pytest.approx([float(np.quantile(vs, s)) for s in shares], abs=1e-12)
    assert ranks.quantile_row(df.limit(0), {"q": "v"}, [0.5]).first()["q"] == [None]


def test_wasserstein_is_the_mean_gap_of_sorted_values(spark):
    rng = np.random.default_rng(5)
    a, p = rng.integers(0, 9, 60).astype(float), rng.normal(4, 3, 60)
    df = spark.createDataFrame([("x", float(i), float(j)) for i, j in zip(a, p, strict=True)], "column string, actual double, pred double")
    assert impute.reconstruction(df).first()["wasserstein"] == pytest.approx(np.abs(np.sort(a) - np.sort(p)).mean())


def test_searched_cuts_travel(spark):
    rng = np.random.default_rng(6)
    truth = rng.integers(0, 4, 400)
    df = spark.createDataFrame([(int(t), float(2.4 + 0.5 * t + rng.normal(0, 0.05))) for t in truth], "t int, s double")
    cuts, best = metrics.search_cuts(df, "t", "s")
    assert cuts == sorted(cuts) and cuts[2] > 3.05 and best > metrics.search_cuts(df, "t", "s", passes=1)[1]


def test_warping_of_many_pairs(spark):
    rng = np.random.default_rng(7)

    def plain(a, b, r):
        n, m = len(a), len(b)
        r = max(r, abs(n - m))
        c = np.full((n + 1, m + 1), np.inf)
        c[0, 0] = 0
        for i in range(n):
            for j in range(max(0, i - r), min(m, i + r + 1)):
                c[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(c[i, j], c[i, j + 1], c[i + 1, j])
        return np.sqrt(c[n, m])

    x, y = rng.normal(size=(6, 12)), rng.normal(size=(5, 10))
    got = kernels.warp(x[:, None], y[None], 3)
    assert got == pytest.approx(np.array([[plain(a, b, 3) for b in y] for a in x]))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(40, 8)))], "id long, values array<double>")
    rows = {r["id"]: np.array(r["values"]) for r in df.collect()}
    near = kernels.nearest(df, df, "id", "values", 3, block=8, measure=lambda a, b: kernels.warp(a, b, 2)).collect()
    for i, v in rows.items():
        want = sorted((round(plain(v, w, 2), 9), j) for j, w in rows.items() if j != i)[:3]
        assert [(round(r["d"], 9), r["neighbour"]) for r in sorted((r for r in near if r["id"] == i), key=lambda r: r["rank"])] == want


def test_profile_blocks_agree_with_all_pairs(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=50), np.ones(14)])
    df = spark.createDataFrame([(1, v.tolist()), (2, v[:10].tolist())], "id long, values array<double>")
    m, zone = 6, 3
    w = np.lib.stride_tricks.sliding_window_view(v, m)
    z = lambda a: (a - a.mean()) / a.std()
    for block in (1024, 7):
        for r in kernels.matrix_profile(df, "id", "values", m, zone, block).collect():
            d = {}
            for j in range(len(w)):
                if abs(j - r["pos"]) > zone:
                    a, b = w[r["pos"]], w[j]
                    flat = (a.std() < 1e-12, b.std() < 1e-12)
                    d[j] = 0.0 if all(flat) else np.sqrt(m) if any(flat) else np.linalg.norm(z(a) - z(b))
            assert r["id"] == 1 and r["dist"] == pytest.approx(min(d.values()), abs=1e-6) and d[r["nn"]] == pytest.approx(min(d.values()), abs=1e-6)


def test_extracted_features_are_those_of_the_parts(spark):
    rng = np.random.default_rng(9)
    n = 40
    df = spark.createDataFrame([(i, r.tolist(), int(i % 2)) for i, r in enumerate(rng.normal(size=(30, n)) + np.arange(30)[:, None] % 2)], "id long, values array<double>, label int")
    every = extract.catalogue(n)
    some = [f for f in every if f.representation in ("original", "derivative") and f.length == 7 and f.dilation == 2 and f.level >= 0]
    got = {r["id"]: r["x"] for r in extract.extract(df, "id", "values", some, n).collect()}
    for kind in ("original", "derivative"):
        base = df if kind == "original" else df.withColumn("values", intervals.derivative(F.col("values")))
        stats_of = intervals.window_stats(base, "id", "values", 7, 2, extract.STATS)
        size = n - 12 if kind == "original" else n - 13
        want = {(r["id"], r["stat"], r["pool"], r["level"], r["part"]): r["value"] for r in intervals.pooled(stats_of, "id", "s", size, 3, extract.POOLS, "stat").collect()}
        for i, x in got.items():
            for f, value in zip(some, x, strict=True):
                if f.representation == kind:
                    assert value == pytest.approx(want[i, f.statistic, f.pool, f.level, f.part], abs=1e-9), f
    sizes = intervals.feature_count(200)
    whole = extract.catalogue(200)
    assert (sum(f.level == 0 for f in whole), sum(f.level > 0 for f in whole), sum(f.level < 0 for f in whole)) == (sizes["global"], sizes["local"], sizes["raw"])
    chosen = extract.choose(df, "id", "values", "label", n)
    assert sum(f.level != 0 for f in chosen) == int(0.4 * sum(f.level != 0 for f in every))
    both = extract.fuse([extract.extract(df, "id", "values", some[:3], n), extract.extract(df, "id", "values", some[3:5], n)], "id")
    assert both.first()["x"] == got[both.first()["id"]][:5]
    assert extract.feature_names([some[:1], some[:1]]) == ["ch0_original_mean_mean", "ch1_original_mean_mean"]
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (None, [0.5] * n)], "id long, values array<double>")
    assert {r["id"]: r["x"] is None for r in extract.extract(odd, "id", "values", some, n).collect()} == {1: True, 2: True, None: False}


def test_chain_learns_from_the_training_table_alone(spark):
    train = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0), (4, 8.0, None)], "id long, a double, b double")
    test = spark.createDataFrame([(9, None, 7.0), (8, 4.0, None)], "id long, a double, b double")
    c = chain.fit(train, ["a", "b"])
    sd = float(np.std([1, 3, 8]))
    got = {r["id"]: r["x"] for r in c.apply(test, "id").collect()}
    assert got[9] == pytest.approx([(3 - 4) / sd, 0.0]) and got[8] == pytest.approx([0.0, 0.0])
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0, 0.1]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    axes = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :2]
    got = np.array([r["x"] for r in chain.fit(df, ["a", "b", "c"], "mean", 2).apply(df, "id").orderBy("id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(z @ axes), abs=1e-6)


def test_gapped_maximal_patterns(spark):
    seqs = spark.createDataFrame([("LMHL",), ("LHHL",), ("LMML",)], "seq string")
    found = patterns.frequent_gapped(seqs, 0.6, 2)
    names = {r["pattern"] for r in found.collect()}
    import re

    kept: list = []
    for p in sorted(names, key=lambda p: (-len(p), p)):
        if not any(len(q) > len(p) and re.search(".{0,1}".join(p), q) for q in kept):
            kept.append(p)
    assert {r["pattern"] for r in patterns.maximal_gapped(found, 2).collect()} == set(kept) and max(map(len, names)) >= 2


def test_multipliers_and_multi_class(spark):
    rng = np.random.default_rng(12)
    y = rng.choice(3, 600, p=[0.8, 0.15, 0.05])
    x = np.eye(3)[y] * 1.2 + rng.normal(0, 0.6, (600, 3))
    df = spark.createDataFrame([(i, r.tolist(), int(c), i % 3) for i, (r, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int, fold int")
    p = models.out_of_fold(df, models.probabilities("lr_clf", "y", "id", 3), "id", 3)
    assert all(abs(sum(r["pred"]) - 1) < 1e-9 for r in p.collect())
    both = p.join(df, "id").persist()
    m = models.class_multipliers(both, "y", "pred", 3)
    f1 = lambda k: metrics.summary(both.withColumn("g", models.multiplied(F.col("pred"), k)), "y", "g").first()["macro_f1"]
    assert all(0.1 <= v <= 10 for v in m) and f1(m) >= f1([1.0] * 3) - 0.02
    svc = models.probabilities("svc_clf", "y", "id", 3)(df)(df).first()["pred"]
    assert len(svc) == 3 and sum(svc) == pytest.approx(1.0)
    stacked, weights, _ = models.stack_classes(df, {"a": models.probabilities("lr_clf", "y", "id", 3), "b": models.probabilities("rf_clf", "y", "id", 3, numTrees="3", pca_n_components="2")}, "id", "y", 3, 3)
    score = metrics.summary(stacked.join(df, "id"), "y", "guess").first()
    assert weights.count() == 6 and score["accuracy"] > 0.8


def test_network_learns_a_bend(spark):
    x = np.linspace(-2, 2, 200)
    df = spark.createDataFrame([(i, [float(v)], float(abs(v))) for i, v in enumerate(x)], "id long, x array<double>, y double")
    p = models.perceptron_regressor(df, "y", 8, 120)(df)
    assert p.agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0] < 0.15


@pytest.mark.parametrize("how", ["none", "smote", "adasyn", "enn", "tomek", "smote_enn", "smote_tomek"])
def test_resampling(spark, how):
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(0, 1, 2).tolist(), 0) for i in range(60)] + [(100 + i, rng.normal(1.5, 1, 2).tolist(), 1) for i in range(15)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    n = {r["label"]: r["count"] for r in models.resampled(df, "id", "y", how).groupBy("label").count().collect()}
    if how == "none":
        assert n == {0: 60, 1: 15}
    elif how == "smote":
        assert n == {0: 60, 1: 60}
    elif how == "adasyn":
        assert n[0] == 60 and 50 <= n[1] <= 70
    else:
        assert n[0] <= 60 and n[1] <= 60 and (n[0] < 60 or n[1] not in (15, 60))


def test_jitter_is_small_and_normal(spark):
    df = spark.createDataFrame([(i, [0.0] * 50) for i in range(60)], "id long, values array<double>")
    v = np.array([r["values"] for r in prep.jitter(df, "id", "values", 1e-6).collect()]).ravel() / 1e-6
    assert abs(v.mean()) < 0.06 and abs(v.std() - 1) < 0.05 and len(set(v)) > 2900
