"""Cases of FINDINGS_r02.md that failed before."""

from __future__ import annotations

import numpy as np

from lodeframe.operators import kernels


def test_profile_distances_are_rounded_once():
    """F8: rounding to nine places and then to six takes 2.92549949967 to 2.9255; ties at six places go to the first window."""
    rng = np.random.default_rng(0)
    v, m, zone = rng.normal(size=400), 12, 6
    w = np.lib.stride_tricks.sliding_window_view(v, m)
    z = (w - w.mean(axis=1, keepdims=True)) / w.std(axis=1, keepdims=True)
    for places in (2, 6):
        d, at = kernels.profile_rows(v, 0, len(w), m, zone, places)
        for i in range(0, len(w), 3):
            own = np.round(np.sqrt(((z - z[i]) ** 2).sum(axis=1)), places)
            own[np.abs(np.arange(len(w)) - i) <= zone] = np.inf
            assert (d[i], at[i]) == (own.min(), own.argmin())


def _rows(spark, rng, n):
    """Series with copies, a null one, a shorter one and one that holds a null; clusters of uneven size."""
    v = [r.tolist() for r in rng.normal(size=(n, 4))]
    v[3], v[5], v[7] = list(v[2]), list(v[2]), list(v[4])
    v[8], v[9], v[10] = None, v[9][:3], [1.0, None, 2.0, 3.0]
    return spark.createDataFrame([(i, x, [1, 1, 0, 2][i % 4]) for i, x in enumerate(v)], "id long, v array<double>, c int")


def test_totals_of_pairs_without_pairs_as_rows(spark):
    """blocks add up to what all pairs as rows do, however they are cut."""
    df = _rows(spark, np.random.default_rng(1), 60)
    want = kernels.pair_distances(df, "id", "v").selectExpr("count(*)", "count(d)", "sum(d)").first()
    for block in (8192, 7):
        got = kernels.pair_totals(df, "id", "v", block).first()
        assert tuple(got)[:2] == tuple(want)[:2] and abs(got[2] - want[2]) < 1e-9
    assert tuple(kernels.pair_totals(df.limit(0), "id", "v").first()) == (0, 0, None)


def test_silhouette_without_pairs_as_rows(spark):
    """likewise; series without a distance don't count."""
    df = _rows(spark, np.random.default_rng(2), 60)
    pairs = kernels.pair_distances(df, "id", "v").where("d IS NOT NULL")
    want = kernels.silhouette(pairs, df.selectExpr("id", "c AS cluster"), "id").first()[0]
    for block in (8192, 7):
        assert abs(kernels.series_silhouette(df, "id", "v", "c", block).first()[0] - want) < 1e-9


def test_linkage_of_series_is_that_of_their_pairs(spark):
    """no limit on the series, as no matrix is held; sums kept or taken anew, copies and more clusters than distinct rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3)) + rng.integers(0, 4, size=(120, 1))
    x[50:60] = x[40]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    pairs = kernels.pair_distances(df, "id", "v").persist()
    for k in (1, 2, 5, 30, 108):
        want = [r[1] for r in sorted(kernels.average_linkage(pairs, k).collect())]
        for room in (2e8, 8e3, 1.0):
            assert kernels.linkage_labels(x, k, room).tolist() == want
    assert len(set(kernels.linkage_labels(x, 115).tolist())) == 115
    assert [r[1] for r in sorted(kernels.series_linkage(df, "id", "v", 5).collect())] == [r[1] for r in sorted(kernels.average_linkage(pairs, 5).collect())]
    many = np.round(rng.normal(size=(4100, 2)), 3)
    assert len(set(kernels.linkage_labels(many, 7).tolist())) == 7


def test_links_by_warping(spark):
    """blocks find every pair that all pairs one by one give; links and components follow from them."""
    rng = np.random.default_rng(4)
    v = {i: r.tolist() for i, r in enumerate(rng.normal(size=(70, 6)))}
    v[5], v[6], v[9] = v[4], v[4], v[8][:5]
    df = spark.createDataFrame([*v.items(), (70, None)], "id long, v array<double>")
    for most in (0.0, 1.2, 1.8):
        want = {(i, j): d for i in v for j in v if i < j and (d := kernels.dtw(v[i], v[j], 1)) <= most}
        root = {i: i for i in range(71)}
        for _ in v:
            for i, j in want:
                root[i] = root[j] = min(root[i], root[j])
        for block in (4096, 9):
            assert {(r["i"], r["j"]): r["d"] for r in kernels.dtw_pairs(df, "id", "v", 1, most, block).collect()} == want
            got = {r["id"]: (r["n_links"], r["component_id"]) for r in kernels.dtw_links(df, "id", "v", 1, most, block).collect()}
            assert got == {i: (sum(i in p for p in want), root[i]) for i in range(71)}


def test_known_chunks_are_hashed_once():
    """op6_packing's CPU seconds: a chunk met before is looked up, not first gathered in a set."""
    from lodeframe.llm.tokens import Encoder

    class Chunk(str):
        seen = 0

        def __hash__(self):
            Chunk.seen += 1
            return str.__hash__(self)

    enc = Encoder.__new__(Encoder)
    enc.code = {"a": 0, "b": 1}
    assert enc._codes([Chunk("a"), Chunk("b"), Chunk("a")]).tolist() == [0, 1, 0] and Chunk.seen == 3


def test_nearest_donors_meet_a_stretch_of_rows():
    """what is left out along the axis is never nearer; ties, copies and gaps in the axis included."""
    import pandas as pd

    from lodeframe.operators import impute

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 3)) * [50, 3, 1], 1)
    x[700:] = x[:200]
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = pd.DataFrame({"p": np.arange(900), "x": list(x)})
    cells = [(i, j) for i, j in zip(*np.nonzero(np.isnan(x)), strict=True)]
    got = impute._nearest_donors(pd.DataFrame({"q": [i for i, _ in cells], "j": [j for _, j in cells], "z": [x[i] for i, _ in cells]}), rows, ["a", "b", "c"], 0, 4)
    found = {c: g["p"].tolist() for c, g in got.groupby(["q", "j"])}
    for i, j in cells[::3]:
        both = ~np.isnan(x) & ~np.isnan(x[i])
        n = both.sum(axis=1)
        d = np.where((n > 0) & ~np.isnan(x[:, j]), np.where(both, (x - x[i]) ** 2, 0).sum(axis=1) * 3 / np.maximum(n, 1), np.inf)
        assert found.get((i, j), []) == [r for r in np.lexsort((np.arange(900), d)) if np.isfinite(d[r])][:4]


def test_neighbours_by_product_are_those_by_difference(spark):
    """a product of matrices finds the same neighbours and distances, also where it cancels or overflows; ties, copies, gaps and short blocks."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(150, 6)), 1)
    x[120:] = x[:30]
    x[7] += 1e6
    x[8] = x[7] + 1e-4
    x[11, 2], x[12, 0], x[13, 1], x[14, 1] = np.nan, np.inf, 1e200, 1e200
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    with np.errstate(invalid="ignore", over="ignore"):
        d = kernels.euclid(x[:, None], x[None])
    for k, block in ((3, 16), (160, 64), (1, None)):
        got = {}
        for r in kernels.nearest(df, df, "id", "v", k, block).orderBy("rank").collect():
            got.setdefault(r["id"], []).append((r["d"], r["neighbour"]))
        for i in range(len(x)):
            assert got.get(i, []) == sorted((d[i, j], j) for j in range(len(x)) if j != i and np.isfinite(d[i, j]))[:k]


def test_resampling_searches_once(spark):
    """rows are not searched for again by what reads them, and ways that share neighbours give what each gives alone."""
    from lodeframe.operators import models

    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 1, 2).tolist(), 0) for i in range(50)] + [(100 + i, rng.normal(1.5, 1, 2).tolist(), 1) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    read = lambda t: sorted((r["label"], r["x"]) for r in t.collect())
    hows = ("smote", "enn", "smote_tomek")
    alone = {how: models.resampled(df, "id", "y", how) for how in hows}
    for t in alone.values():
        assert "MapIn" not in t._jdf.queryExecution().optimizedPlan().toString()
    together, held = models.resamplings(df, "id", "y", hows)
    assert {how: read(t) for how, t in together.items()} == {how: read(t) for how, t in alone.items()}
    assert len(held) == 5  # rows, neighbours in the small class, made rows, neighbours in both tables


def test_warping_votes_of_every_hundredth_series(spark, sf_dir):
    """queries are the rows whose id is divisible by 100, against all others."""
    from lodeframe.plans import queries
    from lodeframe.plans.inputs import series

    rows = sorted((r["id"], r["values"], r["label"]) for r in series(spark, sf_dir).collect())
    ids, x, y = (np.array(c) for c in zip(*rows, strict=True))
    got = {r["id"]: r["p1"] for r in queries()["knn_dtw"](spark, sf_dir).collect()}
    assert sorted(got) == [i for i in ids.tolist() if i % 100 == 0]
    for i, p in got.items():
        d = np.array([kernels.dtw(x[ids == i][0], v, 6) for v in x])
        d[ids == i] = np.inf
        near = np.lexsort((ids, d))[:5]
        assert abs(p - np.average(y[near], weights=1 / d[near])) < 1e-6


def test_warping_by_antidiagonals():
    """the same distances as cell by cell, for unequal lengths, narrow bands, empty series and any cut into chunks."""
    rng = np.random.default_rng(8)
    for n, m, radius in ((7, 7, 0), (7, 7, 2), (9, 6, 1), (4, 11, 9), (1, 1, 0), (0, 0, 1), (0, 3, 1)):
        a, b = rng.normal(size=(5, n)), rng.normal(size=(4, m))
        want = np.empty((5, 4))
        for i in range(5):
            for j in range(4):
                c, r = np.full((n + 1, m + 1), np.inf), max(radius, abs(n - m))
                c[0, 0] = 0.0
                for p in range(n):
                    for q in range(max(0, p - r), min(m, p + r + 1)):
                        c[p + 1, q + 1] = (a[i, p] - b[j, q]) ** 2 + min(c[p, q], c[p, q + 1], c[p + 1, q])
                want[i, j] = np.sqrt(c[n, m])
        for pairs in (1, 8, 4096):
            assert np.array_equal(kernels.warp(a[:, None], b[None], radius, pairs), want)


def test_linkage_warps_whole_series(spark, sf_dir):
    """whole series by banded warping, no segment means and no other distance; blocks are warped in tasks."""
    rng = np.random.default_rng(8)
    v = {i: r.tolist() for i, r in enumerate(np.round(rng.normal(size=(90, 12)).cumsum(axis=1), 3))}
    v[30] = v[31] = v[4]
    v[40] = v[40][:10]
    df = spark.createDataFrame([*v.items(), (90, None), (91, [1.0, None]), (92, []), (93, [1.0, float("nan")])], "id long, v array<double>")
    pairs = spark.createDataFrame([(i, j, kernels.dtw(v[i], v[j], 2)) for i in v for j in v if i < j], "i long, j long, d double")
    for k in (1, 7, 40):
        want = sorted(tuple(r) for r in kernels.average_linkage(pairs, k).collect())
        assert sorted(tuple(r) for r in kernels.warped_linkage(df, "id", "v", k, 2, 1).collect()) == want
    assert len({r[1] for r in kernels.warped_linkage(df, "id", "v", 89, 2).collect()}) == 89
    from lodeframe.plans.inputs import series
    from lodeframe.plans.kernels import agglomerative

    s = {r["id"]: r["values"] for r in series(spark, sf_dir).collect()}
    x = np.array(list(s.values()))
    d = kernels.warp(x[:, None], x[None], 4)
    ids = list(s)
    pairs = spark.createDataFrame([(ids[i], ids[j], float(d[i, j])) for i in range(len(ids)) for j in range(len(ids)) if ids[i] < ids[j]], "i long, j long, d double")
    assert sorted(tuple(r) for r in agglomerative(spark, sf_dir).collect()) == sorted(tuple(r) for r in kernels.average_linkage(pairs, 7).collect())


def test_cells_are_filled_in_their_range(spark, monkeypatch):
    """an ask meets few rows along the axis, and only cells whose k-th distance leaves their range meet others; ties go by key."""
    from lodeframe.operators import impute

    rng = np.random.default_rng(9)
    x = np.round(np.c_[rng.normal(size=4000) * 50, rng.normal(size=(4000, 2))], 1)
    x[2000:3000] = x[:1000]  # copies, so distances of 0 tie
    x[3500:] += [400, 0, 0]
    gaps = rng.random(x.shape) < [0.0, 0.3, 0.3]
    y, p = np.where(gaps, np.nan, x), rng.permutation(4000)

    def want(i: int, j: int) -> np.ndarray:
        both = ~gaps[i] & ~gaps
        d = (np.where(both, (x - x[i]) ** 2, 0.0) * [1, 1, 1]).sum(axis=1) * 3 / both.sum(axis=1)
        d[gaps[:, j]] = np.inf
        return np.lexsort((p, d))[:5]

    met, cut = [], np.partition
    monkeypatch.setattr(np, "partition", lambda d, *a, **k: met.append(d.size) or cut(d, *a, **k))
    for j in (1, 2):
        mine = np.flatnonzero(gaps[:, j])
        met.clear()
        r, c, d, _ = impute._nearest_donors(y[mine], y, p, j, 0, 5)
        assert sum(met) < 400 * len(mine)
        assert (np.diff(d)[np.diff(r) == 0] >= 0).all() and (np.bincount(r) == 5).all()
        for n in range(0, len(mine), 7):
            assert c[r == n].tolist() == want(mine[n], j).tolist()
    monkeypatch.undo()
    rows = [(int(k), *(None if np.isnan(v) else float(v) for v in row)) for k, row in zip(p, y, strict=True)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    for block in (10000, 300):  # one range, and fourteen
        got = {r["id"]: r for r in impute.knn_fill(df, "id", ["a", "b", "c"], 5, block).collect()}
        for i in range(0, 4000, 9):
            assert all(abs(got[p[i]]["abc"[j]] - (x[want(i, j), j].mean() if gaps[i, j] else x[i, j])) < 1e-9 for j in range(3))
