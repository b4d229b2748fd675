"""Queries over series: grid, spikes, interpolation, scaling, moments, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.hashing import draw
from ..operators import intervals as I
from ..operators import series as S
from .inputs import DAILY, SERIES, daily, read, series
from .registry import near, query
from .registry import near_sql as R


@query(f"WITH {DAILY} SELECT user_id, t, x FROM daily")
def grid_resample(spark, sf):
    return daily(spark, sf)


MEDIANS = f"""{DAILY}, near AS (SELECT a.user_id, a.t, a.x, list(b.x) FILTER (b.x IS NOT NULL) AS w FROM daily a JOIN daily b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 3 GROUP BY 1, 2, 3),
med AS (SELECT *, list_median(w) AS median FROM near), mad AS (SELECT *, list_median(list_transform(w, lambda v: abs(v - median))) AS mad FROM med),
spikes AS (SELECT user_id, t, x, median, mad, coalesce(abs(x - median) > 3.0 * 1.4826 * mad, false) AS spike FROM mad)""".replace(
    "list_median(", "list_aggregate(").replace("list_aggregate(w)", "list_aggregate(w, 'median')").replace("abs(v - median)))", "abs(v - median)), 'median')")


@query(f"WITH {MEDIANS} SELECT user_id, t, x, {R("median", 6)} AS median, {R("mad", 6)} AS mad, spike FROM spikes")
def spike_flags(spark, sf):
    return S.spike_flags(daily(spark, sf), "user_id", "t", "x", 7, 3.0).withColumns({"median": near("median", 6), "mad": near("mad", 6)})


@query(f"WITH {MEDIANS} SELECT user_id, t, x FROM spikes WHERE x IS NOT NULL AND spike")
def spike_audit(spark, sf):
    return S.removed_values(S.remove_spikes(daily(spark, sf), "user_id", "t", "x", 7, 3.0), "x")


FILLED = f"""{DAILY}, nb AS (SELECT *, last_value(x IGNORE NULLS) OVER p AS px, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt,
  first_value(x IGNORE NULLS) OVER n AS nx, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER n AS nt FROM daily
  WINDOW p AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT user_id, t, x, coalesce(x, px + (nx - px) * (t - pt) / (nt - pt), px, nx) AS filled, coalesce(px, nx) AS carried FROM nb)"""


@query(f"WITH {FILLED} SELECT user_id, t, x, {R("filled", 6)} AS filled, carried FROM filled")
def interpolate(spark, sf):
    f = S.interpolate(daily(spark, sf), "user_id", "t", "x").withColumn("filled", near("filled", 6))
    return S.fill_edges(f, "user_id", "t", "x")


STATS = f"{FILLED}, stats AS (SELECT avg(filled) AS mu, stddev_pop(filled) AS sigma FROM filled WHERE substr(md5('42:' || user_id::varchar), 1, 1) < 'd')"


def _stats(filled):
    train = filled.where(F.substring(draw(42, "user_id"), 1, 1) < "d")  # thirteen sixteenths of the subjects
    return S.scale_stats(train, "filled")


@query(f"WITH {STATS} SELECT round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM stats")
def zscore_train_stats(spark, sf):
    return _stats(S.interpolate(daily(spark, sf), "user_id", "t", "x")).select(F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query(f"WITH {STATS} SELECT user_id, t, round((filled - mu) / sigma, 5) AS z FROM filled, stats")
def zscore_apply(spark, sf):
    f = S.interpolate(daily(spark, sf), "user_id", "t", "x")
    return S.scale(f, _stats(f), "filled").select("user_id", "t", F.round("z", 5).alias("z"))


@query(f"WITH {FILLED} SELECT user_id, t, {R("filled - lag(filled) OVER (PARTITION BY user_id ORDER BY t)", 6)} AS diff FROM filled")
def first_diff(spark, sf):
    f = S.interpolate(daily(spark, sf), "user_id", "t", "x")
    return S.difference(f, "user_id", "t", "filled").select("user_id", "t", near("diff", 6).alias("diff"))


@query(f"""WITH {FILLED}, m AS (SELECT user_id, t, avg(filled) OVER w AS mean, stddev_pop(filled) OVER w AS sd, count(*) OVER w AS n FROM filled
  WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) SELECT user_id, t, round(mean, 5) AS mean, round(sd, 4) AS sd FROM m WHERE n = 7""")
def window_moments(spark, sf):
    f = S.interpolate(daily(spark, sf), "user_id", "t", "x")
    return S.window_moments(f, "user_id", "t", "filled", 7).select("user_id", "t", F.round("mean", 5).alias("mean"), F.round("sd", 4).alias("sd"))


@query()
def stl_parts(spark, sf):
    f = S.interpolate(daily(spark, sf), "user_id", "t", "x").select("user_id", "t", "filled")
    return S.decompose(f, "user_id", "t", "filled", 7)


@query(f"""WITH {SERIES} SELECT id, p.k AS segment, {R("list_aggregate(v[p.k * 8 + 1 : p.k * 8 + 8], 'avg')", 6)} AS mean FROM series CROSS JOIN (SELECT unnest(range(8))::int AS k) p""")
def paa(spark, sf):
    return series(spark, sf).select("id", F.posexplode(A.paa(F.col("values"), 8)).alias("segment", "m")).select("id", "segment", near("m", 6).alias("mean"))


@query(f"""WITH {SERIES}, two AS (SELECT id, label, v[1:32] AS a, v[33:64] AS b FROM series) SELECT id, label, k AS pos, CASE WHEN k % 2 = 0 THEN a[k // 2 + 1] ELSE b[k // 2 + 1] END AS interleaved,
  CASE WHEN k < 32 THEN a[k + 1] ELSE b[k - 31] END AS end_to_end FROM two CROSS JOIN (SELECT unnest(range(64))::int AS k)""")
def channel_layouts(spark, sf):
    from ..sources.tables import interleaved, model_view

    s = series(spark, sf)
    both = s.select("id", "label", F.lit(0).alias("channel"), F.slice("values", 1, 32).alias("values")).unionByName(s.select("id", "label", F.lit(1).alias("channel"), F.slice("values", 33, 32).alias("values")))
    a = interleaved(both, "id").select("id", "label", F.posexplode("values").alias("pos", "interleaved"))
    b = model_view(both, "id", [0, 1]).select("id", F.posexplode("values").alias("pos", "end_to_end"))
    return a.join(b, ["id", "pos"]).select("id", "label", "pos", "interleaved", "end_to_end")


@query(f"""WITH {SERIES}, f AS (SELECT id, k, sum(v[t + 1] * cos(2 * pi() * k * t / 64)) AS re, sum(v[t + 1] * sin(2 * pi() * k * t / 64)) AS im
  FROM series CROSS JOIN (SELECT unnest(range(32))::int AS k) CROSS JOIN (SELECT unnest(range(64))::int AS t) GROUP BY 1, 2) SELECT id, k, {R("sqrt(re * re + im * im)", 5)} AS magnitude FROM f""")
def periodogram(spark, sf):
    return I.periodogram(series(spark, sf), "values", "p").select("id", F.posexplode("p").alias("k", "m")).select("id", "k", near("m", 5).alias("magnitude"))


@query(f"WITH {SERIES} SELECT id, k AS pos, round(v[k + 2] - v[k + 1], 6) AS d FROM series CROSS JOIN (SELECT unnest(range(63))::int AS k)")
def series_derivative(spark, sf):
    return series(spark, sf).select("id", F.posexplode(I.derivative(F.col("values"))).alias("pos", "d")).select("id", "pos", F.round("d", 6).alias("d"))


@query()
def autoregressive(spark, sf):
    return I.autoregressive(series(spark, sf), "values", "coef").select("id", "coef")


@query("""WITH c(n, len) AS (SELECT n, len FROM (VALUES (200), (100), (199), (14)) a(n) CROSS JOIN (VALUES (7), (9), (11)) b(len)) SELECT n::int AS n, len::int AS length, (2 ^ e)::int AS dilation
  FROM c CROSS JOIN (SELECT unnest(range(5)) AS e) WHERE len <= n AND e <= floor(log2((n - 1) // (len - 1)))""")
def dilation_grid(spark, sf):
    return spark.createDataFrame([(n, a, d) for n in (200, 100, 199, 14) for a, d in I.grid(n)], "n int, length int, dilation int")


@query(f"""WITH {SERIES}, n AS (SELECT max(len(v)) AS n FROM series), reps AS (SELECT unnest([n, n // 2, n - 1, (12 * (n / 100) ^ 0.25)::decimal(9, 4)::int - ((12 * (n / 100) ^ 0.25) < (12 * (n / 100) ^ 0.25)::int)::int]) AS m FROM n),
  g AS (SELECT m, l, e, m - (l - 1) * (2 ^ e)::int AS segs FROM reps, (SELECT unnest([7, 9, 11]) AS l), (SELECT unnest(range(5)) AS e) WHERE l <= m AND e <= floor(log2((m - 1) // (l - 1)))),
  p AS (SELECT sum(CASE WHEN segs // k > 1 THEN k WHEN segs // k = 1 THEN segs % k ELSE 0 END) AS parts FROM (SELECT segs, (2 ^ lv)::int AS k FROM g, (SELECT unnest([1, 2]) AS lv) WHERE lv <= floor(log2(segs)))),
  c AS (SELECT (SELECT count(*) FROM g) * 42 AS global, (SELECT parts FROM p) * 42 AS local, (SELECT sum(m) FROM reps) AS raw)
  SELECT global::bigint AS global, local::bigint AS local, raw::bigint AS raw, floor(0.4 * (local + raw))::bigint AS selected, (global + floor(0.4 * (local + raw)))::bigint AS total FROM c""")
def feature_count(spark, sf):
    """The extractor's columns for the table's series: global, local, raw points, selected of these two, and used in all."""
    from ..operators.extract import catalogue

    n = series(spark, sf).agg(F.max(F.size("values"))).first()[0]
    level = [f.level for f in catalogue(n)]
    every, local, raw = sum(x == 0 for x in level), sum(x > 0 for x in level), sum(x < 0 for x in level)
    kept = int(0.4 * (local + raw))
    return spark.createDataFrame([(every, local, raw, kept, every + kept)], "global long, local long, raw long, selected long, total long")


WINDOWS = f"""{SERIES}, win AS (SELECT id, label, i, list_transform(range(7), lambda k: v[i + k * 4 + 1]) AS w FROM series CROSS JOIN (SELECT unnest(range(40))::int AS i)),
loc AS (SELECT id, label, i, list_aggregate(w, 'avg') AS mean, sqrt(list_aggregate(w, 'var_pop')) AS std, list_aggregate(w, 'min') AS lo, list_aggregate(w, 'max') AS hi,
  (7 * list_sum(list_transform(range(7), lambda k: k * w[k + 1])) - 21 * list_sum(w)) / (7 * 91 - 441) AS slope FROM win)"""


@query(f"WITH {WINDOWS} SELECT id, i, {R("mean", 6)} AS mean, {R("std", 6)} AS std, {R("slope", 6)} AS slope, lo AS min, hi AS max FROM loc")
def local_stats(spark, sf):
    w = I.window_stats(series(spark, sf), "id", "values", 7, 4, ("mean", "std", "slope", "min", "max"))
    each = w.select("id", "stat", F.posexplode("s").alias("i", "x"))
    p = each.groupBy("id", "i").pivot("stat", ["mean", "std", "slope", "min", "max"]).agg(F.first("x"))
    return p.select("id", "i", *[near(c, 6).alias(c) for c in ("mean", "std", "slope")], "min", "max")


@query(f"""WITH {SERIES}, b AS (SELECT id, v, list_aggregate(v, 'min') AS lo, list_aggregate(v, 'max') AS hi FROM series),
  k AS (SELECT id, lo, (hi - lo) / 64 AS width, list_sort(list_transform(v, lambda x: least(63, floor((x - lo) / ((hi - lo) / 64))::int))) AS bins FROM b)
  SELECT id, {R("lo + (bins[32] + 0.5) * width", 6)} AS median, {R("(bins[48] - bins[16]) * width", 6)} AS iqr FROM k""")
def hist_quantiles(spark, sf):
    v = F.col("values")
    return series(spark, sf).select("id", near(A.histogram_quantile(v, 0.5), 6).alias("median"), near(A.histogram_quantile(v, 0.75) - A.histogram_quantile(v, 0.25), 6).alias("iqr"))


POOLED = f"""{WINDOWS}, part AS (SELECT id, label, level, part, list(mean ORDER BY i) AS s FROM loc JOIN (VALUES (0, 0, 0, 40), (1, 0, 0, 20), (1, 1, 20, 40), (2, 0, 0, 10), (2, 1, 10, 20), (2, 2, 20, 30), (2, 3, 30, 40)) p(level, part, a, b)
  ON i >= a AND i < b GROUP BY 1, 2, 3, 4),
pooled AS (SELECT id, label, level, part, 'mean' AS pool, list_aggregate(s, 'avg') AS value FROM part UNION ALL SELECT id, label, level, part, 'min', list_aggregate(s, 'min') FROM part
  UNION ALL SELECT id, label, level, part, 'max', list_aggregate(s, 'max') FROM part
  UNION ALL SELECT id, label, level, part, 'above', len(list_filter(s, lambda x: x > list_aggregate(s, 'avg'))) / len(s) FROM part)"""


def _pooled(spark, sf):
    w = I.window_stats(series(spark, sf), "id", "values", 7, 4, ("mean",))
    return I.pooled(w, "id", "s", 40, 3, ("mean", "min", "max", "above")).join(series(spark, sf).select("id", "label"), "id")


@query(f"WITH {POOLED} SELECT id, level, part, pool, round(value, 6) AS value FROM pooled WHERE pool <> 'above'")
def pooling(spark, sf):
    return _pooled(spark, sf).where("pool <> 'above'").select("id", "level", "part", "pool", F.round("value", 6).alias("value"))


FISHER = f"""{POOLED}, c AS (SELECT level, part, pool, label, avg(value) AS m, count(*) AS n, coalesce(stddev_samp(value), 1e-5) AS s FROM pooled WHERE pool <> 'above' GROUP BY 1, 2, 3, 4),
d AS (SELECT *, sum(m * n) OVER w / sum(n) OVER w AS mu FROM c WINDOW w AS (PARTITION BY level, part, pool)),
fs AS (SELECT level, part, pool, sum(n * (m - mu) ^ 2) / sum(n * greatest(s, 1e-4) ^ 2) AS fisher FROM d GROUP BY 1, 2, 3)"""


def _fisher(spark, sf):
    return I.fisher(_pooled(spark, sf).where("pool <> 'above'"), "label", "level", "part", "pool")


@query(f"WITH {FISHER} SELECT level, part, pool, round(fisher, 6) AS fisher FROM fs")
def fisher_scores(spark, sf):
    return _fisher(spark, sf).withColumn("fisher", F.round("fisher", 6))


@query(f"WITH {FISHER}, r AS (SELECT *, row_number() OVER (ORDER BY fisher DESC, level, part, pool) AS rank, count(*) OVER () AS n FROM fs) SELECT level, part, pool, rank::int AS rank FROM r WHERE rank <= floor(n * 0.4)")
def topk_features(spark, sf):
    return I.select_top(_fisher(spark, sf), 0.4, "level", "part", "pool").drop("fisher")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS x FROM events GROUP BY 1, 2")
def half_hour_means(spark, sf):
    from ..streaming.grid import half_hours

    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return half_hours(e, "ts", "value", "event_type").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", F.round("x", 6).alias("x"))
