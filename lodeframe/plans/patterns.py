"""Queries over symbol sequences: discretising, frequent, maximal and contrasting patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as P
from ..operators import stats
from .inputs import SERIES, series
from .registry import query

SHARE = 0.2
SEQ = f"""{SERIES}, means AS (SELECT id, label, list_transform(range(8), lambda k: list_aggregate(v[k * 8 + 1 : k * 8 + 8], 'avg')) AS m FROM series),
cuts AS (SELECT quantile_cont(x, 100.0 / 3 / 100) AS q0, quantile_cont(x, 200.0 / 3 / 100) AS q1 FROM (SELECT unnest(m) AS x FROM means)),
seqs AS (SELECT id, label, list_aggregate(list_transform(m, lambda x: CASE WHEN x < q0 THEN 'L' WHEN x < q1 THEN 'M' ELSE 'H' END), 'string_agg', '') AS seq FROM means, cuts)"""
SUBS = """subs AS (SELECT DISTINCT id, label, substr(seq, i, n) AS pattern FROM seqs CROSS JOIN (SELECT unnest(range(1, 9)) AS i) CROSS JOIN (SELECT unnest(range(1, 9)) AS n) WHERE i + n <= 9)"""
FREQ = f"""{SEQ}, {SUBS}, freq AS (SELECT pattern, length(pattern)::int AS length, count(*) AS n, count(*) / (SELECT count(*) FROM seqs) AS support FROM subs GROUP BY 1
  HAVING count(*) >= greatest(1, floor((SELECT count(*) FROM seqs) * {SHARE})))"""
FREQ_BY = f"""{SEQ}, {SUBS}, size AS (SELECT label, count(*) AS size FROM seqs GROUP BY 1), freq AS (SELECT s.label, pattern, length(pattern)::int AS length, count(*) AS n, count(*) / any_value(size) AS support
  FROM subs s JOIN size USING (label) GROUP BY 1, 2 HAVING count(*) >= greatest(1, floor(any_value(size) * {SHARE}))),
maxi AS (SELECT * FROM freq f WHERE NOT EXISTS (SELECT 1 FROM freq g WHERE g.label = f.label AND g.length > f.length AND contains(g.pattern, f.pattern)))"""


def _seqs(spark, sf):
    return P.discretise(series(spark, sf), "id", "label", "values", 8)


def _by_class(spark, sf):
    f = P.frequent(_seqs(spark, sf), SHARE, "label")
    return f, P.maximal(f, "label")


@query(f"WITH {SEQ} SELECT id, label, seq FROM seqs")
def symbols(spark, sf):
    return _seqs(spark, sf)


@query(f"""WITH {SEQ}, e AS (SELECT label, unnest(string_split(seq, '')) AS symbol FROM seqs), n AS (SELECT label, symbol, count(*) AS n, grouping(label) AS g FROM e GROUP BY GROUPING SETS ((symbol), (label, symbol)))
  SELECT label, symbol, n, round(n / sum(n) OVER (PARTITION BY g, label), 6) AS share FROM n""")
def symbol_distribution(spark, sf):
    s = _seqs(spark, sf).select("label", F.split("seq", "").alias("x"))
    return stats.symbol_histogram(s, "label", "x").withColumn("share", F.round("share", 6))


@query(f"WITH {FREQ} SELECT pattern, length, n, round(support, 6) AS support FROM freq")
def gsp_frequent(spark, sf):
    return P.frequent(_seqs(spark, sf), SHARE).withColumn("support", F.round("support", 6))


@query(f"WITH {FREQ} SELECT pattern, length, n FROM freq f WHERE NOT EXISTS (SELECT 1 FROM freq g WHERE g.length > f.length AND contains(g.pattern, f.pattern))")
def gsp_maximal(spark, sf):
    return P.maximal(P.frequent(_seqs(spark, sf), SHARE)).select("pattern", "length", "n")


@query(f"WITH {FREQ} SELECT length, count(*) AS n_patterns, min(n) AS least, max(n) AS most FROM freq GROUP BY 1")
def pattern_lengths(spark, sf):
    return P.frequent(_seqs(spark, sf), SHARE).groupBy("length").agg(F.count("*").alias("n_patterns"), F.min("n").alias("least"), F.max("n").alias("most"))


@query(f"WITH {FREQ} SELECT pattern, n, round(length * 8 * 30.0 / 60, 6) AS hours FROM freq ORDER BY n DESC, pattern LIMIT 10")
def top_patterns(spark, sf):
    return P.with_duration(P.frequent(_seqs(spark, sf), SHARE), 8).select("pattern", "n", F.round("hours", 6).alias("hours")).orderBy(F.desc("n"), "pattern").limit(10)


@query(f"""WITH {FREQ_BY} SELECT m.label, m.pattern, m.length, m.n, round(m.support, 6) AS support, NOT EXISTS (SELECT 1 FROM maxi o WHERE o.pattern = m.pattern AND o.label <> m.label) AS unique_maximal,
  NOT EXISTS (SELECT 1 FROM freq o WHERE o.pattern = m.pattern AND o.label <> m.label) AS unique_frequent FROM maxi m""")
def contrast_unique(spark, sf):
    f, m = _by_class(spark, sf)
    return P.contrast(m, f, "label").withColumn("support", F.round("support", 6))


@query(f"""WITH {FREQ_BY} SELECT a.pattern, round(a.support, 6) AS support_a, round(b.support, 6) AS support_b FROM maxi a JOIN maxi b USING (pattern) WHERE a.label = 0 AND b.label = 1
  ORDER BY a.support + b.support DESC, pattern LIMIT 5""")
def contrast_shared(spark, sf):
    s = P.shared(_by_class(spark, sf)[1], "label", 0, 1).orderBy(F.desc(F.col("support_a") + F.col("support_b")), "pattern").limit(5)
    return s.withColumns({c: F.round(c, 6) for c in ("support_a", "support_b")})


@query(f"""WITH RECURSIVE {SEQ}, abc AS (SELECT unnest(['L', 'M', 'H']) AS s), cand AS (SELECT s AS p, s AS re FROM abc UNION ALL SELECT p || s, re || '.{{0,1}}' || s FROM cand, abc WHERE length(p) < 8),
  hits AS (SELECT p AS pattern, count(*) AS n FROM cand JOIN seqs ON regexp_matches(seq, re) GROUP BY 1) SELECT pattern, length(pattern)::int AS length, n, round(n / (SELECT count(*) FROM seqs), 6) AS support FROM hits
  WHERE n >= greatest(1, floor((SELECT count(*) FROM seqs) * {SHARE}))""")
def gap2_patterns(spark, sf):
    return P.frequent_gapped(_seqs(spark, sf), SHARE, 2).withColumn("support", F.round("support", 6))


@query()
def gap2_maximal(spark, sf):
    return P.maximal_gapped(P.frequent_gapped(_seqs(spark, sf), SHARE, 2), 2).withColumn("support", F.round("support", 6))
