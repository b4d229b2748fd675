"""Queries over the flat table: audits, splits, filters, statistics, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep, stats
from ..sources import tables as io
from .inputs import COLUMNS, TAB, orders_table, read
from .registry import query

RANGES = {"qty": (5.0, 300.0), "price": (0.0, None), "disc": (0.0, 0.08)}
PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]
UNPIVOT = "cells AS (SELECT id, col AS \"column\", val AS value FROM (" + " UNION ALL ".join(f"SELECT id, '{c}' AS col, {c} AS val FROM tab" for c in COLUMNS) + ") WHERE val IS NOT NULL)"


@query(f"""WITH {TAB} SELECT id, CASE WHEN qty >= 5 AND qty <= 300 THEN qty END AS qty, CASE WHEN price >= 0 THEN price END AS price,
  CASE WHEN disc >= 0 AND disc <= 0.08 THEN disc END AS disc FROM tab""")
def audit_ranges(spark, sf):
    return prep.audit_ranges(orders_table(spark, sf), RANGES).select("id", "qty", "price", "disc")


@query("SELECT o_orderkey, o_custkey FROM orders")
def numeric_projection(spark, sf):
    return prep.numeric_columns(read(spark, sf, "orders"), drop=("o_totalprice", "not_there"))


@query(f"WITH {TAB} SELECT id, n_lines, qty, price, disc, tax, nullif(target, 4)::int AS target FROM tab WHERE nullif(target, 4) IS NOT NULL")
def labelled_rows(spark, sf):
    t = orders_table(spark, sf).withColumn("target", F.nullif("target", F.lit(4)))
    return prep.labelled(t, "target")


@query(f"""WITH {TAB} SELECT id, target, CASE target WHEN 0 THEN 'none' WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' ELSE 'severe' END AS name,
  (target > 0)::int AS positive, CASE WHEN n_lines * 10 <= 30 THEN 0 WHEN n_lines * 10 < 50 THEN 1 WHEN n_lines * 10 < 80 THEN 2 ELSE 3 END AS severity FROM tab""")
def label_maps(spark, sf):
    names = F.create_map(*[x for i, n in enumerate(("none", "mild", "moderate")) for x in (F.lit(i), F.lit(n))])
    s = F.col("n_lines") * 10
    return orders_table(spark, sf).select(
        "id", "target", F.coalesce(F.try_element_at(names, "target"), F.lit("severe")).alias("name"), (F.col("target") > 0).cast("int").alias("positive"),
        F.when(s <= 30, 0).when(s < 50, 1).when(s < 80, 2).otherwise(3).alias("severity"),
    )


SPLIT = f"""{TAB}, split AS (SELECT id, target, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY md5('42:' || id::varchar), id)
  <= round(0.2 * count(*) OVER (PARTITION BY target)) THEN 'Test' ELSE 'Train' END AS "Split" FROM tab)"""


@query(f'WITH {SPLIT} SELECT id, target, "Split" FROM split')
def stratified_split(spark, sf):
    return prep.stratified_split(orders_table(spark, sf).select("id", "target"), "id", "target")


@query(f"""WITH {SPLIT} SELECT "Split", target, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY "Split"), 6) AS share FROM split GROUP BY 1, 2""")
def split_description(spark, sf):
    return prep.describe_split(stratified_split(spark, sf), "target").withColumn("share", F.round("share", 6))


@query(f"""WITH {TAB} SELECT fold, target, count(*) AS n FROM (SELECT target, ((row_number() OVER (PARTITION BY target ORDER BY md5('42:' || id::varchar), id) - 1) % 5)::int AS fold
  FROM tab) GROUP BY 1, 2""")
def kfold_balance(spark, sf):
    return prep.stratified_folds(orders_table(spark, sf).select("id", "target"), "id", "target").groupBy("fold", "target").agg(F.count("*").alias("n"))


@query("""WITH lab AS (SELECT user_id, mode(kind ORDER BY kind) AS label FROM (SELECT user_id, (user_id % 3 = 0)::int AS kind FROM events) GROUP BY 1),
  tag AS (SELECT user_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || user_id::varchar), user_id) <= round(0.2 * count(*) OVER (PARTITION BY label))
    THEN 'Test' ELSE 'Train' END AS "Split" FROM lab)
  SELECT "Split", count(*) AS n_rows, count(DISTINCT user_id) AS n_subjects FROM events JOIN tag USING (user_id) GROUP BY 1""")
def subject_split(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id", (F.col("user_id") % 3 == 0).cast("int").alias("kind"))
    return prep.subject_split(e, "user_id", "kind").groupBy("Split").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_subjects"))


@query(f"""WITH {TAB}, {UNPIVOT}, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY md5('42:' || "column" || ':' || id::varchar), id) AS rn,
  count(*) OVER (PARTITION BY "column") AS n FROM cells) SELECT id, "column", value FROM r WHERE rn <= floor(n * 0.1)""")
def mask_cells(spark, sf):
    return prep.cell_mask(orders_table(spark, sf), "id", COLUMNS)


@query(f"""WITH {TAB}, {UNPIVOT}, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY id) - 1 AS rn, count(*) OVER (PARTITION BY "column") AS n FROM cells)
  SELECT a.id, a."column", b.value FROM r a JOIN r b ON a."column" = b."column" AND ('0x' || substr(md5('42:' || a."column" || ':' || a.id::varchar), 1, 8))::bigint % a.n = b.rn""")
def column_bootstrap(spark, sf):
    return prep.column_bootstrap(orders_table(spark, sf), "id", COLUMNS)


@query(f"WITH {TAB} SELECT id, target FROM tab ORDER BY md5('42:' || id::varchar), id LIMIT 50")
def background_sample(spark, sf):
    from ..operators.explain import background

    return background(orders_table(spark, sf).select("id", "target"), "id")


@query(f"WITH {TAB} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(({c} IS NULL)::int), 6) AS missing FROM tab" for c in COLUMNS))
def missing_fraction(spark, sf):
    return stats.missing_fraction(orders_table(spark, sf), COLUMNS).withColumn("missing", F.round("missing", 6))


@query(f"WITH {TAB}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", sum(({c} IS NULL)::int)::bigint AS n FROM tab" for c in COLUMNS)
       + ") SELECT \"column\", n, (sum(n) OVER ())::bigint AS total FROM m ORDER BY n DESC, 1 LIMIT 30")
def top_missing_columns(spark, sf):
    from pyspark.sql import Window

    t = orders_table(spark, sf)
    n = t.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in COLUMNS]).unpivot([], COLUMNS, "column", "n")
    return n.withColumn("total", F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "column").limit(30)


@query(f"""WITH {TAB}, n AS (SELECT target, count(*) AS n FROM tab GROUP BY 1) SELECT target, n, round(n / sum(n) OVER (), 6) AS share,
  round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight, n = max(n) OVER () AS is_majority FROM n""")
def class_weights(spark, sf):
    return stats.class_shares(orders_table(spark, sf), "target").withColumns({c: F.round(c, 6) for c in ("share", "weight")})


@query(f"WITH {TAB} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM tab" for a, b in PAIRS))
def pearson_matrix(spark, sf):
    return stats.pearson(orders_table(spark, sf), COLUMNS).withColumn("r", F.round("r", 6))


SPEARMAN = f"{TAB}, long AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM tab WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS
) + """), rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM long),
  rho AS (SELECT a, b, corr(rx, ry) AS rho FROM rk GROUP BY 1, 2)"""


@query(f"WITH {SPEARMAN} SELECT a, b, round(rho, 6) AS rho FROM rho")
def spearman_pairs(spark, sf):
    return stats.spearman(orders_table(spark, sf), COLUMNS).withColumn("rho", F.round("rho", 6))


@query(f'WITH {SPEARMAN} SELECT DISTINCT b AS "column" FROM rho WHERE abs(rho) > 0.5')
def spearman_drop(spark, sf):
    return prep.redundant_columns(orders_table(spark, sf), COLUMNS, 0.5)


@query(f"""WITH {SPLIT}, u AS (SELECT id, target, "Split", CASE WHEN "Split" = 'Train' THEN (id % 7 = 0)::int ELSE 0 END AS is_outlier FROM split)
  SELECT "Split", is_outlier, count(*) AS n FROM u GROUP BY 1, 2""")
def tagged_union(spark, sf):
    s = stratified_split(spark, sf)
    train = s.where("Split = 'Train'").drop("Split").withColumn("is_outlier", (F.col("id") % 7 == 0).cast("int"))
    return prep.tag_and_union(train, s.where("Split = 'Test'").drop("Split")).groupBy("Split", "is_outlier").agg(F.count("*").alias("n"))


@query(f"""WITH {SPLIT} SELECT bool_and("Split" IN ('Train', 'Test')) AS tags_ok, bool_and(target IS NOT NULL) AS labels_complete, bool_and(coalesce(target BETWEEN 0 AND 3, true)) AS labels_in_range,
  count(*) FILTER ("Split" = 'Train') AS n_train, count(*) FILTER ("Split" = 'Test') AS n_test FROM split""")
def validate_split(spark, sf):
    return prep.validate_split(stratified_split(spark, sf), "target")


TRIAL = """SELECT o_orderpriority AS study, o_orderkey::int AS number, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS value, CASE o_orderstatus WHEN 'F' THEN 'FAIL' ELSE 'COMPLETE' END AS state, (o_custkey % 9)::varchar AS depth FROM orders"""


@query(f"""WITH t AS ({TRIAL}) SELECT study, number, value::double AS value, depth FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value DESC, number) AS r
  FROM t WHERE state = 'COMPLETE' AND value IS NOT NULL) WHERE r = 1""")
def best_trial(spark, sf):
    """Orders as a log of trials: failed ones and those without a value can't win."""
    o = read(spark, sf, "orders")
    t = o.select(
        F.col("o_orderpriority").alias("study"), F.col("o_orderkey").cast("int").alias("number"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice").cast("double")).alias("value"),
        F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("COMPLETE").alias("state"), F.create_map(F.lit("depth"), (F.col("o_custkey") % 9).cast("string")).alias("params"),
    )
    return io.best_trial(t).select("study", "number", "value", F.col("params")["depth"].alias("depth"))


@query("SELECT width AS bin, o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus, least(10, floor(o_totalprice / 60000.0)::int + 1)::int AS width FROM orders WHERE o_totalprice BETWEEN 0 AND 600000) GROUP BY 1, 2")
def price_histogram(spark, sf):
    return stats.histogram(read(spark, sf, "orders"), "o_totalprice", 0.0, 600000.0, 10, "o_orderstatus").select("bin", "o_orderstatus", "n")


@query("""SELECT o_orderpriority, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS median,
  round(quantile_cont(o_totalprice, 0.75), 6) AS q3, max(o_totalprice) AS high, count(o_totalprice) AS n FROM orders GROUP BY 1""")
def box_summary(spark, sf):
    return stats.box_summary(read(spark, sf, "orders"), "o_totalprice", "o_orderpriority").withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_keys(spark, sf):
    return read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").dropDuplicates()


@query(f"""WITH {TAB}, n AS (SELECT target, count(*) AS n, sum((price < 0)::bigint)::bigint AS n_flagged FROM tab GROUP BY 1)
  SELECT target, n_flagged, round(n_flagged / n, 6) AS share_of_class, round(n_flagged / sum(n) OVER (), 6) AS share_of_all FROM n""")
def outlier_summary(spark, sf):
    t = orders_table(spark, sf).withColumn("flag", (F.col("price") < 0).cast("int"))
    return stats.group_outcome(t, "flag", "target").withColumns({c: F.round(c, 6) for c in ("share_of_class", "share_of_all")})
