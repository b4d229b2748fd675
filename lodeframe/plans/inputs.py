"""Stand-ins for the mining inputs over the driver's tables, each in DataFrame form and as a SQL common table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["n_lines", "qty", "price", "disc", "tax"]
HOLES = ["qty", "disc", "tax"]  # columns that get missing cells


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(c):
    """Four places; means of a few decimals that lie on a half go up whatever the order of their sum."""
    return F.floor(c * 10000 + 0.501) / 10000.0


def orders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order: five features, a label 0..4 from its priority, hashed gaps and implausible prices."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").cast("double").alias("n_lines"), _places(F.sum("l_quantity")).alias("qty"), _places(F.avg("l_extendedprice")).alias("price"),
        _places(F.avg("l_discount")).alias("disc"), _places(F.avg("l_tax")).alias("tax"),
    )
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("target"))
    df = lines.join(orders, "id")
    hole = lambda c: F.substring(F.md5(F.concat(F.lit(f"miss:{c}:"), F.col("id").cast("string"))), 1, 1) < "5"
    bad = F.substring(F.md5(F.concat(F.lit("bad:price:"), F.col("id").cast("string"))), 1, 2) == "ff"
    df = df.withColumn("price", F.when(bad, -F.col("price")).otherwise(F.col("price")))
    return df.select("id", *[F.when(~hole(c), F.col(c)).alias(c) if c in HOLES else c for c in COLUMNS], "target")


def _hole(c: str) -> str:
    return f"CASE WHEN substr(md5('miss:{c}:' || id::varchar), 1, 1) < '5' THEN NULL ELSE {c} END AS {c}"


TAB = f"""tab AS (SELECT id, n_lines, {_hole("qty")},
  CASE WHEN substr(md5('bad:price:' || id::varchar), 1, 2) = 'ff' THEN -price ELSE price END AS price, {_hole("disc")}, {_hole("tax")}, target
  FROM (SELECT l_orderkey AS id, count(*)::double AS n_lines, floor(sum(l_quantity) * 10000 + 0.501) / 10000.0 AS qty, floor(avg(l_extendedprice) * 10000 + 0.501) / 10000.0 AS price,
    floor(avg(l_discount) * 10000 + 0.501) / 10000.0 AS disc, floor(avg(l_tax) * 10000 + 0.501) / 10000.0 AS tax FROM lineitem GROUP BY 1)
  JOIN (SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1)::int - 1 AS target FROM orders) USING (id))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, values, label): every vector as a series of its components, the label by parity."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("values"), (F.col("label") % 2).alias("label")
    )


SERIES = "series AS (SELECT vec_id AS id, list_transform(embedding, lambda x: round(x::double, 6)) AS v, label % 2 AS label FROM embeddings)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, t, x): each user's mean value a day, to 6 places, on the full grid."""
    from ..operators.series import daily_grid

    g = daily_grid(read(spark, sf_dir, "events"), "user_id", "ts", "value")
    return g.withColumn("x", F.round("x", 6))


DAILY = """bounds AS (SELECT min(ts)::date AS lo, max(ts)::date AS hi FROM events),
daily AS (SELECT u.user_id, date_diff('day', b.lo, d.day)::int AS t, m.x
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN bounds b
  CROSS JOIN LATERAL (SELECT unnest(generate_series(b.lo, b.hi, INTERVAL 1 DAY))::date AS day) d
  LEFT JOIN (SELECT user_id, ts::date AS day, round(avg(value), 6) AS x FROM events GROUP BY 1, 2) m ON m.user_id = u.user_id AND m.day = d.day)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, truth, prob, score, cls): labelled texts and deterministic guesses from their length."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    p = (F.col("n_chars") % 997) / 996.0
    return d.select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("truth"), F.round(p, 6).alias("prob"),
        (F.col("doc_id") % 4).cast("int").alias("cls"), F.round(p * 3.5 - 0.25, 6).alias("score"),
    )


PRED = """pred AS (SELECT doc_id AS id, toxic::int AS truth, round((n_chars % 997) / 996.0, 6) AS prob, (doc_id % 4)::int AS cls,
  round((n_chars % 997) / 996.0 * 3.5 - 0.25, 6) AS score FROM documents JOIN labels USING (doc_id))"""
