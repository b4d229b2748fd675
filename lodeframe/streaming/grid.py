"""An extension: half-hour means over a stream of readings, with a watermark. The same plan runs over a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def half_hours(df: DataFrame, ts: str, value: str, *by: str, late: str = "1 hour") -> DataFrame:
    """(bucket, by.., n, x): rows later than ``late`` behind the stream's newest are left out; a table has none."""
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    g = df.groupBy(F.window(ts, "30 minutes").alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("x"))
    return g.select(F.col("w.start").alias("bucket"), *by, "n", "x")


def start(df: DataFrame, path: str, checkpoint: str):
    """Appends closed half hours to a table; the checkpoint lets a restarted stream go on where it was."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
