"""What the corpus operators share: the shared folder, cut lineage, fold tests, labelled samples."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
#: Spark's setting for deleting a query's shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of one Arrow batch (64 MB unless set), and what ``small_batches`` sets.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local master (one machine, one process) gets one of its own; a cluster is refused,
    as a folder of one machine would lose what other machines write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"lodeframe-shared-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet, in a folder of this application that goes when its driver ends."""
    base = f"{shared_dir(spark)}/lodeframe/{spark.sparkContext.applicationId}"
    files, at = _hadoop(spark, base)
    if not files.exists(at):
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: lineage ends there and lost executors don't matter.

    Shuffle files of the plan that wrote it are of no use then; Spark deletes them when the write has ended.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table that ``cut`` wrote; nothing may read it any more."""
    files, at = _hadoop(df.sparkSession, df._written)
    files.delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session hold about ``BATCH_BYTES``, or a row that is larger; a smaller setting stays.

    A batch of whole texts is held several times over, by the JVM outside its heap and by the Python worker, in every
    task that runs. Plans read the setting when they run, so it outlives the call.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text modulo ``mod``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, rows: int, seed: str
) -> list[tuple[int, str, int]]:
    """At most ``rows`` labelled training texts, half from each class as far as it goes, as (doc_id, text, label).

    Only ids whose fold is not ``held`` are used. An id labelled more than once takes the mean label, rounded
    half up; null ids and labels are left out. The draw is the smallest md5 of seed and id in each class,
    so it doesn't depend on partitioning. Texts of an id that occurs repeatedly: the smallest text.
    """
    known = (
        labels.select(F.col("doc_id").alias("_i"), F.col(label).cast("double").alias("_y"))
        .where(F.col("_i").isNotNull() & F.col("_y").isNotNull() & (fold("_i", mod) != held))
        .groupBy("_i")
        .agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
        .withColumn("_k", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_i").cast("string"))))
    )
    half = rows // 2
    drawn: list = []
    for y in (0, 1):
        drawn += known.where(F.col("_y") == y).orderBy("_k", "_i").limit(half).select("_i", "_y").collect()
    if not drawn:
        return []
    wanted = docs.sparkSession.createDataFrame([(r["_i"], r["_y"]) for r in drawn], "_i long, _y int")
    got = (
        docs.select(F.col("doc_id").cast("long").alias("_i"), F.coalesce("text", F.lit("")).alias("_t"))
        .join(F.broadcast(wanted), "_i")  # at most ``rows`` rows
        .groupBy("_i", "_y")
        .agg(F.min("_t").alias("_t"))
        .collect()
    )
    return sorted((r["_i"], r["_t"], r["_y"]) for r in got)
