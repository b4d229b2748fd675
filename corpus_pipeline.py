"""From documents to packed windows: toxicity, near-duplicates, personal data, mixing, packing.

Every stage takes and returns rows like those of ``documents``, the last one pieces. Null and empty texts, null ids and
sources and repeated rows are ordinary rows in all of them, other columns go along unread, and an empty table gives
an empty one. Stages bound the session's Arrow batches, which executors and their Python workers hold several times over.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import mixing, packing, pii, simhash, toxicity
from lodeframe.llm.common import cut, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones outside its held-out fold, doesn't reject.

    Null and empty texts hold nothing toxic and stay, as does every row where labels are missing or teach nothing.
    """
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates.

    All texts without words are one class. Repeated rows are copies of each other; a class without ids keeps a row too.
    """
    small_batches(spark)
    return simhash.dedup(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; null and empty texts stay as they are."""
    small_batches(spark)
    return pii.mask(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is one of its own. Texts without words weigh nothing but are taken at their source's rate, too.
    """
    small_batches(spark)
    return mixing.take(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows; a null or empty text is its end id alone."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents`` in turn; what a stage returns is written, and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the classifier nor byte-pair encoding; tests hold each stage against brute force.
ORACLE_SQL = None
