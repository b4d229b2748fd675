"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document. The ledger keeps the measurements and one long of failure bits, so a
policy is a mask: applying another version, or asking what a rule alone rejects, reads the ledger and no text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD

SYMBOL = r"[#*$%&|<>]"

#: Rules in bit order, each a condition under which a document fails, over the measurements of ``measure``.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("long_words", "word_chars > 12 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("exclamations", "2 * n_marks > n_words"),
]
#: Versions of the policy: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": tuple(name for name, _ in RULES),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in ``words``, each word once.

    Windows are sorted by hash and position; equal neighbours mark repeats; positions of marked windows, sorted
    again, cover each at most three words.
    """
    n = F.size(words)
    windows = F.when(n < 4, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(F.transform(F.slice(words, 1, n - 2), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    )

    def repeats(s: Column) -> Column:
        h = lambda i: F.get(s, i)["h"]
        marked = F.filter(s, lambda x, k: F.coalesce(h(k + 1) == x["h"], F.lit(False)) | F.coalesce(h(k - 1) == x["h"], F.lit(False)))
        return F.sort_array(F.transform(marked, lambda x: x["i"]))

    def covered(r: Column) -> Column:
        gaps = F.transform(r, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(r, k - 1))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(windows, lambda s: _let(repeats(s), covered))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row; a null text has no words and no lines.

    An empty text, a null id, a repeated row and a text of one very long word are ordinary rows. Columns besides
    doc_id and text aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    words = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))
    return docs.select("doc_id", text.alias("_t")).select(
        "doc_id",
        (F.length("_t") - F.regexp_count("_t", F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_marks"),
        _let(F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("_l"),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("_w"),
    ).select(
        "doc_id", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_marks",
        F.col("_l.n").alias("n_lines"), F.col("_l.d").alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """The measurements and ``failures``: bit k is set if the document fails rule k."""
    bits = [F.when(F.expr(c), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, c) in enumerate(rules)]
    return measure(docs).withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits))


def mask(policy: str | tuple[str, ...], rules: list[tuple[str, str]] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << k for k, (name, _) in enumerate(rules) if name in names)


def verdicts(book: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """The ledger with base_failed and kept, the verdict of ``policy``."""
    failed = lambda p: F.col("failures").bitwiseAND(F.lit(mask(p)).cast("long")) != 0
    return book.withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(policy))


def ablation(book: DataFrame, policy: str | tuple[str, ...] = "v1", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(rule, n_failed, n_only): documents that fail each rule, and those that only it rejects under ``policy``.

    One aggregation over the bits, a row for each rule; an empty ledger gives zeros.
    """
    on = F.lit(mask(policy, rules)).cast("long")
    seen = F.col("failures").bitwiseAND(on)
    counts = [
        F.struct(
            F.lit(name).alias("rule"),
            F.count_if(F.col("failures").bitwiseAND(F.lit(1 << k).cast("long")) != 0).alias("n_failed"),
            F.count_if(seen == F.lit(1 << k).cast("long")).alias("n_only"),
        )
        for k, (name, _) in enumerate(rules)
    ]
    return book.agg(F.array(*counts).alias("x")).select(F.inline("x"))
