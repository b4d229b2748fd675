"""Language-model scoring with a weighted backoff automaton.

The model is a word trigram model over all training texts with Dirichlet smoothing (MacKay & Peto 1995): with the counts c
of a context h and of what follows it, and h' the context without its first word,

    p(w | h) = (c(h w) + M p(w | h')) / (c(h) + M),        p(w) = (c(w) + 1) / (N + V + 1).

States are the contexts that occur. A word that follows a context is an arc with the log of p(w | h), leading to the
longest context that ends there. For any other word the state's failure arc, of weight M / (c(h) + M), leads to h'.
A text is scored in one traversal from left to right; the weights passed add up to its log-probability.

Every n-gram that occurs is in the model, at any corpus size, and nothing of the model is broadcast. Texts are dealt into
groups of bounded size that ask for the counts of their own words, then bigrams, then trigrams. An n-gram doesn't
occur oftener than either of its halves, so where a half occurs in this group alone, in training and held-out texts, no other group
has anything to tell and nothing is asked. Asked n-grams go by 64-bit hash to buckets, where the groups' counts
are added up; buckets are ranges of the hash, so a frequent word or context is one key in one bucket. The
answers come back in the order asked, without keys. ``build`` is the
same automaton in one process; tests hold the scores against its traversal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, parts

MOD, HELD = 7, 2
MASS, SEED = 100.0, 42  # M, the words that a context's prior weighs
GROUP_CHARS, BUCKET_CHARS, FLUSH_CHARS = 3_500_000, 6_000_000, 8_000_000
START = 0  # number of the begin-of-text context; 1 is the end token, words follow
STOP = 1


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


#: Tokens have no spaces, so no word is one of these.
FIRST, LAST = (xxhash.xxh64_intdigest(w, SEED) for w in (b" start", b" end"))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of its context and its last word."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _encode(texts: pa.Array) -> np.ndarray:
    """The hashes of the words of all texts, each text between FIRST and LAST; every distinct word is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    words = lists.flatten().dictionary_encode()
    _, at, raw = words.dictionary.buffers()
    at, raw = np.frombuffer(at, np.int64)[: len(words.dictionary) + 1], raw.to_pybytes() if raw else b""
    cuts = at.tolist()
    named = np.array([xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(cuts, cuts[1:], strict=False)], np.uint64)
    code = words.indices.to_numpy()
    real = (np.diff(at) > 0)[code]  # blanks at either end leave empty words
    ends = np.cumsum(np.append(0, real))[np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy()))]
    flat = named[code[real]]
    out = np.empty(len(flat) + 2 * len(texts), np.uint64)
    rows = np.arange(len(texts))
    inside = np.ones(len(out), bool)
    for at, mark in ((ends[:-1] + 2 * rows, FIRST), (ends[1:] + 2 * rows + 1, LAST)):
        out[at] = mark
        inside[at] = False
    out[inside] = flat
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, at, back): the distinct values sorted, a place of each, and each value's key."""
    order = np.argsort(x)
    line = x[order]
    new = np.append(True, line[1:] != line[:-1]) if len(x) else np.empty(0, bool)
    back = np.empty(len(x), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return line[new], order[new], back


@dataclass
class Automaton:
    """arcs: state -> word -> (log10 p, state); fail and weight by state; state 0 is the root."""

    start: int = 0
    arcs: list[dict[int, tuple[float, int]]] = field(default_factory=lambda: [{}])
    fail: list[int] = field(default_factory=lambda: [0])
    weight: list[float] = field(default_factory=lambda: [0.0])

    def traverse(self, words: list[int], root: list[float]) -> float:
        """log10 probability of a text: ``words`` are vocabulary numbers or -1, ``root`` their log10 p at the root."""
        total, s = 0.0, self.start
        for w, p in zip(words, root, strict=True):
            while (a := self.arcs[s].get(w)) is None and s:
                total += self.weight[s]
                s = self.fail[s]
            total += p if a is None else a[0]
            s = 0 if a is None else a[1]
        return total


def build(counts: dict[tuple[int, ...], int], docs: int, mass: float = MASS) -> Automaton:
    """The automaton of counted words, bigrams and trigrams, as tuples of numbers; START is counted ``docs`` times."""
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    seen = {**counts, (START,): docs}
    auto, state = Automaton(), {(): 0}
    for h in sorted({g[:-1] for g in counts if len(g) > 1}, key=len):
        state[h] = len(auto.fail)
        auto.arcs.append({})
        auto.fail.append(state.get(h[1:], 0))
        auto.weight.append(math.log10(mass / (seen[h] + mass)))

    def longest(h: tuple[int, ...]) -> int:
        while h not in state:
            h = h[1:]
        return state[h]

    p: dict[tuple[int, ...], float] = {}
    for g in sorted(counts, key=len):
        p[g] = (counts[g] + 1) / (n + v + 1) if len(g) == 1 else (counts[g] + mass * p[g[1:]]) / (seen[g[:-1]] + mass)
        auto.arcs[state[g[:-1]]][g[-1]] = (math.log10(p[g]), longest(g[-2:]))
    auto.start = longest((START,))
    return auto


def _pack(x: np.ndarray) -> bytes:
    """8-byte numbers as compressed byte planes: the high bytes of sorted keys and of small counts are runs."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<u8")


class Group:
    """The texts of a group, and the counts that it learns level by level: words, bigrams, trigrams.

    For each level: ``keys``, what occurs, sorted; ``at``, where each position's n-gram is among the keys; ``own``, two rows,
    how often in the group's training texts and in its held-out texts; ``total``, the same of all groups, once told.
    """

    def __init__(self, bundles: pa.Table):
        some, rows = [], []
        for b in bundles.column("texts"):
            whole = pa.ipc.open_stream(b.as_buffer()).read_all()
            some += [_encode(x) for x in whole.column("text").chunks if len(x)]
            rows.append(whole.drop_columns("text"))
        self.rows = pa.concat_tables(rows)
        held = self.rows.column("held_out").to_numpy()
        self.words = np.concatenate(some)
        self.first = np.flatnonzero(self.words == FIRST)
        self.length = np.diff([*self.first, len(self.words)])
        self.train = np.repeat(~held, self.length)
        self.inside = self.words != FIRST  # has a word before it
        self.levels: list[dict] = []

    def level(self) -> dict:
        """The next level, its totals not told yet; ``ask`` marks the keys whose total isn't known for sure."""
        if not self.levels:
            whole, there = self.words, np.ones(len(self.words), bool)
        elif len(self.levels) == 1:
            whole, there = np.append(np.uint64(0), mix(self.words[:-1], self.words[1:])), self.inside
        else:
            two = np.append(np.uint64(0), mix(self.words[:-1], self.words[1:]))
            whole = np.append(np.uint64(0), mix(two[:-1], self.words[1:]))
            there = self.inside & np.append(False, self.inside[:-1])
        keys, index, back = distinct(whole[there])
        at = np.full(len(whole), -1, np.int32)
        at[there] = back
        own = np.array([np.bincount(back[x[there]], minlength=len(keys)) for x in (self.train, ~self.train)], np.int64)
        new = {"keys": keys, "at": at, "own": own, "total": own.copy(), "ask": np.ones(len(keys), bool)}
        if self.levels:
            below = self.levels[-1]
            where = np.flatnonzero(there)[index]
            seen = below["total"].sum(axis=0)
            halves = (seen[below["at"][x]] for x in (where, where - 1))
            new["ask"] = np.minimum(*halves) > own.sum(axis=0)
        self.levels.append(new)
        return new

    def ask(self, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, keys, own counts) of the next level; buckets are ranges of the hash's first ``bits`` bits."""
        new = self.level()
        keys, own = new["keys"][new["ask"]], new["own"][:, new["ask"]]
        ends = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
        for b, (k, n) in enumerate(zip(np.split(keys, ends), np.split(own, ends, axis=1), strict=True)):
            if len(k):
                yield b, _pack(k), _pack(n.reshape(-1))

    def told(self, answers: list[tuple[int, bytes]]) -> None:
        """Adds to the next level's totals what other groups counted, given by bucket."""
        new = self.level()
        if answers:
            new["total"][:, new["ask"]] += np.concatenate([_unpack(x).reshape(2, -1) for _, x in sorted(answers)], axis=1).astype(np.int64)
        for done in ("keys", "own", "ask"):
            del new[done]

    def scores(self, total: int, mass: float) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and the traversal's score of each text."""
        one, two, three = (np.where(x["at"] < 0, 0, np.append(x["total"][0], 0)[x["at"]]) for x in self.levels)
        before = lambda x: np.append(0, x[:-1])
        root = (one + 1) / total
        p2 = (two + mass * root) / (before(one) + mass)
        p3 = (three + mass * p2) / (before(two) + mass)
        fail = lambda h: np.log10(mass / (before(h) + mass))  # noqa: E731  a context that doesn't occur weighs nothing
        up = np.where(three > 0, np.log10(p3), fail(two) + np.where(two > 0, np.log10(p2), fail(one) + np.log10(root)))
        base, word = np.where(self.inside, np.log10(root), 0.0), np.where(self.inside, up, 0.0)
        known = (one > 0) & self.inside
        return self.length - 1, np.add.reduceat(known.astype(np.int64), self.first), np.add.reduceat(base, self.first), np.add.reduceat(word, self.first)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pid, texts): the rows of a group as a compressed Arrow stream."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        held.clear()
        pids = rows.column("pid").to_numpy()
        for pid in np.unique(pids):
            own = rows.filter(pa.array(pids == pid)).drop_columns("pid").combine_chunks()
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(own)
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int64()), pa.array([out.getvalue().to_pybytes()])], ["pid", "texts"])

    for b in batches:
        held.append(b)
        size += b.nbytes
        if size > FLUSH_CHARS:
            yield from flush()
            size = 0
    if held:
        yield from flush()


ASKED, ANSWER = "b int, pid long, k binary, own binary", "pid long, o int, b int, more binary, n long, v long"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    cols = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(cols)], names=[c for c, _ in cols])


def _answers(order: int):
    """For each group that asks in a bucket, in the order asked, what the other groups counted."""

    def run(asked: pa.Table) -> pa.Table:
        keys = [_unpack(x.as_py()) for x in asked.column("k")]
        ends = np.cumsum([0, *map(len, keys)])
        names, _, back = distinct(np.concatenate(keys))
        del keys
        total = np.zeros((2, len(names)), np.int64)
        for i, x in enumerate(asked.column("own")):  # a group's keys are distinct
            total[:, back[ends[i] : ends[i + 1]]] += _unpack(x.as_py()).reshape(2, -1).astype(np.int64)
        words = (total[0] > 0) & (names != FIRST)
        summary = (int(total[0][words].sum()), int(words.sum()))
        b, rows = asked.column("b")[0].as_py(), []
        for i, (pid, x) in enumerate(zip(asked.column("pid").to_pylist(), asked.column("own"), strict=True)):
            more = total[:, back[ends[i] : ends[i + 1]]] - _unpack(x.as_py()).reshape(2, -1).astype(np.int64)
            rows.append((pid, order, b, _pack(more.reshape(-1)), *(summary if i == 0 else (0, 0))))
        return _table(ANSWER, rows)

    return run


def _rebuilt(bundles: pa.Table, told: pa.Table | None, levels: int) -> Group:
    group = Group(bundles)
    cols = [told.column(c).to_pylist() for c in ("o", "b", "more")] if levels else [[]] * 3
    for o in range(levels):
        group.told([(b, x) for at, b, x in zip(*cols, strict=True) if at == o + 1])
    return group


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, mod: int = MOD, held: int = HELD, mass: float = MASS) -> DataFrame:
    """Scores every row of ``docs`` with a model of the rows outside the held-out fold.

    Every word, bigram and trigram of the training rows is in the model. A null or empty text is one end token. Repeated rows count
    as often as they occur, null ids count as the empty text in the fold. Without training rows every token has
    probability 1. An empty table gives an empty result. Other columns aren't read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "held_out", fold("doc_id", mod) == held
    )
    # A group is part of a file split, so that one task bundles it.
    place = [F.input_file_name(), F.input_file_block_start()]
    sizes = own.groupBy(*place).agg(F.sum(F.length("text")).alias("c")).agg(F.count("*"), F.sum("c")).first()
    chars = sizes[1] or 0
    within = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts(chars, GROUP_CHARS * max(1, sizes[0]))))
    dealt = own.select("doc_id", "text", "held_out", F.xxhash64(*place, within).alias("pid"))
    bundles = cut(dealt.mapInArrow(_bundles, "pid long, texts binary"), "lm-texts")
    bits = (parts(chars, BUCKET_CHARS) - 1).bit_length()

    def asks(texts: pa.Table, told: pa.Table | None, levels: int) -> pa.Table:
        if not texts.num_rows:
            return _table(ASKED, [])
        pid = texts.column("pid")[0].as_py()
        return _table(ASKED, [(b, pid, k, n) for b, k, n in _rebuilt(texts, told, levels).ask(bits)])

    def words(texts: pa.Table) -> pa.Table:
        return asks(texts, None, 0)

    def bigrams(texts: pa.Table, told: pa.Table) -> pa.Table:
        return asks(texts, told, 1)

    def trigrams(texts: pa.Table, told: pa.Table) -> pa.Table:
        return asks(texts, told, 2)

    told = None
    for o, ask in enumerate((words, bigrams, trigrams), 1):
        groups = bundles.groupBy("pid")
        asked = groups.applyInArrow(ask, ASKED) if told is None else groups.cogroup(told.groupBy("pid")).applyInArrow(ask, ASKED)
        more = cut(asked.groupBy("b").applyInArrow(_answers(o), ANSWER), f"lm-told-{o}")
        if told is None:
            n, v = (x or 0 for x in more.agg(F.sum("n"), F.sum("v")).first())
        told = more if told is None else told.unionByName(more)

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SCORED.split(", ")]
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)], names=names)
        group = _rebuilt(texts, told, 3)
        length, known, base, full = group.scores(n + v + 1, mass)
        rows = group.rows
        return pa.table([rows.column("doc_id"), rows.column("held_out"), *map(pa.array, (length, known, np.full(len(length), n, np.int64), base, full))], names=names)

    return bundles.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(run, SCORED)
