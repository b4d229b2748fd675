"""The corpus operators against brute force, on the small tables and on odd rows."""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from lodeframe.llm import mixing, packing, queries, rules, simhash, token_files, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, BARE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3),
    (None, "x y z w", "en", "a", 7), (5, "a b c " * 4000, "en", "a", 1), (6, "w" * 30000, "en", "b", 1), (7, "a\n\na\n b \n\tc d\x0b<|endoftext|> e", "en", "a", 1),
    (8, "Ünï çödé é   it's  I'LL 12 345,6 !!\x1c\x1cx", "en", None, 1), (9, "same words here again and again and again", "en", "b", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    extra = spark.createDataFrame(ODD, SCHEMA)
    clash = {c: extra["n_chars"] for c in ("size", "fp", "key", "p", "target", "_d", "_t", "length", "start", "n_words")}
    return extra.withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


def size(t):
    return len(WORD.findall(t or ""))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(request, which):
    own = request.getfixturevalue(which)
    got = mixing.mix(own, chunk=7)
    found = [r.asDict() for r in got.collect()]
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(mixing.mix(own.repartition(5), chunk=7))))
    want = Counter((r["doc_id"], r["source"], size(r["text"])) for r in own.collect())
    assert want == Counter((r["doc_id"], r["source"], r["size"]) for r in found)
    total = Counter()
    for (_, s, w), n in want.items():
        total[s] += w * n
    assert sum(total.values()) * 1.5 == pytest.approx(sum({r["source"]: r["target"] for r in found}.values()))
    for r in found:
        assert r["source_size"] == total[r["source"]] and r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-6
    taken = Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
    for s, t in {r["source"]: r["target"] for r in found}.items():
        assert abs(taken[s] - t) <= 3 * max(r["size"] for r in found if r["source"] == s)
    assert mixing.take(own).count() == sum(r["copies"] for r in mixing.mix(own).collect())
    assert mixing.take(own).columns == own.columns


def test_targets_reshare():
    t = mixing.targets({"a": 10, "b": 1000, "c": 1000, None: 0})
    assert t["a"] == 20 and t["b"] == pytest.approx(2995 * 2 / 3) and t[None] == 0
    assert sum(t.values()) == pytest.approx(3015)


def test_pivot_keeps_sums():
    import random

    mean = np.zeros(40)
    for k in range(300):
        p = mixing.pivot([0.3] * 40, random.Random(k), True)
        assert set(p) <= {0.0, 1.0} and abs(sum(p) - 12) <= 1
        mean += p
    assert 0.15 < (mean / 300).min() and (mean / 300).max() < 0.45


def measured(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    cover = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_rules(request, which):
    own = request.getfixturevalue(which)
    book = rules.verdicts(rules.ledger(own))
    got = rows(book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert sorted(map(repr, got)) == sorted(repr((r["doc_id"], *measured(r["text"]))) for r in own.collect())
    for r in book.collect():
        bad = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == bad and not (bad and r["kept"]) and bool(r["failures"]) != r["kept"]
    out = {r["rule"]: r for r in rules.ablation(book).collect()}
    assert out["too_few_words"]["n_failed"] == sum(r["n_words"] < 50 for r in book.collect())
    assert all(r["n_only"] <= r["n_failed"] for r in out.values())


def test_rules_keep_good_documents(docs, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = rules.verdicts(rules.ledger(docs)).join(labels, "doc_id").where("n_words >= 50").groupBy("quality").agg({"*": "count"}, ).collect()
    kept = rules.verdicts(rules.ledger(docs)).join(labels, "doc_id").where("n_words >= 50 and kept").groupBy("quality").count().collect()
    n, k = {r[0]: r[1] for r in found}, {r[0]: r[1] for r in kept}
    assert k[1] / n[1] > 0.95 and k.get(0, 0) / n[0] < 0.4


def fp(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, ids, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(request, which):
    own = request.getfixturevalue(which)
    held = own.collect()
    fps = [fp(r["text"]) for r in held]
    want = Counter(zip([r["doc_id"] for r in held], fps, linked(fps, [r["doc_id"] for r in held]), strict=True))
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.classes(own).collect())
    assert got == want
    kept = simhash.dedup(own)
    assert kept.columns == own.columns and kept.count() == len({r[2] for r in want})


def test_dedup_keeps_a_row_of_every_class(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 60)) for _ in range(12)]
    own = [(None, t) for t in texts[:6]] + [(i, t) for i, t in enumerate(texts[6:9])] + [(1, texts[9]), (1, texts[10]), (7, texts[10]), (8, texts[11]), (None, texts[11]), (None, texts[0]), (2, texts[8])]
    of = linked([fp(t) for _, t in own], list(range(len(own))))
    want = []
    for c in set(of):
        want.append(min((r for r, x in zip(own, of, strict=True) if x == c), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
    assert len(want) == 12
    got = rows(simhash.dedup(spark.createDataFrame(own, "doc_id long, text string").repartition(3)))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_simhash_links_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(30):
            x = int(b)
            for k in rng.choice(63, rng.integers(1, 6), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    from lodeframe.llm.components import components

    want = dict(zip(fps, linked(fps, fps), strict=True))
    for posting in (4, 256):
        got = {r["node"]: r["root"] for r in components(simhash.link_edges(df, posting=posting)).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_covering():
    from itertools import combinations

    assert len(simhash.covering()) == 20
    assert all(any(set(t) <= set(q) for t in simhash.covering()) for q in combinations(range(8), 4))


@pytest.mark.parametrize("path", [BYTE, BARE])
def test_ids_equal_whole_texts(path, docs):
    tok = Tokenizer.from_file(path)
    enc = tokens.Encoder(path, chunks=2000)
    texts = [r[1] or "" for r in ODD] + [r["text"] or "" for r in docs.collect()]
    texts += ["\n", " ", "a", " a", "a ", "\na", "a\n", "a\n\n\nb", "a  b", "\t\ta\t b", "don't 's", "<|startoftext|> x<|endoftext|>", "a\u0085b ́c", "\r\n\r\nx\r\n"]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t[:60]


def test_ids_property():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    both = [(tokens.Encoder(p), Tokenizer.from_file(p)) for p in (BYTE, BARE)]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\x85  aB1é́'slt<|>!ßΣ"), max_size=14), max_size=3))
    def run(texts):
        for enc, tok in both:
            assert [x.tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]

    run()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, which):
    own = request.getfixturevalue(which)
    tok = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in own.collect():
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for s in range(0, len(ids), 1024):
            p = ids[s : s + 1024]
            want[(r["doc_id"], s, len(p), zlib.crc32(p.tobytes()), len(ids))] += 1
    got = packing.pack(own, BYTE).collect()
    assert Counter(tuple(None if x is None else int(x) for x in r[:5]) for r in got) == want
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(windows) <= 1.08 * total / 1024 + 2


def test_best_fit_equals_plain_search():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 101, 500).tolist(), reverse=True)
    free, want = [], []
    for x in lengths:
        fits = [(c, w) for w, c in enumerate(free) if c >= x]
        c = min(fits)[0] if fits else 100
        if not fits:
            free.append(100)
        want.append(c)
        w = next(w for w in reversed(range(len(free))) if free[w] == c)
        free[w] -= x
    which, offset = packing.best_fit(lengths, 100)
    assert [100 - o for o in offset] == want and max(which) + 1 == len(free)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files(request, which):
    own = request.getfixturevalue(which)
    tok = Tokenizer.from_file(BARE)
    held = sorted(own.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want, at = [], 0
    for r in held:
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(repr, rows(token_files.round_trip(own, BARE)))) == sorted(map(repr, want))


def test_reader_touches_only_frames_asked_for():
    out = io.BytesIO()
    w = token_files.Writer(out, frame=10)
    docs = {i: np.arange(i * 7 % 23, dtype=np.uint32) for i in range(50)}
    for i, x in docs.items():
        w.add(i, x)
    w.close()
    raw = bytearray(out.getvalue())
    r = token_files.Reader(io.BytesIO(bytes(raw)), len(raw))
    assert {d: x.tolist() for d, _, x in r.documents()} == {i: x.tolist() for i, x in docs.items()}
    raw[3 + 4] ^= 255  # in the first frame
    r = token_files.Reader(io.BytesIO(bytes(raw)), len(raw))
    assert [x.tolist() for _, _, x in r.documents({49})] == [docs[49].tolist()]
    with pytest.raises(Exception):  # noqa: B017  the decoder or the checksum objects
        list(r.documents())


@pytest.mark.parametrize("run", ["mix", "ledger", "pack", "classes", "round_trip", "take", "dedup"])
def test_empty_tables(spark, run):
    none = spark.createDataFrame([], SCHEMA)
    f = {
        "mix": mixing.mix, "ledger": rules.ledger, "pack": lambda d: packing.pack(d, BYTE), "classes": simhash.classes,
        "round_trip": lambda d: token_files.round_trip(d, BARE), "take": mixing.take, "dedup": simhash.dedup,
    }[run]
    assert f(none).count() == 0


def test_queries_are_registered():
    assert {"op3_mixing", "op4_quality_rules", "op6_packing", "op8_simhash", "op9_token_files"} <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    df = queries.queries()[name](spark, sf_dir).select(*names)
    assert sorted(map(tuple, df.collect())) == sorted(r.fetchall())
