"""Trained and pairwise corpus operators against brute force and held-out rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from lodeframe.llm import embedding_dedup, lm, pii, quality, toxicity

from .test_corpus import ODD, SCHEMA, linked


@pytest.fixture(scope="module")
def odd(spark):
    extra = spark.createDataFrame(ODD, SCHEMA)
    return extra.withColumns({c: extra["n_chars"] for c in ("score", "pid", "word", "held_out", "_i", "_t", "spans")}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def bigger(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def crc(i) -> int:
    return zlib.crc32(("" if i is None else str(i)).encode())


# quality


def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        c, used = quality.chunks(text)
        step = quality.CHUNK - quality.OVERLAP
        seen = bytearray(n)
        for k, row in enumerate(c):
            seen[k * step : k * step + used[k]] = bytes(row[: used[k]])
        assert bytes(seen) == text.encode() and (n == 0 or (used > 0).all())


def test_blocks_give_the_same_scores_as_single_texts():
    net = quality.Net.new(np.random.default_rng(1))
    texts = [None, "", "x", "ab " * 400, "é" * 3000]
    assert net.logits(texts) == pytest.approx([net.logit(net.pooled(t)) for t in texts], abs=1e-4)


def test_quality_on_held_out_rows(bigger):
    docs, labels = bigger
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8 and np.mean([g >= 0.3 for g in good]) > 0.95


def test_held_labels_are_not_learnt(docs, spark, sf_dir):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    changed = labels.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % m == h, 1 - F.col(c)).otherwise(F.col(c)) for c, m, h in (("quality", 5, 0), ("toxic", 3, 1))})
    a, b = quality.fit(docs, labels, rows=40), quality.fit(docs, changed, rows=40)
    assert np.array_equal(a.conv, b.conv)
    assert toxicity.fit(docs, labels, rows=60) == toxicity.fit(docs, changed, rows=60)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scores_of_odd_rows_and_without_labels(op, odd, spark):
    none = spark.createDataFrame([(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = op.score(odd, op.fit(odd, none)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert op.score(odd.limit(0), op.fit(odd.limit(0), none)).count() == 0


# toxicity


def test_windows_cover_whole_texts():
    for n in (0, 1, 95, 96, 97, 500):
        raw = toxicity.plain("a" * n)
        w = toxicity.windows(raw)
        assert sum(map(len, w)) >= len(raw) and w[-1][-1:] == raw[-1:] and raw.startswith(w[0])


def test_saved_is_the_difference_of_plain_compressions():
    model = toxicity.Model(b"worthless vermin scumbag", b" the of and in that with", (0.0,) * 9, 0.0)
    both = model.compressors()
    for t in (None, "", "x", "the vermin of it " * 40, "ä" * 500):
        want = []
        for w in toxicity.windows(toxicity.plain(t)):
            size = []
            for held in (model.ordinary, model.toxic + model.ordinary):
                p = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=toxicity.WINDOW, dict_size=len(held), min_match=toxicity.MATCH, write_content_size=False)
                d = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                small = zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(w)
                assert zstandard.ZstdDecompressor(dict_data=d).decompress(small, max_output_size=4096) == w
                size.append(len(small))
            want.append(size[0] - size[1])
        assert model.saved(t, both) == want and model.measures(t, both)[-2] == pytest.approx(math.log(len(want)))


def test_nothing_is_rejected_where_nothing_tells_the_classes_apart(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("of the and in that with on at".split()) for _ in range(60)) for _ in range(90)]
    for labels in ([i % 3 == 0 for i in range(90)], [0] * 90, [1] * 90):
        model = toxicity.train(texts, [int(x) for x in labels], 0.3)
        both = model.compressors()
        assert all(model.score(t, both) < toxicity.CUT for t in [*texts, "", None])
    assert toxicity.train([], []).score("a", toxicity.train([], []).compressors()) < toxicity.CUT
    assert toxicity.best_cut(np.zeros(40), np.repeat([0.0, 1.0], 20), 0.5) is None
    z, y = np.concatenate([np.zeros(50), np.ones(10)]), np.concatenate([np.zeros(50), np.ones(10)])
    assert toxicity.best_cut(z, y, 0.2) == 0.5
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = toxicity.keep_clean(small, toxicity.fit(small, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")))
    assert kept.count() > 0.9 * small.count()


def test_keep_clean_on_odd_rows(odd, spark):
    model = toxicity.Model(b" worthless vermin scumbag", b" the of and", (-4.0, 3.0, 3.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0), 0.0)
    both = model.compressors()
    want = Counter((r["doc_id"], r["text"]) for r in odd.collect() if model.score(r["text"], both) < toxicity.CUT)
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert toxicity.keep_clean(odd.limit(0), model).count() == 0
    bad = spark.createDataFrame([(1, "you scumbag vermin worthless scumbag " * 5, "x"), (None, "you scumbag vermin worthless scumbag " * 5, None), (2, None, "y")], "doc_id long, text string, predicted string")
    assert [r["doc_id"] for r in toxicity.keep_clean(bad, model).collect()] == [2]


def test_planted_words_are_caught():
    rng = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["idiotic", "worthless", "scumbag", "vermin"]

    def text(toxic: bool) -> str:
        w = [word() for _ in range(rng.randint(60, 200))]
        if toxic:
            for _ in range(4):
                w.insert(rng.randint(0, len(w)), rng.choice(bad))
        return " ".join(w)

    rows = [(text(i % 2 == 1), i % 2) for i in range(400)]
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows], 0.3)
    both = model.compressors()
    test = [(text(i % 2 == 1), i % 2) for i in range(200)]
    hit = [(model.score(t, both) >= toxicity.CUT) == (y == 1) for t, y in test]
    assert np.mean(hit) > 0.9
    assert isinstance(both[0], zstandard.ZstdCompressor)


def test_keep_clean_drops_what_is_predicted(bigger):
    docs, labels = bigger
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.where("predicted = 0").count()
    clean = scored.join(labels, "doc_id").where("toxic = 0").agg({"predicted": "avg"}).first()[0]
    caught = scored.join(labels, "doc_id").where("toxic = 1").agg({"predicted": "avg"}).first()[0]
    assert clean < 0.1 and caught > 0.4


# vectors


def vector_rows(seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(base)]
    for k in range(140):
        v = base[k % 20] + rng.normal(size=16) * rng.uniform(0, 0.4)
        rows.append((1000 + k, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), (k % 20) % 3))
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(30)]  # equal vectors
    return [*rows, (3000, [0.0] * 16, 0), (3001, None, 0), (3002, [1.0] * 16, None), (3003, [float("nan")] + [1.0] * 15, 0), (3004, [None] + [1.0] * 15, 1),
            (3005, [1.0, 0.0], 0), (3006, [float("inf")] * 16, 0), (3007, [1e-30] * 16, 2), (3008, [2e-30] * 16, 2), (3009, [-0.0] * 15 + [1.0], 1), (3010, [0.0] * 15 + [1.0], 1)]


def brute(rows: list[tuple], cosine: float = 0.93) -> dict:
    ok = [(i, np.array(v, float), y) for i, v, y in rows if v is not None and None not in v and y is not None and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    near = {i: {i} for i, _, _ in rows}
    for i, v, y in ok:
        for j, w, z in ok:
            if i < j and y == z and len(v) == len(w):
                a, b = v / np.abs(v).max(), w / np.abs(w).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                    near[i].add(j)
                    near[j].add(i)
    root = {}
    for i in sorted(near):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        root[i] = min(seen)
    return {i: (len(near[i]) - 1, root[i]) for i in near}


@pytest.mark.parametrize("tile", [1024, 8])
def test_vectors_against_all_pairs(spark, tile):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.classes(df, tile=tile).collect()}
    assert got == brute(rows)
    assert embedding_dedup.classes(df.limit(0)).count() == 0


def test_collisions_are_what_windows_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(30, 6)), rng.normal(size=(40, 6))
    for half in (0.05, 2.0):
        assert np.array_equal(embedding_dedup.collisions(a, b, half), (np.abs(a[:, None] - b[None]) <= half).sum(axis=2))
    assert embedding_dedup.guaranteed(64)[1] == 50


# language model


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_lm_base(request, which):
    own = request.getfixturevalue(which)
    held = own.collect()
    train = [r for r in held if crc(r["doc_id"]) % 7 != 2]
    c = Counter()
    for r in train:
        c.update(lm.tokens(r["text"]))
        c[None] += 1
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in held:
        t = [*lm.tokens(r["text"]), None]
        want[(r["doc_id"], crc(r["doc_id"]) % 7 == 2, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5))] += 1
    got = lm.score(own).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] <= 1e-9 and math.isfinite(r["score"]) for r in got)
    assert lm.score(own.limit(0)).count() == 0


def counted(texts: list[list]) -> tuple[dict, dict]:
    """(number of each word, counts of all n-grams as tuples of numbers)."""
    number = {w: i + 2 for i, w in enumerate(sorted({w for t in texts for w in t}))}
    counts: Counter = Counter()
    for t in texts:
        s = [lm.START, *(number[w] for w in t), lm.STOP]
        counts.update((w,) for w in s[1:])
        counts.update(zip(s, s[1:], strict=False))
        counts.update(zip(s, s[1:], s[2:], strict=False))
    return number, dict(counts)


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("group", [lm.GROUP_CHARS, 3000])
def test_lm_score_is_the_automatons(request, which, group, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_CHARS", group)
    monkeypatch.setattr(lm, "BUCKET_CHARS", group)
    own = request.getfixturevalue(which)
    held = own.collect()
    texts = [lm.tokens(r["text"]) for r in held if crc(r["doc_id"]) % 7 != 2]
    number, counts = counted(texts)
    total = sum(c for g, c in counts.items() if len(g) == 1) + sum(len(g) == 1 for g in counts) + 1
    auto = lm.build(counts, len(texts))
    want = Counter()
    for r in held:
        w = [*(number.get(w, -1) for w in lm.tokens(r["text"])), lm.STOP]
        want[(r["doc_id"], round(auto.traverse(w, [math.log10((counts.get((x,), 0) + 1) / total) for x in w]), 5))] += 1
    assert Counter((r["doc_id"], round(r["score"], 5)) for r in lm.score(own).collect()) == want


def test_automaton_sums_to_one_and_equals_plain_backoff():
    rng = random.Random(4)
    texts = [[rng.choice("abcde") for _ in range(rng.randint(1, 12))] for _ in range(40)]
    number, counts = counted(texts)
    auto = lm.build(counts, len(texts), mass=3.0)
    seen = {**counts, (lm.START,): len(texts)}
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)

    def p(w, *h):
        if not h:
            return (counts.get((w,), 0) + 1) / (n + v + 1)
        return (counts.get((*h, w), 0) + 3.0 * p(w, *h[1:])) / (seen.get(h, 0) + 3.0)

    every = [*number.values(), lm.STOP, -1]  # -1: all unknown words together
    for h in [(), (2,), (lm.START,), (2, 3), (lm.START, 2), (5, 5)]:
        assert sum(p(w, *h) for w in every) == pytest.approx(1.0)
    for t in texts[:20]:
        seq = [number[w] for w in t]
        if len(seq) > 3:
            seq[2] = -1
        seq.append(lm.STOP)
        want, h = 0.0, (lm.START,)
        for w in seq:
            want += math.log10(p(w, *h))
            h = (*h, w)[-2:]
        assert auto.traverse(seq, [math.log10(p(w)) for w in seq]) == pytest.approx(want, abs=1e-9)


def test_keys_and_counts_survive_packing():
    x = np.array([0, 1, 2**63, 2**64 - 1, 12345], np.uint64)
    assert np.array_equal(lm._unpack(lm._pack(x)), x) and len(lm._unpack(lm._pack(x[:0]))) == 0


def test_model_beats_base_on_held_out_rows(bigger):
    r = lm.score(bigger[0]).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert r["sum(score)"] > r["sum(base_score)"]


# personal data


def plain_spans(text: str) -> list:
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return pii.ordered(out)


def test_base_spans_property():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=1500, deadline=None)
    @given(st.text(alphabet=st.sampled_from("a1.@-+ 0 95(%)é4"), max_size=50))
    def run(t):
        assert pii.base_spans(t) == plain_spans(t)

    run()
    assert pii.base_spans("4" * 40000) == [] and len(pii.base_spans("w" * 40000 + "@x.de")) == 1


def test_spans_of_very_long_runs(spark):
    zeros = "0" * 5000
    texts = [f"{zeros}1.1.1.1", f"{zeros}.1.1.1", f"1.{zeros}256.1.1", f"1.{zeros}255.1.1", "1" * 5000 + ".1.1.1", "+" + "1" * 2_000_000, "ab " * 700_000 + "x@y.zz", "." * 1_000_000]
    assert [len([k for k, _, _ in pii.base_spans(t) if k == "ip"]) for t in texts[:5]] == [1, 1, 0, 1, 0]
    assert pii.base_spans(texts[6]) == [("email", 2_100_000, 2_100_006)] and pii.base_spans(texts[7]) == []
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(df)
    assert pii.find(df, model).agg({"n_ip": "sum"}).first()[0] == 3
    assert "[IP]" in pii.mask(df, model).where("doc_id = 3").first()["text"]
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=60, deadline=None)
    @given(st.text(alphabet="01.2", max_size=12), st.sampled_from([4299, 4301, 9000]), st.text(alphabet="01. -+", max_size=12))
    def run(a, n, b):
        want = [x for x in plain_spans(f"{a}{'0' * 40}{b}") if x[0] == "ip"]
        assert len([x for x in pii.base_spans(f"{a}{'0' * n}{b}") if x[0] == "ip"]) == len(want)

    run()


def test_em_finds_out_unreliable_labelers():
    rng = random.Random(6)
    seen: Counter = Counter()
    for _ in range(4000):
        hit = rng.random() < 0.4
        says = lambda right: (1 if hit == (rng.random() < right) else -1)  # noqa: E731, B023
        seen[(says(0.95), says(0.9), says(0.9), says(0.5), says(0.1))] += 1
    votes = np.array(list(seen))
    q, rel = pii.em(votes, np.array(list(seen.values()), float))
    assert all(a > 0.8 and b > 0.8 for a, b in rel[:3])
    assert all(abs(x - 0.5) < 0.07 for x in rel[3]) and all(x < 0.25 for x in rel[4])
    sure = {tuple(v): p for v, p in zip(votes.tolist(), q.tolist(), strict=True)}
    assert sure[1, 1, 1, 1, -1] > 0.95 > 0.05 > sure[-1, -1, -1, 1, 1]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_pii(request, which):
    import hashlib

    own = request.getfixturevalue(which)
    model = pii.fit(own)
    want = Counter()
    for r in own.collect():
        s = plain_spans(r["text"] or "")
        n = Counter(k for k, _, _ in s)
        want[(r["doc_id"], n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
    got = pii.find(own, model).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    masked = pii.mask(own, model)
    assert masked.columns == own.columns and not any(plain_spans(r["text"] or "") for r in masked.collect())
    assert pii.find(own.limit(0), pii.fit(own.limit(0))).count() == 0


def test_labelers_agree_on_credentials():
    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"and then password={hexes(20)} was seen" for _ in range(60)] + [f'the token = "{hexes(40)}" of it' for _ in range(60)]
    texts += ["THEWORDSARELONGINHERE and VERYMUCHSOINDEED they are" for _ in range(80)] + [f"key AKIA{''.join(rng.choice('BCDFGHJKLMNP23') for _ in range(16))} lay there" for _ in range(40)]
    texts = [t for t in texts if not pii.base_spans(t)]  # digits in a key may happen to pass for a card
    seen = Counter(c.key() for t in texts for c in pii.candidates(t, []))
    model = pii.train(dict(seen))
    assert all(k == "secret" for t in texts for k, _, _ in model.spans(t)[1])
    assert all(len(model.spans(t)[1]) == (0 if "WORDS" in t else 1) for t in texts)
    assert pii.masked("a password=0123456789abcdef0123 b", model) == "a password=[SECRET] b"


@pytest.mark.parametrize("run", ["quality", "toxicity", "keep_clean", "find", "mask", "lm", "vectors"])
def test_no_rows_give_no_rows(spark, run):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    f = {
        "quality": lambda: quality.score(none, quality.fit(none, labels)), "toxicity": lambda: toxicity.score(none, toxicity.fit(none, labels)),
        "keep_clean": lambda: toxicity.keep_clean(none, toxicity.fit(none, labels)), "find": lambda: pii.find(none, pii.fit(none)),
        "mask": lambda: pii.mask(none, pii.fit(none)), "lm": lambda: lm.score(none),
        "vectors": lambda: embedding_dedup.classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    }[run]
    assert f().count() == 0


def test_convolution_against_plain_loops():
    net = quality.Net.new(np.random.default_rng(3))
    net.bias = np.random.default_rng(4).normal(0, 0.1, quality.FILTERS).astype(np.float32)
    for text in ("", "abc", "the quick brown fox " * 40, "é" * 300):
        raw, step = text.encode(), quality.CHUNK - quality.OVERLAP
        pooled = []
        for at in range(0, max(1, len(raw) - quality.OVERLAP), step):
            part = raw[at : at + quality.CHUNK]
            last = max(1, (len(part) - quality.WIDTH) // quality.STRIDE + 1)
            best = np.full(quality.FILTERS, -np.inf)
            for w in range(last):
                seen = [net.emb[part[i] if i < len(part) else 0] for i in range(w * quality.STRIDE, w * quality.STRIDE + quality.WIDTH)]
                best = np.maximum(best, np.concatenate(seen) @ net.conv)
            pooled.append(np.maximum(best + net.bias, 0))
        h = np.array(pooled)
        want = np.concatenate([h.mean(axis=0), h.max(axis=0), h.min(axis=0)]) @ net.out + net.const
        assert net.logits([text])[0] == pytest.approx(float(want), abs=1e-4)


def test_spans_are_base_and_likely_candidates(docs):
    own = docs.withColumn("text", docs["text"])
    model = pii.fit(own)
    seen: Counter = Counter()
    texts = {r["doc_id"]: r["text"] or "" for r in own.collect()}
    for t in texts.values():
        seen.update(c.key() for c in pii.candidates(t, plain_spans(t)))
    assert {k: w.tolist() for k, w in pii.train(dict(seen)).weights.items()} == {k: w.tolist() for k, w in model.weights.items()}
    for r in pii.find(own, model).collect():
        t = texts[r["doc_id"]]
        want = plain_spans(t)
        for c in pii.candidates(t, want):
            x = [1.0, *[float(v == 1) for v in c.votes], *[float(v == -1) for v in c.votes], *[s / 3 for s in c.shape]]
            if 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights[c.kind], strict=True)))) >= 0.5:
                want = [*want, (c.kind, c.start, c.end)]
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(want, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2])))


# pipeline


def test_pipeline_on_few_rows(spark, tmp_path):
    import corpus_pipeline as P

    for name, some in (("none", []), ("odd", [r for r in ODD if r[0] != 8])):
        d = tmp_path / name
        spark.createDataFrame(some, SCHEMA).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(4, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        pieces = P.run(spark, str(d))
        assert (pieces.count() > 0) == (name == "odd")
        assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(pieces.columns)


def test_pipeline_stages(spark, sf_dir, docs):
    import corpus_pipeline as P

    from lodeframe.llm import simhash

    at = docs
    for name, f in P.STAGES[:-1]:
        out = f(spark, at, sf_dir)
        assert sorted(out.columns) == sorted(docs.columns), name
        assert out.count() > 0, name
        if name == "simhash":
            rows = at.collect()
            fps = [r["fp"] % 2**64 for r in simhash.fingerprints(at.select("doc_id", "text")).collect()]
            assert out.count() == len(set(linked(fps, [r["doc_id"] for r in rows])))
        at = out
    assert P.STAGES[-1][1](spark, at, sf_dir).agg({"length": "sum"}).first()[0] > 0
    assert P.run(spark, sf_dir).count() > 0


def test_pipeline_hands_workers_small_batches(spark, sf_dir, docs):
    import corpus_pipeline as P
    import pyarrow as pa
    from pyspark.sql import functions as F

    from lodeframe.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    long = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("word "), 1000).alias("text"))
    before = spark.conf.get(common.BATCH)
    try:
        for name, f in P.STAGES:
            spark.conf.set(common.BATCH, "64m")
            f(spark, docs.limit(0), sf_dir)
            got = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
            assert sum(got) > 20_000_000 and max(got) < 4_000_000, name
        spark.conf.set(common.BATCH, "1m")
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH) == "1m"  # smaller ones stay
    finally:
        spark.conf.set(common.BATCH, before)


def test_packing_leaves_no_encoder_in_its_worker(spark):
    import public_tokenizers
    import pyarrow as pa

    from lodeframe.llm import packing, tokens

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    run = packing.pieces(Docs(), public_tokenizers.path("byte_bpe_50k.json"), keep=False)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["some words", None])], ["doc_id", "text"])
    tokens.forget()
    assert [b.num_rows for b in run(iter([batch, batch]))] == [2, 2]
    assert tokens.encoder.cache_info().currsize == 0
    part = run(iter([batch, batch]))
    next(part)
    part.close()  # a task that ends early
    assert tokens.encoder.cache_info().currsize == 0


def test_words_are_hashed_in_order():
    import pyarrow as pa
    import xxhash

    texts = ["", " ", "a", " The  the\tcat\n", "x\x0by\x0cz\rq", "é É b c d", "\x1c a\x1fb", "A" * 3000, "\n\n b"]
    want = []
    for t in texts:
        want += [lm.FIRST, *(xxhash.xxh64_intdigest(w, lm.SEED) for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())), lm.LAST]
    assert lm._encode(pa.array(texts)).tolist() == want and len(lm._encode(pa.array([], pa.string()))) == 0
