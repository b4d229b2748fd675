"""Personal data by weak supervision.

Base detectors find the four plain kinds. Beyond them, candidate spans of looser kinds (credentials, local phone
numbers, disguised addresses) are described by labelers: patterns, gazetteers and contexts that vote yes, no or
nothing. The votes of every candidate in the corpus are counted by pattern, a table that stays small at any size;
expectation-maximisation on it estimates how reliable each labeler is and how likely each pattern is a hit (Dawid &
Skene 1979; Ratner et al. 2017), and these soft labels train a logistic span classifier over votes and shape. A
second pass scores each candidate with it. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "local_phone", "disguised_email")
KINDS = BASE + ADDED
CUT = 0.5
TRUST, RIGHT = 20.0, 0.8  # votes a labeler is given in advance, and the share of them that is right

HINT = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates of the added kinds.
TOKEN = re.compile(r"[A-Za-z0-9_+/-]{12,}")
CAPITALS = re.compile(r"(?<![A-Z0-9])[A-Z0-9]{16,}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9+).-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
DISGUISED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{1,63}){1,4}")

# Gazetteers.
CREDENTIAL_WORDS = re.compile(r"pass(?:word|wd|phrase)|token|secret|api|key|credential|auth", re.I)
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "AIza")
CALL_WORDS = re.compile(r"call|phone|tel|mobile|fax|contact|whatsapp", re.I)
OTHER_NUMBER_WORDS = re.compile(r"version|isbn|invoice|order|ref|no\.|\$|€|page", re.I)
MAIL_WORDS = re.compile(r"mail|contact|write|reach|address", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, in order of start, then kind."""
    if not HINT.search(text):
        return []
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # what stands before an @ can't hold one, so the leftmost match starts where its run starts
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append(("email", start, last))
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return ordered(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]  # of each labeler: 1 yes, -1 no, 0 nothing
    shape: tuple[int, ...]

    def key(self) -> str:
        return f"{self.kind}|{','.join(map(str, self.votes))}|{','.join(map(str, self.shape))}"


def _secret(text: str, s: int, e: int) -> Candidate:
    x, before = text[s:e], text[max(0, s - 24) : s]
    letters = sum(c.isalpha() for c in x)
    digits = len(x) - letters
    vowels = sum(c in "aeiouAEIOU" for c in x)
    votes = (
        1 if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", x) and letters and digits else 0,
        1 if x.startswith(KEY_PREFIXES) else 0,
        1 if CREDENTIAL_WORDS.search(before) else 0,
        1 if re.search(r"[=:]\s?[\"']?$", before) else 0,
        1 if digits >= 4 and letters >= 2 else -1 if digits == 0 else 0,
        -1 if vowels * 10 >= letters * 3 and digits <= 2 else 0,
        -1 if "-" in x and all(p.isalpha() or p.isdigit() for p in x.split("-") if p) else 0,
    )
    return Candidate("secret", s, e, votes, (min(3, len(x) // 12), min(3, 4 * digits // len(x)), int(x.isupper())))


def _phone(text: str, s: int, e: int) -> Candidate:
    before, d = text[max(0, s - 24) : s], _digits(text[s:e])
    votes = (
        1 if text[s] == "(" or text[s:e].count("-") == 2 else 0,
        1 if CALL_WORDS.search(before) else 0,
        -1 if OTHER_NUMBER_WORDS.search(before) else 0,
        -1 if d[0] in "01" or len(set(d)) < 3 else 0,
    )
    return Candidate("local_phone", s, e, votes, (int("." in text[s:e]),))


def _mail(text: str, s: int, e: int) -> Candidate:
    x = text[s:e]
    votes = (
        1 if re.search(r"[\[(] ?(?:dot|DOT)", x) else 0,
        1 if MAIL_WORDS.search(text[max(0, s - 24) : s]) else 0,
        1 if re.search(r"(?:com|org|net|edu|gov|io|de|fr|es)$", x) else -1,
    )
    return Candidate("disguised_email", s, e, votes, (int(any(c.isdigit() for c in x)),))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[Candidate]:
    """Spans of the added kinds that meet no base span, leftmost first."""
    found: list[Candidate] = []
    if HINT.search(text):
        for m in TOKEN.finditer(text):
            if any("0" <= c <= "9" for c in m[0]) and any(c.isalpha() for c in m[0]):
                found.append(_secret(text, m.start(), m.end()))
        found += [_phone(text, m.start(), m.end()) for m in NATIONAL.finditer(text)]
    found += [_secret(text, m.start(), m.end()) for m in CAPITALS.finditer(text) if not any("0" <= c <= "9" for c in m[0])]
    if "(at" in text or "[at" in text or "( at" in text or "[ at" in text or "(AT" in text or "[AT" in text:
        found += [_mail(text, m.start(), m.end()) for m in DISGUISED.finditer(text)]
    out: list[Candidate] = []
    held = 0
    for c in sorted(found, key=lambda c: (c.start, -c.end, c.kind)):
        if c.start >= held and not any(s < c.end and c.start < e for _, s, e in base):
            out.append(c)
            held = c.end
    return out


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    reliability: dict[str, list[tuple[float, float]]]

    def probability(self, c: Candidate) -> float:
        w = self.weights.get(c.kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-np.clip(_features(c.votes, c.shape) @ w, -30, 30))))

    def spans(self, text: str, cut: float = CUT) -> tuple[list, list]:
        """(base spans, all spans) of one text."""
        base = base_spans(text)
        more = [(c.kind, c.start, c.end) for c in candidates(text, base) if self.probability(c) >= cut]
        return base, ordered(base + more)


def _features(votes: tuple[int, ...], shape: tuple[int, ...]) -> np.ndarray:
    return np.array([1.0, *(v == 1 for v in votes), *(v == -1 for v in votes), *(s / 3 for s in shape)])


def em(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Posterior of each vote pattern and, per labeler, P(yes | hit) and P(no | miss) among its votes.

    Starts from the sum of votes. Each labeler's table of P(vote | hit or miss) has a prior of TRUST votes, most of them
    right; votes beyond them decide, so a labeler that votes against the others loses its weight or has it turned.
    Saying nothing counts for neither.
    """
    q = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1) - 0.5 * (votes > 0).any(axis=1) + 0.25))
    said = [[votes[:, j] == v for v in (-1, 1)] for j in range(votes.shape[1])]
    tables = []
    for _ in range(rounds):
        prior = (counts @ q + 1) / (counts.sum() + 2)
        log = np.log(prior) - np.log(1 - prior) + np.zeros(len(q))
        tables = []
        for no, yes in said:
            hit = np.array([counts @ (q * no) + TRUST * (1 - RIGHT), counts @ (q * yes) + TRUST * RIGHT]) / (counts @ q + TRUST)
            miss = np.array([counts @ ((1 - q) * no) + TRUST * RIGHT, counts @ ((1 - q) * yes) + TRUST * (1 - RIGHT)]) / (counts @ (1 - q) + TRUST)
            tables.append((hit, miss))
            log += np.where(no, np.log(hit[0] / miss[0]), 0.0) + np.where(yes, np.log(hit[1] / miss[1]), 0.0)
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        done = np.abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    return q, [(float(hit[1] / hit.sum()), float(miss[0] / miss.sum())) for hit, miss in tables]


def train(patterns: dict[str, int]) -> Model:
    """A model from the number of candidates of each pattern (``Candidate.key``)."""
    weights, reliability = {}, {}
    for kind in ADDED:
        mine = sorted((k.split("|")[1:], n) for k, n in patterns.items() if k.startswith(kind + "|"))
        if not mine:
            continue
        votes = np.array([[int(v) for v in k[0].split(",")] for k, _ in mine])
        shapes = [tuple(int(v) for v in k[1].split(",")) for k, _ in mine]
        counts = np.array([n for _, n in mine], dtype=float)
        q, reliability[kind] = em(votes, counts)
        x = np.array([_features(tuple(v), s) for v, s in zip(votes.tolist(), shapes, strict=True)])
        c = counts / counts.sum() * min(counts.sum(), 1000.0)
        w = np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (c * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (c * (q - p)) - 0.1 * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        weights[kind] = w
    return Model(weights, reliability)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for t in b.column(0):
            text = t.as_py() or ""
            seen.update(c.key() for c in candidates(text, base_spans(text)))
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["key", "n"])


def fit(docs: DataFrame) -> Model:
    """The model of all candidates of all rows; only the counts of patterns, a bounded number, reach the driver."""
    found = docs.select("text").mapInArrow(_patterns, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return train({r["key"]: r["n"] for r in found.collect()})


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """Counts of the base kinds, the digest of base spans and all spans of every row.

    A null text is empty and has no spans. Repeated rows and null ids are ordinary rows; columns besides doc_id and
    text aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1):
                base, every = model.spans(t.as_py() or "")
                n = Counter(k for k, _, _ in base)
                for c, v in zip(cols, (*(n[k] for k in BASE), hashlib.sha256(line(base).encode()).hexdigest(), line(every)), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def masked(text: str | None, model: Model) -> str | None:
    """``text`` with each found stretch replaced by its kind in brackets; spans that meet are one stretch."""
    if not text:
        return text
    out, at, held = [], 0, None
    for k, s, e in model.spans(text)[1]:
        if held and s < held[2]:
            held = (held[0], held[1], max(e, held[2]))
            continue
        if held:
            out += [text[at : held[1]], f"[{held[0].upper()}]"]
            at = held[2]
        held = (k, s, e)
    if held:
        out += [text[at : held[1]], f"[{held[0].upper()}]"]
        at = held[2]
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with masked texts; n_chars, if there, is counted anew for texts that changed. Other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):  # few texts at a time
            at = b.schema.get_field_index("text")
            old = b.column(at).to_pylist()
            new = [masked(t, model) for t in old]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if (k := b.schema.get_field_index("n_chars")) >= 0:
                n = [len(y) if x != y else v for x, y, v in zip(old, new, b.column(k).to_pylist(), strict=True)]
                b = b.set_column(k, b.schema.field(k), pa.array(n, b.schema.field(k).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
