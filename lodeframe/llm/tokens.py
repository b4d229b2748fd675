"""Whole texts to ids with the tokenizers library, which is called once for each distinct chunk in a worker.

A text is cut only where a tokenizer's own pre-tokenization always cuts, so ids equal those of the whole text:
byte-level tokenizers that keep white space ("spaced") between a character that is no white space and one that is;
tokenizers that drop white space ("bare") at any ASCII white space. Others ("whole") get whole texts.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Chunks kept in a worker before it starts afresh, characters encoded at a time, new chunks in one call.
CHUNKS, STEP, JOIN = 500_000, 1_000_000, 128
FIRST, PLAIN = "\ud800", "\ud801"  # marks no text can hold
CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def kind(path: str) -> str:
    """"spaced", "bare" or "whole", from the tokenizer file."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    pre, norm = made.get("pre_tokenizer") or {}, made.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
        return "spaced"
    steps = pre.get("pretokenizers") or []
    if pre.get("type") == "Sequence" and steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
        pattern = (steps[0].get("pattern") or {}).get("Regex", r"\s")
        if r"[^\s" in pattern and not re.search(r"(?<!\[\^)\\s|\.|(?<!\[)\^|\\[A-Z]", pattern):  # no match holds white space
            return "bare"
    return "whole"


class Encoder:
    def __init__(self, path: str, chunks: int = CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.kind, self.chunks = Tokenizer.from_file(path), kind(path), chunks
        self.clear()

    def clear(self) -> None:
        self.code: dict = {}
        self.start, self.count, self.flat = array("q"), array("q"), array("I")

    def _raw(self, piece) -> str | None:
        """The text of a chunk; None if the text holding it can't be cut there."""
        if self.kind == "bare":
            return piece.decode()
        if piece[:1] == PLAIN:
            return piece[1:]
        if piece == FIRST:
            return ""
        if not piece or piece[-1].isspace():
            return None
        return piece[1:] if piece[0] == FIRST else piece if piece[0] == "\n" else " " + piece

    def _learn(self, pieces: set) -> None:
        """Ids of chunks not met before: many at a time in one call, told apart by the offsets of their tokens."""
        known, texts, alone, rest = [], [], [], []
        bare = self.kind == "bare"
        for p in pieces:
            if (t := self._raw(p)) is None:
                self.code[p] = -1
            elif bare or p[0] < FIRST:
                known.append(p)
                texts.append(t)
            else:
                alone.append(p)
                rest.append(t)
        for at in range(0, len(known), JOIN * 64):
            groups = [texts[i : i + JOIN] for i in range(at, min(at + JOIN * 64, len(known)), JOIN)]
            done = self.tok.encode_batch([(" " if bare else "").join(g) for g in groups], add_special_tokens=False)
            for g, e in zip(groups, done, strict=True):
                starts = np.cumsum([0] + [len(t) + bare for t in g[:-1]])
                first = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
                self._add(np.bincount(np.searchsorted(starts, first, side="right") - 1, minlength=len(g)), e.ids)
        self.code.update(zip(known, range(len(self.start) - len(known), len(self.start)), strict=True))
        for p, e in zip(alone, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.code[p] = len(self.start)
            self._add(np.array([len(e.ids)]), e.ids)

    def _add(self, counts: np.ndarray, ids: list[int]) -> None:
        self.start.frombytes((len(self.flat) + np.cumsum(counts) - counts).astype(np.int64).tobytes())
        self.count.frombytes(counts.astype(np.int64).tobytes())
        self.flat.extend(ids)

    def _pieces(self, text: str) -> list:
        if self.kind == "bare":
            return text.encode().split()
        if self.kind == "whole":
            return [PLAIN + text]
        out = text.replace("\n", " \n").split(" ")
        out[0] = FIRST + out[0]
        return out

    def _codes(self, pieces: list) -> np.ndarray:
        got = np.fromiter(map(self.code.get, pieces, repeat(-2)), np.int64, len(pieces))
        if len(miss := np.flatnonzero(got == -2)):  # looked up once where known; only what is new is gathered and asked again
            new = [pieces[i] for i in miss.tolist()]
            self._learn(set(new))
            got[miss] = np.fromiter(map(self.code.__getitem__, new), np.int64, len(new))
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, uint32."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and (end == at or n + len(texts[end]) <= STEP):
                n += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.code) > self.chunks:
            self.clear()
        flat: list = []
        counts = []
        for t in texts:
            p = self._pieces(t)
            counts.append(len(p))
            flat += p
        codes = self._codes(flat)
        if (codes < 0).any():  # some text has white space next to white space: cut it with care
            ends = np.cumsum(counts)
            parts = np.split(codes, ends[:-1])
            for k, c in enumerate(parts):
                if (c < 0).any():
                    parts[k] = self._codes([PLAIN + x for x in CUT.split(texts[k])])
            counts, codes = [len(c) for c in parts], np.concatenate(parts)
        start, count = np.frombuffer(self.start, np.int64), np.frombuffer(self.count, np.int64)
        ids = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.empty(0, np.uint32)
        n = count[codes]
        ends = np.cumsum(n)
        at = np.repeat(start[codes] - (ends - n), n)
        got = ids[at + np.arange(len(at))]
        del start, count, ids  # the arrays can't grow while views of them are held
        piece_ends = np.cumsum(counts)
        total = np.concatenate([[0], ends])[piece_ends]
        return np.split(got, total[:-1])


@lru_cache(maxsize=2)
def encoder(path: str, chunks: int = CHUNKS) -> Encoder:
    """The worker's encoder for a file; kept until ``forget``, or as long as the worker lives."""
    return Encoder(path, chunks)


def forget() -> None:
    """Drops the worker's encoders and hands free memory back: a worker that lives on in other stages has no use for them."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass
