"""Token ids of whole texts by a public tokenizer, with a bounded cache in each Python worker."""

from __future__ import annotations

import numpy as np

from tessera.llm.common import U64, mix64
from tessera.llm.shingles import _BASE, _INVERSE, _LETTER, CHUNK, _power

#: Runs (of letters, or of other visible characters) whose ids a worker keeps, about 40 bytes each; a full cache starts anew.
CACHE_RUNS = 700_000
#: Texts with these are encoded one by one: special tokens' marks, contractions, and characters that only some take for white space.
_WHOLE = ("'", "<|", "\x1c", "\x1d", "\x1e", "\x1f")
_SPACE, _LETTERS, _OTHER = 0, 1, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
_CLASS[[c for c in range(256) if chr(c).isalpha()]] = _LETTERS
_workers: dict[str, RunIds] = {}


class RunIds:
    """Ids of runs, found by their hash.

    In Latin-1 texts without apostrophes the tokenizer drops white space and always divides between
    letters and others, so a text's ids are its runs' ids in a row. Other texts go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._empty()

    def _empty(self) -> None:
        self.known, self.start, self.size = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0

    def _learn(self, hashes: np.ndarray, runs: list[str]) -> None:
        made = self.tokenizer.encode(runs, is_pretokenized=True, add_special_tokens=False)
        ids, size = np.array(made.ids, np.uint32), np.bincount(np.array(made.word_ids, np.int64), minlength=len(runs))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat), 2 * len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.start = np.insert(self.start, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.used += len(ids)

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_RUNS:
            self._empty()
        raw = (" ".join(texts) + " ").lower().encode("latin-1")
        data = np.frombuffer(raw, np.uint8)
        cls = _CLASS[data]
        change = np.flatnonzero(np.diff(cls, prepend=np.uint8(_SPACE)))
        ends = np.append(change[1:], len(data))
        shown = cls[change] != _SPACE
        starts, ends = change[shown], ends[shown]
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_LETTER[data] * _power(_BASE, len(data)), out=total[1:])
        h = mix64((total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(U64))
        unique, first, where = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != unique
        if new.any():
            self._learn(unique[new], [raw[starts[k] : ends[k]].decode("latin-1") for k in first[new]])
            at = np.searchsorted(self.known, unique)
        s, n = self.start[at][where], self.size[at][where]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(s - upto[:-1], n) + np.arange(upto[-1])]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        bounds = upto[np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))]
        return [ids[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        part, size = [], 0
        for k, text in enumerate(texts):
            if any(mark in text for mark in _WHOLE) or not (text.isascii() or max(text) <= "\xff"):
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            part.append(k)
            size += len(text)
            if size > CHUNK:
                for i, ids in zip(part, self._chunk([texts[i] for i in part]), strict=True):
                    out[i] = ids
                part, size = [], 0
        if part:
            for i, ids in zip(part, self._chunk([texts[i] for i in part]), strict=True):
                out[i] = ids
        return out


def run_ids(path: str) -> RunIds:
    """This worker's cache for the tokenizer file at path."""
    if path not in _workers:
        _workers[path] = RunIds(path)
    return _workers[path]
