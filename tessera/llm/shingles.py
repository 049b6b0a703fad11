"""Sets of hashed word shingles, computed over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessera.llm.common import U64, mix64

WORDS = 5
#: Bytes of text hashed at a time; a longer text is a chunk of its own.
CHUNK = 250_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_STEP = U64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, 2 * CHUNK), base, U64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=U64)
        if len(known) <= 4 * CHUNK:
            _powers[str(base)] = known
    return known[:n]


def _chunk(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    solid = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_LETTER[_LOWER[data]] * _power(_BASE, len(data)), out=total[1:])
    word = mix64((total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(U64))
    bounds = np.searchsorted(starts, np.append(first, len(data)))
    gram = np.zeros(max(0, len(word) - words + 1), U64)
    for j in range(words):
        gram *= _STEP
        gram += word[j : j + len(gram)]
    gram = mix64(gram)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= words:
            out.append(np.unique(gram[lo : hi - words + 1]))
        elif hi > lo:
            h = U64(0)
            with np.errstate(over="ignore"):
                for w in word[lo:hi]:
                    h = h * _STEP + w
                out.append(mix64(np.array([h + U64(hi - lo)], U64)))
        else:
            out.append(np.empty(0, U64))
    return out


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: of `words` lower-cased words each, of all words if there are fewer, none without words."""
    part, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if part and size + len(raw) > CHUNK:
            yield from _chunk(part, words)
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield from _chunk(part, words)
