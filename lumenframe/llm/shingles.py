"""Sets of word n-grams as sorted 64-bit hashes, made with numpy over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once; longer texts are cut at white space, where no word crosses.
PIECE = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word (run of bytes that are no ASCII white space; A-Z as a-z) of ``buf``."""
    word = np.concatenate([[False], ~_SPACE[buf], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(max(len(buf) + 1, PIECE + 1))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[buf] * power[: len(buf)], out=sums[1:])
    # the length goes in as well
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE:
        cut = next((i for i in range(at + PIECE, at, -1) if _SPACE[text[i]]), 0)
        if not cut:  # one word of more than a piece
            cut = next((i for i in range(at + PIECE, len(text)) if _SPACE[text[i]]), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def words_of(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's number, the words' hashes, and the bounds of each text's words."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or b"") < PIECE):
            size += len(texts[last] or b"") + 1
            last += 1
        run = [t or b"" for t in texts[first:last]]
        if size > PIECE + 1:
            words = np.concatenate([word_hashes(np.frombuffer(p, dtype=np.uint8))[0] for p in _pieces(run[0])])
            bounds = np.array([0, len(words)])
        else:
            words, starts = word_hashes(np.frombuffer(b"\n".join(run), dtype=np.uint8))
            offsets = np.cumsum([0, *(len(t) + 1 for t in run)])
            bounds = np.searchsorted(starts, offsets)
        yield first, words, bounds
        first = last


def sets_of(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text; one for a text of 1 to n - 1 words, none without words."""
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1) for k in range(n)]
    for _, words, bounds in words_of(texts):
        k = max(0, len(words) - n + 1)
        rolled = np.zeros(k, dtype=np.uint64)
        for i in range(n):
            rolled += words[i : i + k] * factors[i]
        rolled = mix(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(rolled[a : b - n + 1])
            elif b > a:
                short = np.uint64(b - a) + np.sum(words[a:b] * np.array(factors[: b - a], dtype=np.uint64), dtype=np.uint64)
                yield mix(np.array([short], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
