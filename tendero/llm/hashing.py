"""Word and shingle hashes of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
CHUNK_BYTES = 1 << 18  # texts hashed together; keeps the working arrays in the cache
SHORT_SHINGLE = U64(0x9E6C63D0876A9A7B)  # added for the one shingle of a text of fewer words

_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64 bits that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for k, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, factor, U64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte starts of the words of UTF-8 bytes, parted by ASCII white space."""
    return word_spans(data, _BLANK)[:2]


def word_spans(data: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of the words of UTF-8 bytes; ``parting`` marks
    the bytes that stand between words."""
    word = ~parting[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)), starts, ends


def chunks(texts: list[str]) -> Iterator[list[bytes]]:
    out, size = [], 0
    for text in texts:
        data = text.encode()
        if out and size + len(data) > CHUNK_BYTES:
            yield out
            out, size = [], 0
        out.append(data)
        size += len(data) + 1
    if out:
        yield out


def shingle_sets(texts: list[str], words: int = 5) -> Iterator[np.ndarray]:
    """For each text its shingles of ``words`` consecutive words: sorted different
    64-bit hashes. A text of fewer words, but not none, has one shingle of them all."""
    step = U64(_BASE)
    for chunk in chunks(texts):
        data = np.frombuffer(b"\n".join(chunk), np.uint8)
        hashes, starts = word_hashes(data)
        bounds = np.cumsum([len(c) + 1 for c in chunk])
        ends = np.searchsorted(starts, bounds)
        rolled = hashes[: max(0, len(hashes) - words + 1)].copy()
        for k in range(1, words):
            rolled = rolled * step + hashes[k : len(rolled) + k]
        rolled = mix(rolled)
        begin = 0
        for end in ends:
            n = end - begin
            if n >= words:
                yield np.unique(rolled[begin : end - words + 1])
            elif n:
                total = np.array([SHORT_SHINGLE])
                for h in hashes[begin:end]:
                    total = total * step + h
                yield mix(total)
            else:
                yield np.zeros(0, U64)
            begin = end
