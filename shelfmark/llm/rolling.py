"""Hashes of stretches of bytes and of words, computed over whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: A-Z in lower case and every character of ``[\x20\x09-\x0D]`` as a blank.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Bytes hashed at a time; longer texts are cut at blanks, so that memory does not depend on them.
_PIECE = 1 << 18


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            step = np.full(size, np.uint64(_BASE))
            step[0] = 1
            self.up = np.multiply.accumulate(step)
            step[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
            self.down = np.multiply.accumulate(step)
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Hashes of any stretch of one byte array."""

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = _POWERS.to(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def folded(text: str | bytes | None) -> bytes:
    """UTF-8 of the text after ``LOWER``; null is empty, bytes are folded already."""
    if isinstance(text, bytes):
        return text
    return text.encode("utf-8", "replace").translate(LOWER) if isinstance(text, str) else b""


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word between blanks."""
    a = np.frombuffer(raw, np.uint8)
    word = np.concatenate(([False], a != 32, [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[::2], edges[1::2]
    return mix(Hashed(a).of(start, end) + (end - start).astype(np.uint64)), start


def _pieces(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > _PIECE:
        cut = raw.rfind(b" ", at, at + _PIECE)
        cut = raw.find(b" ", at + _PIECE) if cut < 0 else cut
        if cut < 0:
            break
        yield raw[at:cut]
        at = cut + 1
    yield raw[at:]


def _joined(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h, start = _words(b" ".join(own))
    ends = np.cumsum([len(r) + 1 for r in own])
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


def word_hashes(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of the texts in their order: the 64-bit hashes of all words, and how many of them each text has."""
    own, size = [], 0
    for text in texts:
        raw = folded(text)
        if own and size + len(raw) > _PIECE:
            yield _joined(own)
            own, size = [], 0
        if len(raw) > _PIECE:
            h = np.concatenate([_words(p)[0] for p in _pieces(raw)])
            yield h, np.array([len(h)])
        else:
            own.append(raw)
            size += len(raw) + 1
    if own:
        yield _joined(own)
