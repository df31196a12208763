"""Links between hashes that lie in runs, in numpy: not all pairs at a distance of at most t, but those that join what was apart."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A tile, of a multiple of eight comparisons, stays in the processor's cache. After ``STEP`` rows it is asked again which component is the largest.
ROWS, COLUMNS, STEP = 32, 4096, 256


def links_of_runs(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    """``src, dst`` from sorted rows ``..., lo, hi, side, h, label``, of which those equal up to ``hi`` are a run; it may go on in the next batch.

    Where ``lo`` and ``hi`` are equal all hashes of a run are compared, else those of side 0 with those of side 1.
    """
    rest = None
    for batch in itertools.chain(batches, [None]):
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns] if batch else None
        rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)] if rest and rows else rows or rest
        if not rows or not len(rows[0]):
            continue
        *keys, side, h, label = rows
        new = np.zeros(len(h) - 1, bool)
        for key in keys:
            new |= key[1:] != key[:-1]
        ends = np.concatenate([[0], np.flatnonzero(new) + 1, [] if batch else [len(h)]]).astype(int)
        rest = [x[ends[-1] :] for x in rows]
        h, one, found = h.astype(np.int64).view(np.uint64), keys[-1] == keys[-2], []
        for at in np.flatnonzero(np.diff(ends) > 1):
            i, j = ends[at], ends[at + 1]
            cut = j if one[i] else i + np.count_nonzero(side[i:j] == 0)
            found += links(h[i:cut], h[i:j] if one[i] else h[cut:j], label[i:j], t, bool(one[i]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["src", "dst"])
        pa.default_memory_pool().release_unused()


def links(a: np.ndarray, b: np.ndarray, label: np.ndarray, t: int, own: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between labels of near hashes of ``a`` and ``b``, fewer than there are labels; ``own``: both are the same hashes.

    Labels are of ``a``, then of ``b`` where it is another. Hashes of the largest component are not compared with each other.
    """
    if not len(a) or not len(b):
        return []
    names, at = np.unique(label, return_inverse=True)
    now, found = at.copy(), []
    first = 0 if own else len(a)
    for i in range(0, len(a), STEP):
        largest = np.bincount(now).argmax()
        inside = now[i : min(i + STEP, len(a))] == largest
        begin = i if own else 0  # of a run's own hashes, earlier ones have met all
        others = begin + np.flatnonzero(now[first + begin : first + len(b)] != largest)
        for rows, columns in ((i + np.flatnonzero(~inside), np.arange(begin, len(b))), (i + np.flatnonzero(inside), others)):
            for x, y in _near(a, b, rows, columns, t):
                y = y + first
                apart = now[x] != now[y]
                if not apart.any():
                    continue
                x, y = x[apart], y[apart]
                kept, root = _joined(now[x], now[y], len(names))
                now = root[now]
                found.append((names[at[x[kept]]], names[at[y[kept]]]))
    return found


def _near(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of near hashes, for ``ROWS`` of a at a time."""
    met, far, count, near = b[columns], np.empty(ROWS * COLUMNS, np.uint64), np.empty(ROWS * COLUMNS, np.uint8), np.empty(ROWS * COLUMNS, bool)
    for i in range(0, len(rows), ROWS):
        part, found = a[rows[i : i + ROWS], None], []
        for j in range(0, len(columns), COLUMNS):
            tile = met[None, j : j + COLUMNS]
            shape = len(part), tile.shape[1]
            size = shape[0] * shape[1]
            np.bitwise_xor(part, tile, out=far[:size].reshape(shape))
            np.bitwise_count(far[:size], out=count[:size])
            np.less_equal(count[:size], t, out=near[:size])
            near[size : -(-size // 8) * 8] = False
            words = np.flatnonzero(near[: -(-size // 8) * 8].view(np.uint64))  # of eight answers each, few of them not 0
            if len(words):
                word, place = np.nonzero(near.reshape(-1, 8)[words])
                x, y = np.divmod(words[word] * 8 + place, shape[1])
                found.append((rows[i + x], columns[j + y]))
        if found:
            yield tuple(map(np.concatenate, zip(*found, strict=True)))


def _joined(x: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of labels to keep so that all pairs follow, and the label that each of ``size`` labels has then."""
    kept, root, places = [], np.arange(size), np.arange(len(x))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        hooked, first = np.unique(high, return_index=True)  # a larger label goes to a smaller one, so there is no circle
        step = np.arange(size)
        step[hooked] = low[first]
        while not np.array_equal(step, further := step[step]):
            step = further
        kept.append(places[first])
        root, x, y = step[root], step[x], step[y]
        left = x != y
        x, y, places = x[left], y[left], places[left]
    return np.concatenate(kept), root
