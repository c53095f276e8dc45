"""Hashes of word shingles, many texts at a time.

Words are what white space (ASCII) separates. A text of fewer words than a shingle has one shingle of
all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from drivetrace.llm import blocks as B

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = B.powers(np.uint64(0xA0761D6478BD642F), 64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word, piece by piece for long data."""
    hashes, places, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while lo < len(data):
        hi = min(lo + B.SLICE, len(data))
        if hi < len(data):
            gaps = np.flatnonzero(_SPACE[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:  # a word longer than a piece
                while hi < len(data) and not _SPACE[data[hi]]:
                    hi += 1
        space = _SPACE[data[lo:hi]]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if hi - lo > B.SLICE:
            long_ = [B.mixed(B.windows_hash(_folded(data[lo + s : lo + e]), 0)) for s, e in zip(start, end)]
            hashes.append(np.concatenate(long_))
        else:
            hashes.append(B.Hashes(data[lo:hi], 0).of(start, end))
        places.append(start + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(places)


def _folded(word: np.ndarray) -> np.ndarray:
    """A very long word as one row of fixed width, by hashes of its pieces."""
    while len(word) > B.SLICE:
        rows = np.zeros(-(-len(word) // 4096) * 4096, np.uint8)
        rows[: len(word)] = word
        word = B.windows_hash(rows.reshape(-1, 4096), 1).view(np.uint8)
    return word.reshape(1, -1)


def shingled(bodies: list[bytes], words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Batches of texts: the first one's number, shingle hashes of all (with repeats), and their offsets."""
    first = 0
    while first < len(bodies):
        last, size = first, 0
        while last < len(bodies) and (last == first or size + len(bodies[last]) < B.SLICE // 2):
            size += len(bodies[last]) + 1
            last += 1
        data = np.frombuffer(b" ".join(bodies[first:last]), np.uint8)
        starts = np.cumsum([0] + [len(b) + 1 for b in bodies[first:last]])
        hashes, places = word_hashes(data)
        from_ = np.searchsorted(places, starts)
        counts = np.diff(from_)
        full = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            full += hashes[k : k + len(full)] * _PLACE[k]
        out = []
        for at, n in zip(from_.tolist(), counts.tolist()):
            if n >= words:
                out.append(full[at : at + n - words + 1])
            elif n:
                out.append(np.array([(hashes[at : at + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)]))
            else:
                out.append(full[:0])
        sizes = np.array([len(o) for o in out])
        yield first, B.mixed(np.concatenate(out)), np.concatenate([[0], np.cumsum(sizes)])
        first = last
