"""Texts dealt into blocks of bounded size, and exchanges of packed numbers between them.

A block is the documents that share a hash of their id: one group for a Python function, read as one
byte buffer. What blocks must tell each other (hashes, smallest document ids) is sorted, made unique
within the block and packed into one binary row for each block and bucket, where a bucket is a range
of hashes; answers come back packed for each block. So a key that a third of all documents share is
one entry per block, never one row per document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivetrace.llm.common import block_count, doc_texts

#: Stands for a null doc_id: larger than every other.
NO_ID = 2**63 - 1
#: Bytes hashed at a time; longer documents are cut into overlapping slices. What is computed of a slice stays near a
#: core, and the powers that all slices use take 8 MB in a worker.
SLICE = 1 << 18

_random = np.random.default_rng(20240229)
TABLES = _random.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def dealt(documents: DataFrame, bytes_each: int) -> tuple[DataFrame, int]:
    """Rows block, doc_id, body (UTF-8 bytes), and the number of blocks; null texts are empty."""
    rows = doc_texts(documents)
    n = block_count(rows, bytes_each)
    id_ = F.coalesce("doc_id", F.lit(NO_ID))
    block = F.pmod(F.xxhash64(id_, F.octet_length("text")), F.lit(n)).cast("int")
    return rows.select(block.alias("block"), id_.alias("doc_id"), F.col("text").cast("binary").alias("body")), n


class Buffer:
    """The documents of a block, one after another in order of id and text: bytes, ids, starts, ends."""

    def __init__(self, pdf: pd.DataFrame):
        rows = sorted(zip(pdf.doc_id.to_list(), pdf.body.to_list()))
        self.ids = np.array([i for i, _ in rows], np.int64)
        sizes = np.array([len(b) for _, b in rows], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.bytes = np.frombuffer(b"".join(b for _, b in rows), np.uint8)

    def slices(self, overlap: int, size: int | None = None):
        """Whole documents of about ``size`` bytes together (SLICE, if not given), or overlapping pieces of
        longer ones: first byte, end, and the documents' starts and ends as they fall into the slice."""
        size = size or SLICE
        n, first = len(self.ids), 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + size, "right")))
            lo, hi = int(self.starts[first]), int(self.ends[last - 1])
            if last == first + 1 and hi - lo > size:
                at = lo
                while at + overlap < hi or at == lo:
                    end = min(at + size, hi)
                    yield at, end, self.starts[first:last], self.ends[first:last]
                    at = end - overlap
                    if end == hi:
                        break
            elif hi > lo:
                yield lo, hi, self.starts[first:last], self.ends[first:last]
            first = last

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, "right")


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


_POWERS = [(powers(b, SLICE + 4096), powers(inverse(b), SLICE + 4096)) for b in BASES]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any piece of a slice, from running sums of its bytes."""

    def __init__(self, piece: np.ndarray, which: int):
        self.inverse = _POWERS[which][1]
        self.sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(TABLES[which][piece] * _POWERS[which][0][: len(piece)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each place on."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def windows_hash(rows: np.ndarray, which: int) -> np.ndarray:
    """Hash of each row of a byte matrix."""
    return mixed((TABLES[which][rows] * _POWERS[which][0][: rows.shape[1]]).sum(axis=1, dtype=np.uint64))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    padded = np.full(-(-len(h) // width) * width, np.iinfo(h.dtype).max, h.dtype)
    padded[: len(h)] = h
    tiles = padded.reshape(-1, width)
    before = np.minimum.accumulate(tiles, axis=1).ravel()
    after = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def least_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the least value of each."""
    keys, least, _ = extremes_by_key(keys, values)
    return keys, least


def extremes_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the least and the largest value of each."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, values, values
    return keys[first], np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing) -> np.ndarray:
    """Values at sorted distinct ``keys`` for each of ``wanted``."""
    if not len(keys):
        return np.full(len(wanted), missing, values.dtype)
    order = np.argsort(wanted)  # sorted ones are found several times as fast
    at = np.empty(len(wanted), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, wanted[order]), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash: its upper half says where it falls."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones: zeros of small numbers, and upper bytes of sorted ones,
    stand together and take little room in an exchange."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed(block: int, buckets: int, keys: np.ndarray, *columns: np.ndarray, kind: int = 0, as_bytes=np.ndarray.tobytes) -> list[tuple]:
    """One row for each bucket: block, kind, bucket, keys and columns as bytes. Keys are sorted."""
    edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    return [
        (block, kind, b, as_bytes(keys[lo:hi]), b"".join(as_bytes(c[lo:hi]) for c in columns))
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
        if hi > lo
    ]


PACKED = "block int, kind int, bucket int, keys binary, data binary"


def packed_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "keys", "data"])


def smallest_elsewhere(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers for one bucket of (key, smallest document of the block): for each block the keys whose
    smallest document of all is smaller than its own. Both come and go as ``planes``."""
    keys = [from_planes(k, np.uint64) for k in pdf["keys"]]
    ids = [from_planes(d, np.int64) for d in pdf["data"]]
    all_keys, all_ids = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(all_keys)
    in_order = all_keys[order]
    first = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1]))
    best = np.empty(len(order), np.int64)
    best[order] = np.repeat(np.minimum.reduceat(all_ids[order], first), np.diff(np.append(first, len(order))))
    less = best < all_ids
    out, lo = [], 0
    for block, kind, bucket, k in zip(pdf["block"], pdf["kind"], pdf["bucket"], keys):
        mine, lo = slice(lo, lo + len(k)), lo + len(k)
        if less[mine].any():
            out.append((block, kind, bucket, planes(k[less[mine]]), planes(best[mine][less[mine]])))
    return packed_frame(out)


def those_of(cells: list[np.ndarray], shared: np.ndarray) -> list[np.ndarray]:
    """Of each array the keys that are among sorted ``shared`` ones; all arrays are looked up together."""
    keys = np.concatenate(cells)
    if not len(shared):
        return [k[:0] for k in cells]
    found = shared[np.minimum(np.searchsorted(shared, keys), len(shared) - 1)] == keys
    ends = np.cumsum([len(k) for k in cells])
    return [k[found[end - len(k) : end]] for k, end in zip(cells, ends.tolist())]


def unpacked(pdf: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The answers of one kind of ``smallest_elsewhere`` to a block, by sorted key."""
    pdf = pdf[pdf["kind"] == kind]
    keys = np.concatenate([np.zeros(0, np.uint64), *(from_planes(k, np.uint64) for k in pdf["keys"])])
    ids = np.concatenate([np.zeros(0, np.int64), *(from_planes(d, np.int64) for d in pdf["data"])])
    order = np.argsort(keys)
    return keys[order], ids[order]


def sliced(part, column: str, size: int = 4 << 20):
    """Row ranges of a record batch with about ``size`` bytes of a column of texts; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < part.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield part.slice(lo, hi - lo)
        lo = hi


def marked(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each of ``n`` bytes that a span covers."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
