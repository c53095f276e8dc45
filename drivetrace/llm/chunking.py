"""Substring deduplication with content-defined chunks.

A gear hash rolls over the bytes of a text: shift by one bit and add a random number of the byte, so
that it depends on the last 32 bytes. A chunk ends where the hash is larger than at the ``reach`` bytes
before and not smaller than at the ``reach`` bytes after. That depends on the bytes around the place
alone: an insertion moves the ends next to it and leaves all others, and chunks are longer than
``reach``. Chunks are compared by a 128-bit digest; the first one by document and place stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivetrace.llm import blocks as B
from drivetrace.llm.suffix import DESCRIBED, described

GEAR = (B.TABLES[0] >> np.uint64(32)).astype(np.uint32)
ROLL = 32


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, over it and the 31 before it."""
    h, span = GEAR[data], 1
    while span < ROLL:
        rest = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += rest
        span *= 2
    return h


def cuts(data: np.ndarray, reach: int) -> np.ndarray:
    """Ends of chunks inside ``data``; its own end is not among them."""
    if len(data) < 2 * reach + 1:
        return np.zeros(0, np.int64)
    h = ~gear(data)  # least instead of largest
    least = B.sliding_least(h, reach)
    at = np.arange(reach, len(h) - reach)
    here = h[at]
    return at[(here < least[at - reach]) & (here <= least[at + 1])] + 1


class Chunks:
    """The chunks of a block's documents: start, end, digest in two parts."""

    def __init__(self, buffer: B.Buffer, reach: int):
        # Each end depends on this many bytes before it and after it.
        before, after = ROLL + reach, reach + 1
        ends = [buffer.ends]
        for lo, hi, starts, stops in buffer.slices(before + after):
            for a, z in zip(np.maximum(starts, lo), np.minimum(stops, hi)):
                if a == z:
                    continue
                found = cuts(buffer.bytes[a:z], reach) + a
                i = buffer.document_of(np.array([a]))[0]
                whole_start, whole_end = a == buffer.starts[i], z == buffer.ends[i]
                found = found[(found > a + before) | whole_start]
                ends.append(found[(found <= z - after) | whole_end])
        self.ends = np.unique(np.concatenate(ends))
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        kept = self.ends > self.starts
        self.starts, self.ends = self.starts[kept], self.ends[kept]
        self.ids = buffer.ids[buffer.document_of(self.starts)] if len(self.starts) else np.zeros(0, np.int64)
        sizes = self.ends - self.starts
        parts = []
        for which in (0, 1):
            mixed = np.zeros(len(sizes), np.uint64)
            table, powers = B.TABLES[which], B._POWERS[which][0]
            for k in range(0, len(sizes), 4096):
                lo, hi = self.starts[k : k + 4096], self.ends[k : k + 4096]
                if not len(lo):
                    continue
                piece = buffer.bytes[lo[0] : hi[-1]]
                places = np.arange(len(piece)) - np.repeat(lo - lo[0], hi - lo)
                values = table[piece] * powers[places % len(powers)]
                mixed[k : k + 4096] = np.add.reduceat(values, lo - lo[0])
            parts.append(B.mixed(mixed + sizes.astype(np.uint64)))
        self.digest, self.check = parts


def _first(digest, check, ids, starts):
    """Sorted distinct chunks with the first document and place of each."""
    order = np.lexsort((starts, ids, check, digest))
    d, c = digest[order], check[order]
    first = np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])]) if len(d) else np.zeros(0, bool)
    return order[first], order, np.cumsum(first) - 1


def among(keys: np.ndarray, checks: np.ndarray, other_keys: np.ndarray, other_checks: np.ndarray) -> np.ndarray:
    """Which pairs of key and check are among other pairs."""
    order = np.argsort(other_keys, kind="stable")
    other_keys, other_checks = np.append(other_keys[order], np.uint64(0)), np.append(other_checks[order], np.uint64(0))
    n, found = len(order), np.zeros(len(keys), bool)
    at = np.searchsorted(other_keys[:n], keys)
    while True:  # once for each check that shares a key
        here = (at < n) & (other_keys[np.minimum(at, n)] == keys)
        if not here.any():
            return found
        found |= here & (other_checks[np.minimum(at, n)] == checks)
        at = at + 1


def deduplicated(documents: DataFrame, reach: int = 24, bytes_each: int = 12 << 20) -> DataFrame:
    """What each document keeps once chunks that came before are removed.

    Of equal chunks the first stays: the one in the smallest doc_id, there the first place. Chunks
    inside a text are longer than ``reach`` bytes; a shorter text is a single chunk. One row per row of
    ``documents``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans (first byte and end of each, flat), n_chunks, n_repeated. A null text is empty; a
    null doc_id counts as larger than every other; equal rows of one doc_id are told apart by their
    order. Other columns are ignored.
    """
    rows, n_blocks = B.dealt(documents, bytes_each)
    buckets = max(8, n_blocks // 4)

    def chunks_of(pdf):
        buffer = B.Buffer(pdf)
        chunks = Chunks(buffer, reach)
        place = chunks.starts - buffer.starts[buffer.document_of(chunks.starts)] if len(chunks.starts) else chunks.starts
        return buffer, chunks, place

    def digests(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, chunks, place = chunks_of(pdf)
        at, _, _ = _first(chunks.digest, chunks.check, chunks.ids, place)
        return B.packed_frame(B.packed(key[0], buckets, chunks.digest[at], chunks.check[at], chunks.ids[at].view(np.uint64), place[at].view(np.uint64)))

    def earlier(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint64) for k in pdf["keys"]]
        data = [np.frombuffer(d, np.uint64).reshape(3, -1) for d in pdf["data"]]
        key, (check, ids, place) = np.concatenate(keys), np.concatenate(data, axis=1)
        ids, place = ids.view(np.int64), place.view(np.int64)
        first, order, group = _first(key, check, ids, place)
        best = np.empty(len(key), np.int64)
        best[order] = first[group]
        lost = (ids[best] < ids) | ((ids[best] == ids) & (place[best] < place))
        out, at = [], 0
        for block, bucket, k in zip(pdf["block"], pdf["bucket"], keys):
            mine = np.flatnonzero(lost[at : at + len(k)]) + at
            if len(mine):
                out.append((block, 0, bucket, key[mine].tobytes(), check[mine].tobytes()))
            at += len(k)
        return B.packed_frame(out)

    def kept(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_chunks", "n_repeated"])
        buffer, chunks, place = chunks_of(pdf)
        first, _, _ = _first(chunks.digest, chunks.check, chunks.ids, place)
        gone = np.ones(len(chunks.starts), bool)
        elsewhere = [np.frombuffer(b"".join(answers[c]), np.uint64) for c in ("keys", "data")]
        gone[first] = among(chunks.digest[first], chunks.check[first], *elsewhere)
        out = described(buffer, B.marked(len(buffer.bytes), chunks.starts[gone], chunks.ends[gone]))
        n = len(buffer.ids)
        out["n_chunks"] = np.bincount(buffer.document_of(chunks.starts), minlength=n)
        out["n_repeated"] = np.bincount(buffer.document_of(chunks.starts[gone]), minlength=n)
        return out

    parts = rows.groupBy("block")
    answers = parts.applyInPandas(digests, B.PACKED).groupBy("bucket").applyInPandas(earlier, B.PACKED)
    last = parts.cogroup(answers.groupBy("block")).applyInPandas(kept, f"{DESCRIBED}, n_chunks long, n_repeated long")
    return last.withColumn("doc_id", F.when(F.col("doc_id") != B.NO_ID, F.col("doc_id")))
