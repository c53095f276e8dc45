"""Lines that many documents share, found through a sharded minimal perfect hash.

A line counts by its key: without ASCII white space at both ends, A-Z in lower case. Blocks of documents
send the 128-bit hashes of their long enough keys, each with the documents that hold it, to shards by
range of hash. A shard gives each of its distinct keys a number of its own, from 0 without a gap, by a
minimal perfect hash; the numbers index an array of short fingerprints and one of document counts, and
those counted often enough index an array of their last documents. The shards are a table, and
documents probe its arrays: a block sends hashes and gets back those that are repeated. No line is ever
a row of a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivetrace.llm import blocks as B
from drivetrace.llm.common import written

_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Numbers 0 to n-1 for n distinct keys of 128 bits, from a few bits for each of them.

    A level is a bit array twice as long as the keys that reach it. A key that falls on a place alone
    sets its bit and stays; the others go on to the next level. The number of a key is the count of bits
    set before its own.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _place(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((int(_STEP) * (2 * level + 1)) % 2**64)
        return (B.mixed(low + B.mixed(high ^ seed)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray) -> PerfectHash:
        """For distinct keys, given as their lower and upper halves."""
        sizes, words = [], [np.zeros(0, np.uint64)]
        while len(low):
            size = -(-2 * len(low) // 64) * 64
            place = cls._place(low, high, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = ~alone[place]
            low, high = low[rest], high[rest]
        return cls(np.array(sizes, np.int64), np.concatenate(words))

    def number(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where no level holds it; other keys than those it was made of may get any."""
        out = np.full(len(low), -1, np.int64)
        rest = np.arange(len(low))
        for level, size in enumerate(self.sizes.tolist()):
            place = self._place(low[rest], high[rest], level, size) + self.offsets[level]
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[here]] = (self.before[place >> 6] + below)[here]
            rest = rest[~here]
        return out


class Shard:
    """The arrays of one shard: perfect hash, fingerprints, counts, and the last documents of repeated keys."""

    COLUMNS = "sizes binary, bits binary, fingerprints binary, counts binary, last binary"

    def __init__(self, sizes: bytes, bits: bytes, fingerprints: bytes, counts: bytes, last: bytes, least: int):
        self.hash = PerfectHash(np.frombuffer(sizes, np.int64), np.frombuffer(bits, np.uint64))
        self.fingerprints = np.frombuffer(fingerprints, np.uint32)
        self.often = np.frombuffer(counts, np.min_scalar_type(least)) >= least
        self.place = np.cumsum(self.often) - 1
        self.last = np.frombuffer(last, np.int64)

    @staticmethod
    def packed(low: np.ndarray, high: np.ndarray, ids: np.ndarray, least: int) -> tuple[bytes, ...]:
        """The arrays for keys with up to ``least`` of their documents each, the last ones among them."""
        low, high, ids, first = _last_documents(low, high, ids, least)
        counts = np.diff(np.append(first, len(low)))
        low, high, last = low[first], high[first], ids[first]
        numbers = PerfectHash.of(low, high)
        order = np.argsort(numbers.number(low, high))
        often = counts[order] >= least
        return (
            numbers.sizes.tobytes(), numbers.words.tobytes(), high[order].astype(np.uint32).tobytes(),
            counts[order].astype(np.min_scalar_type(least)).tobytes(), last[order][often].tobytes(),
        )

    def repeated(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are repeated, and their last documents."""
        number = self.hash.number(low, high)
        known = number >= 0
        number = np.where(known, number, 0)
        if not len(self.fingerprints):
            return known, np.zeros(0, np.int64)
        hit = known & (self.fingerprints[number] == high.astype(np.uint32)) & self.often[number]
        return hit, self.last[self.place[number[hit]]]


def _last_documents(low, high, ids, most):
    """Distinct keys and documents, of each key the ``most`` largest documents from the last one down, and
    where each key starts."""
    order = np.lexsort((~ids, high, low))
    low, high, ids = low[order], high[order], ids[order]
    new_key = np.ones(len(low), bool)
    new_key[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    new = new_key.copy()
    new[1:] |= ids[1:] != ids[:-1]
    low, high, ids, new_key = low[new], high[new], ids[new], new_key[new]
    first = np.flatnonzero(new_key)
    rank = np.arange(len(low)) - np.repeat(first, np.diff(np.append(first, len(low))))
    kept = rank < most
    return low[kept], high[kept], ids[kept], np.flatnonzero(new_key[kept])


def line_keys(body: bytes, chars: int) -> Iterator[tuple[bytes, bytes | None]]:
    """Each line of a text with the digest of its key, or None where the key is shorter than ``chars``."""
    for line in body.split(b"\n"):
        key = line.strip().lower()
        size = len(key) if len(key) < chars or key.isascii() else len(key.decode())
        yield line, xxhash.xxh3_128_digest(key) if size >= chars else None


def _sent(block: int, pdf: pd.DataFrame, chars: int, most: int, shards: int) -> pd.DataFrame:
    """The keys of a block's documents as one packed row for each shard."""
    digests, ids = [], []
    for i, body in zip(pdf["doc_id"].to_list(), pdf["body"].to_list()):
        own = {d for _, d in line_keys(body, chars) if d is not None}
        digests += own
        ids += [i] * len(own)
    halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    low, high, ids, _ = _last_documents(halves[:, 0], halves[:, 1], np.array(ids, np.int64), most)
    return B.packed_frame(B.packed(block, shards, low, high, ids.view(np.uint64)))


def _probed(packets: pd.DataFrame, shard: Shard) -> pd.DataFrame:
    """For each block the repeated keys among those it sent, with their last documents."""
    out = []
    for block, bucket, keys, data in zip(packets["block"], packets["bucket"], packets["keys"], packets["data"]):
        low, high = np.frombuffer(keys, np.uint64), np.frombuffer(data, np.uint64).reshape(2, -1)[0]
        hit, last = shard.repeated(low, high)
        if hit.any():
            out.append((block, 0, bucket, np.stack([low[hit], high[hit]], 1).tobytes(), last.tobytes()))
    return B.packed_frame(out)


def _kept(pdf: pd.DataFrame, answers: pd.DataFrame, chars: int) -> pd.DataFrame:
    digests, last = b"".join(answers["keys"]), np.frombuffer(b"".join(answers["data"]), np.int64).tolist()
    lasts = {digests[16 * n : 16 * n + 16]: i for n, i in enumerate(last)}
    out = []
    for i, body in zip(pdf["doc_id"].to_list(), pdf["body"].to_list()):
        lines = [(line, lasts.get(digest, i) > i) for line, digest in line_keys(body, chars)]
        kept = [line for line, gone in lines if not gone]
        out.append((i, b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["doc_id", "text", "n_lines", "n_dropped"])


def deduplicated(documents: DataFrame, documents_least: int = 3, chars: int = 20, bytes_each: int = 12 << 20) -> DataFrame:
    """Documents without the lines that ``documents_least`` documents or more share, except in the last of them.

    doc_id, text (the lines that stay, joined by line feeds), n_lines (before dropping), n_dropped; one row
    for each row of ``documents``. Keys of fewer than ``chars`` code points are never dropped. The document
    with the largest doc_id that holds a key keeps all its lines with it. A null or empty text is one empty line.
    A null doc_id counts as larger than every other; rows of one doc_id are one document, so that repeated rows do not
    make a line frequent and share their result. Columns other than doc_id and text are ignored.
    """
    rows, n_blocks = B.dealt(documents, bytes_each)
    shards = max(32, n_blocks // 4)

    def sent(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _sent(key[0], pdf, chars, documents_least, shards)

    def shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.frombuffer(k, np.uint64) for k in pdf["keys"]])
        high, ids = np.concatenate([np.frombuffer(d, np.uint64).reshape(2, -1) for d in pdf["data"]], axis=1)
        return pd.DataFrame([(key[0], *Shard.packed(low, high, ids.view(np.int64), documents_least))], columns=["bucket", *names])

    def probed(packets: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        return _probed(packets, Shard(*arrays[names].iloc[0], documents_least))

    def kept(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _kept(pdf, answers, chars)

    names = [c.split()[0] for c in Shard.COLUMNS.split(", ")]
    parts = rows.groupBy("block")
    packets = written(parts.applyInPandas(sent, B.PACKED), "line-keys").groupBy("bucket")
    index = written(packets.applyInPandas(shard, f"bucket int, {Shard.COLUMNS}"), "line-shards")
    answers = packets.cogroup(index.groupBy("bucket")).applyInPandas(probed, B.PACKED)
    out = parts.cogroup(answers.groupBy("block")).applyInPandas(kept, "doc_id long, text string, n_lines long, n_dropped long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != B.NO_ID, F.col("doc_id")))
