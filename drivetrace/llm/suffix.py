"""Repeated byte strings of a fixed length, by a depth-limited radix sort of suffixes.

All suffixes are sorted by their first ``width`` bytes only, in passes from the most significant digit
on; a group that holds one document after a pass ends there, and the groups that are still equal after
the last pass are exactly the repeated strings. The digits are chosen so that little has to move:

1. the least hash of all 24-byte pieces of the string: equal strings have an equal first digit.
   Neighbouring suffixes mostly share it, so a *run* of them is sorted as one;
2. the bytes that a whole run covers. In an equal group all strings repeat, and every document but
   the smallest is done; if the first digit has no other run, so is the smallest;
3. for what remains, runs of the smallest documents that differ only in part, the string itself.

Every pass deals its digits to buckets by value, as packed numbers of each block of documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivetrace.llm import blocks as B

PIECE, LONGEST_RUN = 24, 256
#: Bytes looked at together: what is computed of them stays in a core's cache.
TOGETHER = 1 << 17


class Runs:
    """Runs of suffixes of a block with an equal first digit: first and last start, digit, bytes' hash."""

    def __init__(self, buffer: B.Buffer, width: int):
        piece = min(PIECE, width)
        parts = []
        for lo, hi, starts, ends in buffer.slices(width - 1, TOGETHER):
            if hi - lo < width:
                continue
            data = buffer.bytes[lo:hi]
            first, second = B.Hashes(data, 0), B.Hashes(data, 1)
            digit = B.sliding_least(first.every(piece), width - piece + 1)
            place = np.arange(lo, hi - width + 1)
            inside = np.ones(len(place), bool)
            for end in ends:
                if end < hi:
                    inside[max(0, end - width + 1 - lo) : max(0, end - lo)] = False
            change = np.concatenate([[True], (digit[1:] != digit[:-1]) | (inside[1:] != inside[:-1])])
            for start in starts:
                if lo <= start < hi - width + 1:
                    change[start - lo] = True
            from_ = np.flatnonzero(change)
            sizes = np.diff(np.append(from_, len(place)))
            if sizes.max() > LONGEST_RUN:
                more = [np.arange(f, f + s, LONGEST_RUN) for f, s in zip(from_[sizes > LONGEST_RUN], sizes[sizes > LONGEST_RUN])]
                from_ = np.unique(np.concatenate([from_, *more]))
                sizes = np.diff(np.append(from_, len(place)))
            kept = inside[from_]
            from_, to = from_[kept], (from_ + sizes)[kept] - 1
            whole = second.of(from_, to + width) ^ (first.of(from_, to + width) * np.uint64(3))
            # Least hashes are small numbers; mixed, they fall evenly into buckets.
            parts.append((from_ + lo, to + lo, B.mixed(digit[from_]), whole))
        arrays = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
        self.first, self.last, self.digit, self.whole = arrays
        self.ids = buffer.ids[buffer.document_of(self.first)] if len(self.first) else np.zeros(0, np.int64)


def _shared_in_block(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and whether documents with different ids hold them."""
    keys, least, most = B.extremes_by_key(keys, ids)
    return keys, least != most


def digits_elsewhere(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers for one bucket of (digits of one document of the block, digits of several): for each block the digits
    that more than one document of all holds."""
    once = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
    many = [np.frombuffer(d, np.uint32) for d in pdf["data"]]
    values = np.sort(np.concatenate(once))
    shared = np.unique(np.concatenate([values[1:][values[1:] == values[:-1]], *many]))
    cells = zip(pdf["block"], pdf["bucket"], B.those_of(once, shared), many)
    own = [(block, bucket, o.tobytes() + m.tobytes()) for block, bucket, o, m in cells]
    return B.packed_frame([(block, 0, bucket, keys, b"") for block, bucket, keys in own if keys])


def runs_elsewhere(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers for one bucket of (digits, the hash of the one run of each of the first of them): for each block the
    digits that have more than one run."""
    keys = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
    runs = [np.frombuffer(d, np.uint64) for d in pdf["data"]]
    single = np.concatenate([k[: len(r)] for k, r in zip(keys, runs)])
    digit, lowest, highest = B.extremes_by_key(single, np.concatenate(runs))
    differ = np.unique(np.concatenate([digit[lowest != highest], *(k[len(r) :] for k, r in zip(keys, runs))]))
    own = zip(pdf["block"], pdf["bucket"], B.those_of(keys, differ))
    return B.packed_frame([(block, 1, bucket, k.tobytes(), b"") for block, bucket, k in own if len(k)])


def _windows(buffer: B.Buffer, runs: Runs, chosen: np.ndarray, width: int):
    """The single strings of some runs: start, id of the document, hash."""
    sizes = runs.last[chosen] - runs.first[chosen] + 1
    starts = np.repeat(runs.first[chosen] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes, sizes) + np.arange(sizes.sum())
    hashes = np.zeros(len(starts), np.uint64)
    for lo, hi, _, _ in buffer.slices(width - 1, TOGETHER):
        a, z = np.searchsorted(starts, [lo, hi - width + 1])
        if z > a:
            data, at = buffer.bytes[lo:hi], starts[a:z] - lo
            hashes[a:z] = B.Hashes(data, 1).every(width)[at] ^ (B.Hashes(data, 0).every(width)[at] * np.uint64(3))
    return starts, np.repeat(runs.ids[chosen], sizes), hashes


def repeated(documents: DataFrame, width: int = 50, bytes_each: int = 5 << 20) -> DataFrame:
    """What each document keeps once repeated strings are removed.

    Every byte goes that is covered by a string of ``width`` bytes which also starts in a document with
    a smaller doc_id; strings are judged on the input, overlaps count, and no string crosses documents.
    One row per row of ``documents``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, spans (first byte and end of each, flat). A null text is empty. A null doc_id counts as larger than
    every other; rows of one doc_id do not remove from each other. Columns other than doc_id and text
    are ignored.
    """
    rows, n_blocks = B.dealt(documents, bytes_each)
    buckets = max(8, n_blocks // 8)
    half = np.uint64(0xFFFFFFFF)

    def digits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        runs = Runs(B.Buffer(pdf), width)
        keys, many = _shared_in_block(runs.digit, runs.ids)
        edges = np.searchsorted(B.bucket_of(keys, buckets), np.arange(buckets + 1))
        low = (keys & half).astype(np.uint32)
        out = []
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if hi > lo:
                part, several = low[lo:hi], many[lo:hi]
                out.append((key[0], 0, b, np.unique(part[~several]).tobytes(), np.unique(part[several]).tobytes()))
        return B.packed_frame(out)

    def short(digit: np.ndarray) -> np.ndarray:
        """A first digit by its bucket and low half."""
        return (digit & half) | (B.bucket_of(digit, buckets).astype(np.uint64) << np.uint64(32))

    def shorts(answers: pd.DataFrame) -> np.ndarray:
        """The digits that answers name, sorted and distinct."""
        parts = [np.frombuffer(k, np.uint32) | (np.uint64(b) << np.uint64(32)) for b, k in zip(answers["bucket"], answers["keys"])]
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))

    def contexts(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(answers):
            return B.packed_frame([])
        runs = Runs(B.Buffer(pdf), width)
        shared, own = shorts(answers), short(runs.digit)
        kept = B.looked_up(shared, np.ones(len(shared), bool), own, False)
        whole, least = B.least_by_key(runs.whole[kept], runs.ids[kept])
        out = B.packed(key[0], buckets, whole, least, kind=0, as_bytes=B.planes)
        # Of each digit the one run, or that there are several: one run's hash for each single one.
        digit, lowest, highest = B.extremes_by_key(own[kept], runs.whole[kept])
        single = lowest == highest
        edges = np.searchsorted(digit >> np.uint64(32), np.arange(buckets + 1))
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if hi > lo:
                one, low = single[lo:hi], (digit[lo:hi] & half).astype(np.uint32)
                out.append((key[0], 1, b, low[one].tobytes() + low[~one].tobytes(), lowest[lo:hi][one].tobytes()))
        return B.packed_frame(out)

    def context_answers(pdf: pd.DataFrame) -> pd.DataFrame:
        return B.smallest_elsewhere(pdf) if pdf["kind"].iloc[0] == 0 else runs_elsewhere(pdf)

    def undecided(runs: Runs, answers: pd.DataFrame):
        """Whether a run as a whole repeats from a smaller document; runs whose strings are looked at one by one."""
        keys, ids = B.least_by_key(runs.whole, runs.ids)
        least = B.looked_up(keys, ids, runs.whole, B.NO_ID)
        elsewhere, smaller = B.unpacked(answers, 0)
        least = np.minimum(least, B.looked_up(elsewhere, smaller, runs.whole, B.NO_ID))
        repeats = least < runs.ids
        differ = shorts(answers[answers["kind"] == 1])
        return repeats, np.flatnonzero(~repeats & B.looked_up(differ, np.ones(len(differ), bool), short(runs.digit), False))

    def strings(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(answers):
            return B.packed_frame([])
        buffer = B.Buffer(pdf)
        runs = Runs(buffer, width)
        _, ids, hashes = _windows(buffer, runs, undecided(runs, answers)[1], width)
        keys, least = B.least_by_key(hashes, ids)
        return B.packed_frame(B.packed(key[0], buckets, keys, least, kind=2, as_bytes=B.planes))

    def kept(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        buffer = B.Buffer(pdf)
        runs = Runs(buffer, width)
        repeats, open_ = undecided(runs, answers)
        starts, ids, hashes = _windows(buffer, runs, open_, width)
        keys, least = B.least_by_key(hashes, ids)
        elsewhere, smaller = B.unpacked(answers, 2)
        best = np.minimum(B.looked_up(keys, least, hashes, B.NO_ID), B.looked_up(elsewhere, smaller, hashes, B.NO_ID))
        single = starts[best < ids]
        gone = B.marked(
            len(buffer.bytes), np.concatenate([runs.first[repeats], single]), np.concatenate([runs.last[repeats] + width, single + width])
        )
        return described(buffer, gone)

    parts = rows.groupBy("block")
    answers1 = parts.applyInPandas(digits, B.PACKED).groupBy("bucket").applyInPandas(digits_elsewhere, B.PACKED)
    second = parts.cogroup(answers1.groupBy("block")).applyInPandas(contexts, B.PACKED)
    answers2 = second.groupBy("kind", "bucket").applyInPandas(context_answers, B.PACKED)
    third = parts.cogroup(answers2.groupBy("block")).applyInPandas(strings, B.PACKED)
    answers3 = third.groupBy("bucket").applyInPandas(B.smallest_elsewhere, B.PACKED)
    last = parts.cogroup(answers2.union(answers3).groupBy("block")).applyInPandas(kept, DESCRIBED)
    return last.withColumn("doc_id", F.when(F.col("doc_id") != B.NO_ID, F.col("doc_id")))


DESCRIBED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def described(buffer: B.Buffer, gone: np.ndarray) -> pd.DataFrame:
    """For each document of a block what is gone and what is kept."""
    data, out = buffer.bytes, []
    for i, lo, hi in zip(buffer.ids.tolist(), buffer.starts.tolist(), buffer.ends.tolist()):
        mask = gone[lo:hi]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        body = data[lo:hi] if not len(edges) else data[lo:hi][~mask]
        out.append((i, hi - lo, int(mask.sum()), len(edges) // 2, hashlib.sha256(body.tobytes()).hexdigest(), edges.tolist()))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
