"""Exact k-means over whole numbers, with zone maps of vectors in Hilbert order.

Vectors are turned into the principal axes of all of them, and a Hilbert curve through the leading axes
orders them; neighbours on the curve become blocks of bounded size. A block knows the least and largest
coordinate of its vectors on every axis (a box), their number, their sum and their sum of squares.

A centroid is a candidate of a block unless some other one is nearer at every point of the box: the
difference of the two squared distances is linear, so its bound over the box is taken at one corner. Where
one candidate is left the block is done with what it knows; otherwise its vectors are compared with the
candidates alone, exactly. Turning and bounds are floating-point and have slack; what decides is whole
numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivetrace.llm.blocks import NO_ID
from drivetrace.llm.common import written

#: A component is floor(SCALE * x).
SCALE = 1024
#: The curve goes through so many axes, and divides each into 2 ** BITS cells.
AXES, BITS = 8, 8
#: Doubles hold sums of squares of components up to this size exactly.
SMALL = 1 << 20
_BLOCK = "n long, squares string, ids binary, vectors binary, sums binary, low binary, high binary"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cells (numbers below 2 ** bits) on a Hilbert curve, as bytes in its order.

    By the transposed form of J. Skilling, Programming the Hilbert curve (2004).
    """
    x = cells.T.astype(np.uint32).copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(len(x)):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(x[i] & q, low, swap).astype(np.uint32)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.uint32), top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= turn
    planes = [(row >> np.uint32(b)) & np.uint32(1) for b in reversed(range(bits)) for row in x]
    return np.packbits(np.array(planes, np.uint8).T, axis=1)


def limit(size: int) -> int:
    """Components up to this size have squared distances that fit into 64 bits, and fit into 32 bits themselves."""
    return min(math.isqrt(2**60 // size), 2**31 - 1)


def whole(column: pa.Array, size: int) -> np.ndarray:
    """The components of a column of vectors as whole numbers."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int32).reshape(-1, size)


class Frame:
    """Principal axes, centre, and spread along each axis."""

    def __init__(self, n: int, total: np.ndarray, products: np.ndarray):
        self.centre = total / max(n, 1)
        spread = products / max(n, 1) - np.outer(self.centre, self.centre)
        values, vectors = np.linalg.eigh(spread)
        self.axes = vectors[:, ::-1].copy()
        self.spread = np.sqrt(np.maximum(values[::-1], 1e-12))

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.centre) @ self.axes

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Places on the curve; what lies beyond twice the spread falls into the outer cells."""
        n = min(AXES, vectors.shape[1])
        cells = (self.turned(vectors)[:, :n] / self.spread[:n] + 2) * 2.0 ** (BITS - 2)
        return hilbert(np.clip(np.floor(cells), 0, 2**BITS - 1), BITS)


def _moments(valid: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, their sum, and the sum of their outer products, over all rows."""

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for part in parts:
            rows = np.column_stack([np.ones(part.num_rows), whole(part.column(0), size)])
            total += rows.T @ rows
        yield pa.RecordBatch.from_pydict({"i": np.arange(size + 1, dtype=np.int32), "row": list(total)})

    rows = valid.select("embedding").mapInArrow(summed, "i int, row array<double>")
    sums = rows.groupBy("i").agg(*(F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(size + 1))).orderBy("i").collect()
    total = np.array([list(r)[1:] for r in sums], np.float64).reshape(-1, size + 1)
    if not len(total):
        return 0, np.zeros(size), np.zeros((size, size))
    return int(total[0, 0]), total[0, 1:], total[1:, 1:]


def zone_maps(valid: DataFrame, frame: Frame, size: int, each: int) -> DataFrame:
    """Blocks of up to ``each`` neighbours on the curve, with their boxes; written to the shared folder."""

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors = whole(part.column(1), size)
            keys = [k.tobytes() for k in frame.keys(vectors)]
            yield pa.RecordBatch.from_pydict({"key": keys, "id": part.column(0), "body": [v.tobytes() for v in vectors]})

    def block(ids: np.ndarray, vectors: np.ndarray) -> dict:
        turned, wide = frame.turned(vectors), vectors.astype(np.int64)
        return {
            "n": len(ids), "squares": str(sum((wide * wide).sum(axis=1).tolist())), "ids": ids.tobytes(), "vectors": vectors.tobytes(),
            "sums": wide.sum(axis=0).tobytes(), "low": turned.min(axis=0).tobytes(), "high": turned.max(axis=0).tobytes(),
        }

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = np.zeros(0, np.int64), np.zeros((0, size), np.int32)
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        for part in _ended(parts):
            if part is not None:
                ids = np.concatenate([ids, part.column(0).to_numpy()])
                more = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int32).reshape(-1, size)
                vectors = np.concatenate([vectors, more])
            while len(ids) >= each or (part is None and len(ids)):
                made = block(ids[:each], vectors[:each])
                ids, vectors = ids[each:], vectors[each:]
                yield pa.RecordBatch.from_pydict({c: [made[c]] for c in names})

    rows = valid.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), "embedding")
    rows = rows.mapInArrow(placed, "key binary, id long, body binary")
    # Equal vectors have equal keys: the hash divides them among ranges too.
    rows = rows.withColumn("mix", F.xxhash64("id", "body"))
    rows = rows.repartitionByRange("key", "mix").sortWithinPartitions("key", "mix").select("id", "body")
    return written(rows.mapInArrow(blocks, _BLOCK), "zones")


def _ended(parts: Iterator) -> Iterator:
    yield from parts
    yield None


def candidates(low: np.ndarray, high: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """For each box whether each centroid may be the nearest one somewhere in it; all of them turned."""
    middle, half = (low + high) / 2, (high - low) / 2
    apart = ((middle[:, None, :] - turned[None]) ** 2).sum(axis=2)
    best = turned[apart.argmin(axis=1)]
    # |x - c|^2 - |x - best|^2 at its least over the box, which is at a corner.
    least = apart - apart.min(axis=1)[:, None] - 2 * (half[:, None, :] * np.abs(turned[None] - best[:, None, :])).sum(axis=2)
    slack = 1e-6 * (1 + apart.max(axis=1)[:, None] + (half * half).sum(axis=1)[:, None])
    return least <= slack


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid, the smaller one of equals, and its squared distance."""
    small = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= SMALL and vectors.shape[1] <= 1024
    kind = np.float64 if small else np.int64
    x, c = vectors.astype(kind), centroids.astype(kind)
    apart = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    which = apart.argmin(axis=1)
    return which, apart[np.arange(len(x)), which].astype(np.int64)


class Zones:
    """Some blocks as they are read, and what they need of each centroid."""

    def __init__(self, part: pa.RecordBatch, size: int, frame: Frame, centroids: np.ndarray):
        self.size, self.centroids = size, centroids
        self.columns = {c: part.column(i) for i, c in enumerate(part.schema.names)}
        self.n = self.columns["n"].to_numpy()
        box = lambda c: np.frombuffer(b"".join(self.columns[c].to_pylist()), np.float64).reshape(-1, size)
        self.may = candidates(box("low"), box("high"), frame.turned(centroids.astype(np.float64)))

    def vectors(self, i: int) -> np.ndarray:
        return np.frombuffer(self.columns["vectors"][i].as_py(), np.int32).reshape(-1, self.size)

    def assigned(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nearest centroids of a block's vectors, and the squared distances."""
        may = np.flatnonzero(self.may[i])
        which, apart = nearest(self.vectors(i), self.centroids[may])
        return may[which], apart

    def add(self, totals: list[list[int]]) -> None:
        """Adds to each cluster's sums of components, number of vectors and sum of distances."""
        for i in range(len(self.n)):
            may = np.flatnonzero(self.may[i])
            if len(may) == 1:
                c = self.centroids[may[0]].tolist()
                sums = np.frombuffer(self.columns["sums"][i].as_py(), np.int64).tolist()
                n = int(self.n[i])
                apart = int(self.columns["squares"][i].as_py()) - 2 * sum(a * b for a, b in zip(c, sums)) + n * sum(a * a for a in c)
                found = [(may[0], sums, n, apart)]
            else:
                which, distance = self.assigned(i)
                vectors = self.vectors(i)
                found = []
                for k in np.unique(which).tolist():
                    own = which == k
                    found.append((k, vectors[own].sum(axis=0, dtype=np.int64).tolist(), int(own.sum()), sum(distance[own].tolist())))
            for k, sums, n, apart in found:
                totals[k] = [a + b for a, b in zip(totals[k], [*sums, n, apart])]


def _totals(zones: DataFrame, frame: Frame, centroids: np.ndarray, size: int) -> list[list[int]]:
    """For each cluster the sums of its components, its number of vectors and its sum of distances."""
    k = len(centroids)

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * (size + 2) for _ in range(k)]
        for part in parts:
            Zones(part, size, frame, centroids).add(totals)
        places = np.arange(k * (size + 2), dtype=np.int32)
        told = [str(v) for row in totals for v in row]
        yield pa.RecordBatch.from_pydict({"cluster": places // (size + 2), "place": places % (size + 2), "total": told})

    rows = zones.mapInArrow(summed, "cluster int, place int, total string")
    sums = rows.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    out = [[0] * (size + 2) for _ in range(k)]
    for r in sums.collect():
        out[r["cluster"]][r["place"]] = int(r["total"])
    return out


def starts(valid: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest hashes, as whole numbers."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = valid.where("vec_id IS NOT NULL").select(order.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    return [np.floor(np.array(r["embedding"], np.float64) * SCALE).astype(np.int64).tolist() for r in rows]


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, each: int = 512) -> DataFrame:
    """Clusters of the vectors of ``size`` finite components, as whole numbers floor(1024 x).

    vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (components in decimal,
    joined by commas), candidates (centroids its block was compared with). One row for each row whose vector
    is kept; vectors that are null, of another length, or hold null or non-finite components are not.
    The centroids start as the vectors of the ``k`` smallest sha256 of "seed:vec_id"; with fewer vectors
    there are fewer. A vector belongs to the nearest centroid, the smaller number of equals; a round
    replaces every centroid that has vectors by the floor of their mean. Repeated rows count as often as they
    occur; a null vec_id starts no cluster and stays null. A vector whose squared
    distances could overflow (components of 64 from 131,071 on) takes no part and its row holds nulls; sums that
    overflow are null. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.where(F.coalesce((F.size("embedding") == size) & finite, F.lit(False)))
    fits = F.forall("embedding", lambda x: F.abs(x) < limit(size) // SCALE)
    valid = rows.where(fits)
    centroids = starts(valid, k, seed)
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, candidates int"
    wide = rows.where(~fits).select("vec_id", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in kinds.split(", ")[1:]))
    if not centroids:
        return wide
    frame = Frame(*_moments(valid, size))
    zones = zone_maps(valid, frame, size, each)
    for _ in range(rounds):
        totals = _totals(zones, frame, np.array(centroids, np.int64), size)
        moved = [[s // t[size] for s in t[:size]] if t[size] else c for t, c in zip(totals, centroids)]
        if moved == centroids:
            break  # further rounds would change nothing
        centroids = moved
    last = np.array(centroids, np.int64)
    inertia = [t[size + 1] for t in _totals(zones, frame, last, size)]
    told_sums = [v if v < 2**63 else None for v in [*inertia, sum(inertia)]]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            some = Zones(part, size, frame, last)
            for i in range(part.num_rows):
                which, distance = some.assigned(i)
                ids = np.frombuffer(some.columns["ids"][i].as_py(), np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": pa.array(ids, mask=ids == NO_ID), "cluster": which.astype(np.int32), "distance": distance,
                        "cluster_inertia": pa.array([told_sums[w] for w in which.tolist()], pa.int64()),
                        "inertia": pa.array([told_sums[-1]] * len(ids), pa.int64()),
                        "centroid_sha256": [names[w] for w in which.tolist()], "candidates": np.full(len(ids), some.may[i].sum(), np.int32),
                    }
                )

    return zones.mapInArrow(told, kinds).unionByName(wide)
