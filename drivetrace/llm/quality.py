"""Document quality by a factorisation machine.

Features are words hashed into a fixed number of places (their counts as a unit vector), statistics of
the text's structure, and its length in characters as the one piece of metadata. A pair of features
interacts through the product of their low-rank factors; with the sum-of-squares identity

    sum over pairs <v_i, v_j> x_i x_j = 1/2 sum over ranks ((sum v_if x_i)^2 - sum v_if^2 x_i^2)

a score costs time linear in the features. The machine is fitted on a bounded sample of labelled
documents; every document is scored on its whole text where it lies, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivetrace.llm.blocks import sliced
from drivetrace.llm.shingles import word_hashes

PLACES, RANK = 4096, 8
#: Kinds of bytes that the structure statistics count, in this order; the rest is the last kind.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".", b",;:", b"!?", b"|", b"#*%$&@", b"()[]{}<>=/\\", b"-_'\"`~^+", bytes(range(128, 256)))
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _n, _bytes in enumerate(CLASSES):
    _CLASS[list(_bytes)] = _n
SHAPES = len(CLASSES) + 1 + 8
WIDTH = PLACES + SHAPES


def features(bodies: list[bytes], chars: np.ndarray) -> np.ndarray:
    """One dense row for each text of a small batch."""
    n = len(bodies)
    starts = np.cumsum([0] + [len(b) + 1 for b in bodies])
    data = np.frombuffer(b" ".join([*bodies, b""]), np.uint8)
    sizes = np.maximum(np.diff(starts) - 1, 0)
    hashes, places = word_hashes(data)
    of = np.searchsorted(starts, places, "right") - 1
    words = np.bincount(of, minlength=n).astype(np.float64)
    counts = np.bincount(of * PLACES + (hashes >> np.uint64(40)).astype(np.int64) % PLACES, minlength=n * PLACES).reshape(n, PLACES).astype(np.float32)
    kinds = np.bincount(np.repeat(np.arange(n), np.diff(starts)) * 16 + _CLASS[data], minlength=n * 16).reshape(n, 16)[:, : len(CLASSES) + 1].astype(np.float64)
    kinds[:, 3] -= 1  # the space put between texts
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    some, any_ = np.maximum(words, 1), np.maximum(sizes, 1)
    shape = np.column_stack(
        [
            np.sqrt(kinds / any_[:, None]),
            np.log1p(sizes) / 12, np.log1p(chars) / 12, np.log1p(words) / 10,
            np.minimum(sizes / some / 20, 2),
            (counts > 0).sum(1) / some, counts.max(1) / some,
            np.bincount(of, weights=again, minlength=n) / some,
            np.ones(n),
        ]
    )
    length = np.sqrt((counts * counts).sum(1, keepdims=True))
    return np.concatenate([counts / np.maximum(length, 1), shape.astype(np.float32)], axis=1)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        pairs = ((x @ self.factors) ** 2).sum(1) - (x * x) @ (self.factors**2).sum(1)
        return self.bias + x @ self.weights + 0.5 * pairs


def probabilities(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = 1) -> Machine:
    """Logistic loss, minimised by Adam over shuffled batches."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    params = [np.array([np.log(share / (1 - share))]), np.zeros(x.shape[1]), rng.normal(0, 0.05, (x.shape[1], RANK))]
    params = [p.astype(np.float32) for p in params]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            xb = x[order[lo : lo + batch]].astype(np.float32)
            bias, w, v = params
            sums = xb @ v
            squares = xb * xb
            p = probabilities(bias[0] + xb @ w + 0.5 * ((sums**2).sum(1) - squares @ (v * v).sum(1)))
            g = ((p - y[order[lo : lo + batch]]) / len(xb)).astype(np.float32)
            grads = [np.array([g.sum()]), xb.T @ g + decay * w, xb.T @ (g[:, None] * sums) - v * (squares.T @ g)[:, None] + decay * v]
            step += 1
            for k, grad in enumerate(grads):
                m, s = moments[k]
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                params[k] = params[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Machine(float(params[0][0]), params[1].astype(np.float32), params[2].astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model learns from; rows without doc_id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _texts(documents: DataFrame) -> DataFrame:
    chars = F.coalesce(F.col("n_chars").cast("long"), F.length("text")) if "n_chars" in documents.columns else F.length("text")
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"),
        F.greatest(F.coalesce(chars, F.lit(0)), F.lit(0)).cast("double").alias("chars"),
    )


def _batches(pdf: pd.DataFrame, rows: int = 64, size: int = 1 << 20):
    """Row ranges of few rows and bytes; a longer text is alone."""
    lo, total = 0, 0
    sizes = [len(b) for b in pdf["body"]]
    for hi, n in enumerate(sizes):
        if hi > lo and (hi - lo >= rows or total + n > size):
            yield slice(lo, hi)
            lo, total = hi, 0
        total += n
    if len(sizes) > lo:
        yield slice(lo, len(sizes))


def learned(documents: DataFrame, labels: DataFrame, column: str = "quality", sample: int = 5000) -> Machine:
    """A machine fitted on at most ``sample`` labelled documents that are not held out.

    The sample is taken by a hash of the doc_id. Null labels and doc_ids teach nothing; of several labels
    of a document the largest counts. Of several rows of a doc_id one teaches, the least in its features.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample)

    def sparse(parts):
        for pdf in parts:
            for rows in _batches(pdf):
                part = pdf.iloc[rows]
                x = features(part["body"].to_list(), part["chars"].to_numpy())
                at = [np.flatnonzero(r) for r in x]
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"], "label": part["label"], "at": [a.astype(np.uint16).tobytes() for a in at], "x": [r[a].tobytes() for a, r in zip(at, x)]}
                )

    # At most ``sample`` pairs of numbers are broadcast.
    rows = _texts(documents).join(F.broadcast(known), "doc_id").mapInPandas(sparse, "doc_id long, label int, at binary, x binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "at", "label")).alias("r")).select("doc_id", "r.*")
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    x = np.zeros((len(rows), WIDTH), np.float32)
    for n, r in enumerate(rows):
        x[n, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    return fitted(x, np.array([float(r["label"] > 0) for r in rows]))


def scored(documents: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``.

    The score is the probability that the label is 1; predicted is 1 from ``threshold`` on. A null or
    empty text has the score of a text without words; a null n_chars is counted. Only doc_id, text and
    n_chars are read; rows are never shuffled.
    """
    rows = _texts(documents).withColumns({"no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    rows = rows.mapInPandas(_scorer(machine), "doc_id long, no_id boolean, score double")
    doc_id = F.when(~F.col("no_id"), F.col("doc_id"))
    return rows.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents`` whose score reaches ``threshold``, with all their columns."""

    def kept(batches):
        for part in (some for batch in batches for some in sliced(batch, "text")):
            text = pc.fill_null(part.column("text"), "")
            chars = pc.cast(pc.utf8_length(text), pa.float64())
            if "n_chars" in part.schema.names:
                chars = pc.coalesce(pc.cast(part.column("n_chars"), pa.float64()), chars)
            body = pc.cast(text, pa.binary()).to_pylist()
            pdf = pd.DataFrame({"body": body, "chars": np.maximum(chars.to_numpy(zero_copy_only=False), 0)})
            score = np.concatenate([s["score"] for s in _scorer(machine)([pdf])])
            yield part.filter(pa.array(score >= threshold))

    return documents.mapInArrow(kept, documents.schema)


def _scorer(machine: Machine):
    def score(parts):
        for pdf in parts:
            out = np.zeros(len(pdf))
            for rows in _batches(pdf):
                part = pdf.iloc[rows]
                out[rows] = probabilities(machine.logits(features(part["body"].to_list(), part["chars"].to_numpy())))
            yield pdf.drop(columns=["body", "chars"]).assign(score=out)

    return score
