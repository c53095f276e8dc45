"""Tokens of two tokenizers aligned over the bytes of each text.

Both sides cut the same bytes, a space and the text. In a batch of texts the tokens of one side are placed
by their first byte; an as-of merge, keyed by document, finds for each of them the token of the other side
that covers this byte. The union of both directions is every overlap. Overlaps that end at one byte are
links, and their ends cut the tokens of a text into groups.

How often the corpus links two ids takes all documents: batches are kept as a table, each with its distinct pairs of
ids, their numbers, and its links as places among them. The counts of all batches return to each as a broadcast of
measured size, beyond it by a join with one row for each pair and batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivetrace.llm.blocks import NO_ID
from drivetrace.llm.common import doc_texts, written

#: Bytes of text encoded at a time, and characters that one row of the kept table stands for. Values of
#: such a row stay under 512 KB as a rule: from there on the JVM puts them among old objects, which it rarely looks through.
AT_ONCE, TOGETHER = 1 << 18, 1 << 19
#: How the kept table is written: Parquet's reader holds a row group at a time, as large as its largest so far.
SMALL_GROUPS = {
    "parquet.block.size": 2 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1,
    "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false",
}
#: Different pairs of ids (17 bytes each) up to which their counts are broadcast.
SHARED_PAIRS = 1 << 21


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the
    others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


#: How byte-level tokenizers cut a text into words before they merge bytes: a fixed value of the format.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level byte-pair tokenizer from its JSON text; it reads a space and the text.

    Its entries are ranks for ``tiktoken``, which merges the same way several times as fast where entries are
    numbered in the order of their merges. Special tokens are entries that no merge makes.
    """

    def __init__(self, spec: str):
        import tiktoken

        model = json.loads(spec)
        alphabet, vocabulary = byte_alphabet(), dict(model["model"]["vocab"])
        made = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
        made = [vocabulary[m.replace(" ", "")] for m in made]
        level = model["pre_tokenizer"]
        if level["type"] != "ByteLevel" or level["add_prefix_space"] or not level["use_regex"] or model["normalizer"] or any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("not a plain byte-level tokenizer with entries in the order of merges")
        merged = set(made)
        ranks = {bytes(alphabet[c] for c in e): i for e, i in vocabulary.items() if len(e) == 1 or i in merged}
        vocabulary |= {t["content"]: t["id"] for t in model["added_tokens"]}
        self.table = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.table[i] = bytes(alphabet[c] for c in entry)
        self.encoding = tiktoken.Encoding("byte level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Piecewise:
    """A SentencePiece model from its bytes; it puts the space in front of the text itself."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=proto)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.table = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass
class Tokenizers:
    """The two sides as their files say: broadcast, and made into tokenizers once in each worker."""

    spec: str
    proto: bytes

    @classmethod
    def read(cls, byte_level: str, pieces: str) -> Tokenizers:
        with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
            return cls(a.read(), b.read())

    def sides(self) -> Sides:
        name = hashlib.sha256(self.spec.encode() + self.proto).hexdigest()
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = Sides(ByteLevel(self.spec), Piecewise(self.proto))
        return _MADE[name]


#: The tokenizers a Python worker used last.
_MADE: dict[str, Sides] = {}


class Sides:
    """Two tokenizers, the byte lengths of their tokens, and their ids as text before each separator."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.sizes = [np.array([len(t) for t in side.table], np.int64) for side in (a, b)]
        self.n_a, self.n_b = len(a.table), len(b.table)
        #: Type of a pair of ids as one number.
        self.pair = np.min_scalar_type(self.n_a * self.n_b)
        shown = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for end in ends for i in range(n)]
        rows = np.array(shown, "S")
        self.shown = rows.view(np.uint8).reshape(len(rows), -1)
        self.shown_size = np.char.str_len(rows)

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides for each text, none where one side's bytes are not the text's."""
        a, b = self.a.encode(texts), self.b.encode(texts)
        for n, text in enumerate(texts):
            body = b" " + text.encode()
            if not text or any(b"".join(map(s.table.__getitem__, ids)) != body for s, ids in ((self.a, a[n]), (self.b, b[n]))):
                a[n] = b[n] = []
        return a, b


class Aligned:
    """Overlaps, links and groups of a batch of texts. Places are bytes from the start of the batch."""

    def __init__(self, texts: list[str], sides: Sides):
        self.sides, self.n = sides, len(texts)
        (self.a, self.doc_a, self.start_a, self.end_a), (self.b, self.doc_b, self.start_b, self.end_b) = (
            self._side(ids, sizes) for ids, sizes in zip(sides.tokens(texts), sides.sizes)
        )
        a = pd.DataFrame({"at": self.start_a, "doc": self.doc_a, "a": np.arange(len(self.a))})
        b = pd.DataFrame({"at": self.start_b, "doc": self.doc_b, "b": np.arange(len(self.b))})
        over_a = pd.merge_asof(a, b, on="at", by="doc")
        over_b = pd.merge_asof(b, a, on="at", by="doc")
        # Tokens that start together are in both directions and count once.
        later = self.start_b > self.start_a[over_b["a"].to_numpy()]
        self.i = np.concatenate([over_a["a"].to_numpy(), over_b["a"].to_numpy()[later]])
        self.j = np.concatenate([over_a["b"].to_numpy(), over_b["b"].to_numpy()[later]])
        self.together = self.end_a[self.i] == self.end_b[self.j]
        order = np.argsort(self.i[self.together], kind="stable")
        self.link_a, self.link_b = self.i[self.together][order], self.j[self.together][order]
        #: Where tokens of both sides end; tokens hold bytes, so none ends where the one before does.
        self.cuts = self.end_a[self.link_a]

    def _side(self, ids: list[list[int]], sizes: np.ndarray):
        flat = np.array([i for some in ids for i in some], np.int64)
        doc = np.repeat(np.arange(len(ids)), [len(some) for some in ids])
        end = np.cumsum(sizes[flat])
        return flat, doc, end - sizes[flat], end

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of both sides and links of each text."""
        return tuple(np.bincount(d, minlength=self.n) for d in (self.doc_a, self.doc_b, self.doc_a[self.link_a]))

    def pairs(self) -> np.ndarray:
        """The ids of each link as one number."""
        return (self.a[self.link_a] * self.sides.n_b + self.b[self.link_b]).astype(self.sides.pair)

    def groups(self) -> tuple[np.ndarray, list[bytes]]:
        """Number of groups of each text, and the groups as text: a1,a2|b1;a3|b2,b3."""
        cuts, s = self.cuts, self.sides
        group_a, group_b = np.searchsorted(cuts, self.end_a), np.searchsorted(cuts, self.end_b)
        last_a, last_b = cuts[group_a] == self.end_a, cuts[group_b] == self.end_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        code = np.concatenate([self.a + s.n_a * last_a, 2 * s.n_a + self.b + s.n_b * last_b])[order]
        doc = np.concatenate([self.doc_a, self.doc_b])
        shown = s.shown[code]
        body = shown[shown != 0].tobytes()
        ends = np.cumsum(np.bincount(doc[order], weights=s.shown_size[code], minlength=self.n).astype(np.int64))
        n = np.bincount(self.doc_a[last_a], minlength=self.n)
        return n, [body[lo : hi - 1] if hi > lo else b"" for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _batches(parts: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about ``at_once`` bytes together; a longer text is alone."""
    for part in parts:
        ends = np.cumsum(pc.binary_length(part.column(1)).to_numpy())
        lo = 0
        while lo < part.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + at_once, "right")))
            yield part.column(0)[lo:hi].to_pylist(), part.column(1)[lo:hi].to_pylist()
            lo = hi


def overlaps(documents: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Every two tokens that share bytes: doc_id, a, b (token numbers from 0), a_id, b_id, together (both end
    at one byte), group (from 0).

    Rows follow ``documents``: repeated rows give repeated results. Texts without tokens (see ``aligned``) give none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tokenizers)  # as large as the vocabularies

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = shared.value.sides()
        for ids, texts in _batches(parts, AT_ONCE):
            at = Aligned(texts, sides)
            first_a, first_b = (np.searchsorted(d, np.arange(at.n)) for d in (at.doc_a, at.doc_b))
            cuts, doc = at.cuts, at.doc_a[at.i]
            group = np.searchsorted(cuts, np.minimum(at.end_a[at.i], at.end_b[at.j]))
            first_group = np.searchsorted(cuts, np.append(at.start_a, 0)[np.minimum(first_a, len(at.a))], "right")
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[d] for d in doc.tolist()], pa.int64()), "a": at.i - first_a[doc], "b": at.j - first_b[doc],
                    "a_id": at.a[at.i], "b_id": at.b[at.j], "together": at.together, "group": group - first_group[doc],
                }
            )

    return doc_texts(documents).mapInArrow(told, "doc_id long, a long, b long, a_id long, b_id long, together boolean, group long")


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_KEPT = "block long, ids binary, pairs binary, times binary, links binary, groups array<binary>, " + ", ".join(f"{c} binary" for c in _NUMBERS)


def _bundle(number: int, ids: list, held: list[tuple]) -> pa.RecordBatch:
    """Some batches as one row: packed numbers of the documents, the sorted distinct pairs of ids, how often each is
    linked, and for one link after another its place among them."""
    row = {"block": [number], "ids": [np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes()]}
    pair, at, times = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True, return_counts=True)
    row |= {"pairs": [pair.tobytes()], "times": [times.astype(np.uint32).tobytes()], "links": [at.astype(np.min_scalar_type(len(pair))).tobytes()]}
    row["groups"] = [[g for h in held for g in h[1]]]
    for n, c in enumerate(_NUMBERS, 2):
        row[c] = [np.concatenate([h[n] for h in held]).astype(np.int64).tobytes()]
    return pa.RecordBatch.from_pydict(row)


def _told(row, kind: np.dtype, pair: np.ndarray, count: np.ndarray, best: np.ndarray) -> dict:
    """The documents of one row of the kept table; ``pair`` is sorted and holds all of its pairs."""
    out = {c: np.frombuffer(row[c], np.int64) for c in ("ids", *_NUMBERS)}
    out["doc_id"] = out.pop("ids")
    own = np.frombuffer(row["pairs"], kind).astype(np.int64)
    at, found = np.frombuffer(row["links"], np.min_scalar_type(len(own))), np.searchsorted(pair, own)
    ends = np.cumsum(out["n_links"])
    for name, values in (("n_best", best), ("count_sum", count)):
        upto = np.concatenate([[0], np.cumsum(values[found].astype(np.int64)[at])])
        out[name] = upto[ends] - upto[ends - out["n_links"]]
    out["groups"] = [g.decode() for g in row["groups"]]
    return {c: out[c] for c in ("doc_id", *_NUMBERS, "n_best", "count_sum", "groups")}


def aligned(
    documents: DataFrame, tokenizers: Tokenizers, digest: bool = False, at_once: int = AT_ONCE, together: int = TOGETHER,
    shared_pairs: int = SHARED_PAIRS,
) -> DataFrame:
    """The alignment of each text, and how usual its links are in all of them.

    doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair of ids is linked as often as any
    pair with the same id of side b, ties included), count_sum (over the links, how often their pairs are
    linked in all documents), groups (text, a1,a2|b1;a3|b2,b3 by ids; with ``digest`` its sha256 in hex, empty
    for a text without tokens). One row for each row of ``documents``; every row counts, repeated ones too.
    Texts that are null or empty, or whose tokens do not give back a space and the text on both sides, have
    no tokens. Special tokens inside texts are plain text. Null doc_ids stay null. Other columns are ignored.
    ``at_once`` and ``together`` bound the bytes of a batch and the characters of a row of the kept table. Up to
    ``shared_pairs`` different pairs of ids, by count, are broadcast; more are joined to the rows they stand in.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tokenizers)  # as large as the vocabularies
    own = tokenizers.sides()
    n_b, kind = own.n_b, own.pair

    def kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number = shared.value.sides(), TaskContext.get().partitionId() << 32
        ids, held, size = [], [], 0
        for some, texts in _batches(parts, at_once):
            at = Aligned(texts, sides)
            n_a, n_b_, n_links = at.counted()
            n_groups, groups = at.groups()
            if digest:
                groups = [hashlib.sha256(g).hexdigest().encode() if g else b"" for g in groups]
            ids += some
            held.append((at.pairs(), groups, n_a, n_b_, n_groups, n_links))
            size += sum(map(len, texts))
            if size >= together:
                yield _bundle(number, ids, held)
                ids, held, size, number = [], [], 0, number + 1
        if ids:
            yield _bundle(number, ids, held)

    def pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, block in enumerate(part.column(0).to_pylist()):
                pair, n = np.frombuffer(part.column(1)[i].as_py(), kind), np.frombuffer(part.column(2)[i].as_py(), np.uint32)
                yield pa.RecordBatch.from_pydict({"block": np.full(len(pair), block), "pair": pair.astype(np.int64), "n": n.astype(np.int64)})

    def joined(block: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("pair")
        return pd.DataFrame(_told(block.iloc[0], kind, *(counts[c].to_numpy() for c in ("pair", "count", "best"))))

    def looked_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = (np.frombuffer(x, t) for x, t in zip(known.value, (np.int64, np.int64, np.bool_)))
        for part in parts:
            for i in range(part.num_rows):
                yield pa.RecordBatch.from_pydict(_told(part.slice(i, 1).to_pylist()[0], kind, pair, count, best))

    blocks = written(doc_texts(documents).mapInArrow(kept, _KEPT), "aligned", SMALL_GROUPS)
    rows = blocks.select("block", "pairs", "times").mapInArrow(pairs, "block long, pair long, n long")
    totals = rows.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % n_b)
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    totals = written(totals.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-counts")
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    if totals.count() <= shared_pairs:
        held = totals.orderBy("pair").toArrow()
        known = documents.sparkSession.sparkContext.broadcast([held.column(c).to_numpy().tobytes() for c in ("pair", "count", "best")])
        out = blocks.mapInArrow(looked_up, kinds)
    else:
        counts = rows.select("block", "pair").join(totals, "pair")
        out = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(joined, kinds)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
