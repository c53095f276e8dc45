"""Encoding texts as sentence pieces, and back, by a shared-prefix Viterbi search.

Spaces become the mark U+2581 and one mark is put in front of a text. A text falls into marked words:
marks and what follows, up to the next mark, line end, or change between letters and other characters.
Words are cut only where no piece of the vocabulary could reach across. Distinct words, sorted,
are a trie in depth-first order: two neighbours share the path of their common prefix, and what the
forward pass found along it is kept.

In a unigram model the forward pass keeps the best sum of scores of each prefix and its last piece. In
a byte-pair model scores are the order of merges and sums mean nothing; there a prefix has exactly one
segmentation that the merges make, and its last piece follows another only if merging the two alone
leaves them as they are, so the pass keeps that one piece instead of a best sum. A character that no
piece covers becomes its UTF-8 bytes, and so does a mark that stands in the text itself, so that
decoding gives back exactly what was encoded.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivetrace.llm.blocks import sliced
from drivetrace.llm.common import doc_texts

MARK = "▁"
#: Stands for a mark that the text itself holds; no text can hold this code point.
LITERAL = "\ud800"
#: Words (twice over) and pairs of pieces a Python worker remembers, and bytes of text encoded at a time.
REMEMBERED, AT_ONCE = 150_000, 1 << 18


@dataclass
class Pieces:
    """A vocabulary: score and id of each piece, the ids of the 256 byte pieces, each id's bytes, and
    whether scores are the order of merges."""

    scores: dict[str, tuple[float, int]]
    byte_ids: list[int]
    decoded: list[bytes]
    merges: bool = False
    name: str = field(default_factory=lambda: uuid.uuid4().hex)



def vocabulary(path: str) -> Pieces:
    """The pieces of a SentencePiece model file with byte pieces."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(path, "rb") as file:
        proto = file.read()
    model = SentencePieceProcessor(model_proto=proto)
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(proto)
    kinds = spec.trainer_spec
    if kinds.model_type not in (kinds.UNIGRAM, kinds.BPE):
        raise ValueError("only unigram and byte-pair models have pieces to choose from")
    scores, byte_ids, decoded = {}, [0] * 256, []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            decoded.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            decoded.append(b"")
        else:
            scores[piece] = (model.get_score(i), i)
            decoded.append(piece.replace(MARK, " ").encode())
    return Pieces(scores, byte_ids, decoded, kinds.model_type == kinds.BPE)


def merged(text: str, scores: dict[str, tuple[float, int]], least: int = 1) -> list[str]:
    """Characters merged as a byte-pair model does it, down to ``least`` parts: the best-scored neighbours
    first, the left ones of equals."""
    parts = list(text)
    while len(parts) > least:
        found = [(scores[a + b][0], -n) for n, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
        if not found:
            break
        n = -max(found)[1]
        parts[n : n + 2] = [parts[n] + parts[n + 1]]
    return parts


class Trie:
    """Words as a trie, walked depth-first: what the forward pass holds for each prefix of the last word."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.number = {p: i for p, (_, i) in pieces.scores.items()}
        self.packed = {i: np.int32(i).tobytes() for i in self.number.values()}
        ends: dict[str, set[int]] = {}
        for piece in self.number:
            ends.setdefault(piece[-2:], set()).add(len(piece))
        #: Lengths of the pieces that end in two given characters, the longest first.
        self.lengths = {e: sorted({*n, *ends.get(e[-1], ())}, reverse=True) for e, n in ends.items()}
        self.apart: dict[int, bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}

    def _other(self, char: str) -> bytes:
        """Ids of a character that no piece covers: its bytes."""
        body = (MARK if char == LITERAL else char).encode()
        return np.array([self.pieces.byte_ids[b] for b in body], np.int32).tobytes()

    def segmented(self, words: list[str]) -> list[bytes]:
        """Ids of the segmentation of each marked word, as 32-bit numbers; ``words`` are sorted."""
        walk = self._by_merges if self.pieces.merges else self._by_sum
        # Of each prefix the last piece, its id (-1: a character that no piece covers), and the best sum.
        last, ids, sums = [""], [-1], [0.0]
        packed, before, out = self.packed, "", []
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], ids[shared + 1 :], sums[shared + 1 :]
            walk(word, shared, last, ids, sums)
            parts, end = [], len(word)
            while end:
                own = ids[end]
                parts.append(packed[own] if own >= 0 else self._other(last[end]))
                end -= len(last[end])
            parts.reverse()
            out.append(b"".join(parts))
            before = word
        return out

    def _by_merges(self, word: str, shared: int, last: list[str], ids: list[int], sums: list[float]) -> None:
        """For each further prefix the one last piece that the merges leave."""
        number, apart, lengths = self.number, self.apart, self.lengths
        for end in range(shared + 1, len(word) + 1):
            for n in lengths.get(word[end - 2 : end] if end > 1 else word[0]) or (1,):
                if n > end:
                    continue
                piece = word[end - n : end]
                own = number.get(piece)
                if own is None:
                    continue
                left = ids[end - n]
                key = left << 32 | own
                fits = apart.get(key)
                if fits is None:
                    fits = self._fits(key, last[end - n] if left >= 0 else "", piece)
                if fits:
                    last.append(piece)
                    ids.append(own)
                    break
            else:
                last.append(word[end - 1])
                ids.append(-1)

    def _fits(self, key: int, before: str, piece: str) -> bool:
        """Whether merging two pieces' characters alone gives the two again."""
        if len(self.apart) > REMEMBERED:
            self.apart.clear()
        self.apart[key] = self._apart(before, piece) if before else len(piece) == 1 or self._halves(piece) is not None
        return self.apart[key]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of a piece joins; none if merges do not make it."""
        if piece not in self.halves:
            parts = merged(piece, self.pieces.scores, 2)
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[piece]

    def _apart(self, left: str, right: str) -> bool:
        """Whether no merge across the edge of two pieces comes before those that make them.

        The later merge of the two is undone, again and again; what then stands at the edge must not
        merge before it. Of equal merges the left one is made first.
        """
        scores, bound, right_undone = self.pieces.scores, -np.inf, False
        if len(right) > 1 and self._halves(right) is None:
            return False
        while True:
            across = scores.get(left + right)
            if across is not None and (across[0] > bound or (right_undone and across[0] == bound)):
                return False
            if len(left) == len(right) == 1:
                return True
            if len(right) == 1 or (len(left) > 1 and scores[left][0] < scores[right][0]):
                bound, right_undone, left = scores[left][0], False, self._halves(left)[1]
            else:
                bound, right_undone, right = scores[right][0], True, self._halves(right)[0]

    def _by_sum(self, word: str, shared: int, last: list[str], ids: list[int], sums: list[float]) -> None:
        """For each further prefix the best sum of scores, and the last piece of it."""
        scores = self.pieces.scores
        lowest = min((s for s, _ in scores.values()), default=0.0) - 10.0
        for end in range(shared + 1, len(word) + 1):
            top, piece, own = None, "", -1
            for n in self.lengths.get(word[end - 2 : end] if end > 1 else word[0]) or (1,):
                hit = scores.get(word[end - n : end]) if n <= end else None
                if hit is not None and (top is None or sums[end - n] + hit[0] > top):
                    top, piece, own = sums[end - n] + hit[0], word[end - n : end], hit[1]
            if word[end - 1] not in scores and (top is None or sums[end - 1] + lowest > top):
                top, piece, own = sums[end - 1] + lowest, word[end - 1], -1
            sums.append(top)
            last.append(piece)
            ids.append(own)


def word_pattern(pieces: Pieces) -> re.Pattern:
    """What a marked word is: spaces and a run of letters and digits, or of other characters.

    A character that some piece joins to one of the other kind counts as other, and so on until no piece
    joins the two kinds; pieces hold marks in front only, and no line ends.
    """
    pairs = {(a, b) for p in pieces.scores for a, b in zip(p, p[1:]) if MARK not in (a, b)}
    letter, odd = re.compile(r"[^\W_]"), {"_"}
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces.scores):
        return re.compile("(?s).+")
    while more := {c for p in pairs for c, d in (p, p[::-1]) if letter.match(c) and c not in odd and (d in odd or not letter.match(d))}:
        odd |= more
    others = re.escape("".join(sorted(odd)))
    return re.compile(rf" *[^\W{others}]+| *(?:[^\w \n]|[{others}])+| +|\n")


class Words:
    """Words segmented before, of which the ones seen lately are kept."""

    def __init__(self, pieces: Pieces):
        self.trie = Trie(pieces)
        self.table = Table(pieces.decoded)
        self.cut = word_pattern(pieces).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.cut(" " + t.replace(MARK, LITERAL)) if t else [] for t in texts]
        distinct = set().union(*split)
        new = distinct.difference(self.young)
        if len(self.young) + len(new) > REMEMBERED:
            self.old, self.young, new = self.young, {}, distinct
        seen = new.intersection(self.old)
        self.young.update((w, self.old[w]) for w in seen)
        marked = sorted((w.replace(" ", MARK), w) for w in new.difference(seen))
        self.young.update(zip((w for _, w in marked), self.trie.segmented([m for m, _ in marked])))
        return [np.frombuffer(b"".join(map(self.young.__getitem__, words)), np.int32) for words in split]


#: What a Python worker remembers: the words of one vocabulary, the last.
_REMEMBERED: dict[str, Words] = {}


def _remembered(pieces: Pieces) -> Words:
    if pieces.name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[pieces.name] = Words(pieces)
    return _REMEMBERED[pieces.name]


def batches_encoded(batches: Iterator[pa.RecordBatch], words: Words, decode: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, text, ids and, if asked for, decoded; only about AT_ONCE bytes of a batch are Python's at a time."""
    for part in (some for batch in batches for some in sliced(batch, "text", AT_ONCE)):
        ids = words.encode(part.column("text").to_pylist())
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        columns = [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
        if decode:
            columns.append(pa.array(words.table.texts(ids), pa.string()))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "ids", "decoded"][: len(columns)])


def encoded(documents: DataFrame, pieces: Pieces, decode: bool = False) -> DataFrame:
    """doc_id, text and ids (array of piece ids) of every row of ``documents``; decoded too, if asked for.

    A null or empty text has no ids. Any other text is encoded whole, from the one mark put in front of
    it to its end. Only doc_id and text are read; rows are never shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary

    def encode(batches):
        return batches_encoded(batches, _remembered(shared.value), decode)

    more = ", decoded string" if decode else ""
    return doc_texts(documents).mapInArrow(encode, f"doc_id long, text string, ids array<int>{more}")


class Table:
    """The bytes of all ids one after another, for decoding many rows at a time."""

    def __init__(self, decoded: list[bytes]):
        self.sizes = np.array([len(b) for b in decoded], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = np.frombuffer(b"".join(decoded), np.uint8)

    def texts(self, rows: list[np.ndarray], at_once: int = 1 << 17) -> list[str]:
        """The texts of rows of ids that are all in the vocabulary, some rows at a time."""
        out, lo, size = [], 0, 0
        for hi, row in enumerate(rows):
            if hi > lo and size + len(row) > at_once:
                out += self._texts(rows[lo:hi])
                lo, size = hi, 0
            size += len(row)
        return out + self._texts(rows[lo:])

    def _texts(self, rows: list[np.ndarray]) -> list[str]:
        ids = np.concatenate([np.zeros(0, np.int32), *rows])
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        body = self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)].tolist()
        return [body[lo:hi].decode("utf-8", "replace").removeprefix(" ") for lo, hi in zip(ends[:-1], ends[1:])]

    def known(self, ids) -> np.ndarray:
        """The ids of a row that are in the vocabulary, as numbers."""
        row = np.array([i for i in ids if i is not None and i == i and 0 <= i < len(self.sizes)], np.float64)
        return row.astype(np.int32)


def decoded(rows: DataFrame, pieces: Pieces, column: str = "decoded") -> DataFrame:
    """``rows`` with ``ids`` turned into a column of the given name; other columns stay, one so named is refused.

    Ids outside the vocabulary and null ones are skipped; null ids give an empty text. Bytes that are
    not UTF-8 become U+FFFD.
    """
    if column in rows.columns:
        raise ValueError(f"there is a column {column}")
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = Table(shared.value.decoded)
        for ids in parts:
            yield pd.Series(table.texts([table.known([] if row is None else row.tolist()) for row in ids]), dtype=object)

    return rows.withColumn(column, decode("ids"))
