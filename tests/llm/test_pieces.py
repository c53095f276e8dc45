import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from drivetrace.llm import pieces
from drivetrace.llm.queries import PIECE_MODEL, op9_pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def as_unigram(tmp_path_factory):
    """The same pieces and scores as a unigram model, for which the library searches the best sum."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PIECE_MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return pieces.vocabulary(str(path)), SentencePieceProcessor(model_file=str(path))


def words(n=3000, seed=6):
    rng = random.Random(seed)
    parts = ["the", "ing", "ö", "é", "tion", "wh", "ß", "ñ", "Z", "q", "7", ".", ",", "ation", "e", "ver", "x", "-", "漢", "th"]
    return sorted({" " * rng.choice([1, 1, 1, 2, 3]) + "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(n)})


def marked():
    """Words as the library gets them, and marked; it gives nothing for an empty text."""
    both = sorted((w.replace(" ", pieces.MARK), w[1:]) for w in words() if w != " ")
    return [m for m, _ in both], [w for _, w in both]


def ids_of(packed):
    return [np.frombuffer(b, np.int32).tolist() for b in packed]


def test_merges_equal_the_library(vocabulary, library):
    mine, theirs = marked()
    assert vocabulary.merges
    assert ids_of(pieces.Trie(vocabulary).segmented(mine)) == [library.encode(w) for w in theirs]


def test_sums_equal_the_library(as_unigram):
    own, model = as_unigram
    mine, theirs = marked()
    assert not own.merges
    score = lambda ids: sum(model.get_score(i) for i in ids if not model.is_byte(i))
    for ids, word in zip(ids_of(pieces.Trie(own).segmented(mine)), theirs):
        best = model.nbest_encode_as_ids(word, 2) if 0 < len(word.strip()) < 16 else [ids]
        if not any(model.is_byte(i) for i in best[0]):
            assert score(ids) == max(map(score, best))


def test_best_sum_by_brute_force():
    scores = {"▁": (-5.0, 0), "a": (-4.0, 1), "b": (-4.0, 2), "ab": (-5.0, 3), "▁a": (-6.0, 4), "ba": (-4.5, 5), "aba": (-8.0, 6)}
    own = pieces.Pieces(scores, list(range(100, 356)), [])
    marked = sorted({"▁" + "".join(w) for n in range(0, 7) for w in itertools.product("ab", repeat=n)})

    def best(w):
        if not w:
            return 0.0
        return max((best(w[: len(w) - len(p)]) + s for p, (s, _) in scores.items() if w.endswith(p)), default=float("-inf"))

    by_id = {i: (s, p) for p, (s, i) in scores.items()}
    for w, ids in zip(marked, pieces.Trie(own).segmented(marked)):
        found = [by_id[i] for i in np.frombuffer(ids, np.int32).tolist()]
        assert "".join(p for _, p in found) == w and sum(s for s, _ in found) == best(w)


NASTY = ["", None, " ", "  a", "a  b ", "\n", "\n\n x", "▁", "a▁b ▁▁", "😀 漢字 \t x\r\n", "<0x0A> <s> </s> <unk>", "\u0000�", "x" * 50000, "é" * 3000, " " * 4000, "word " * 30000]


def test_round_trip(docs_of, vocabulary):
    rows = list(enumerate(NASTY)) + [(None, "no id"), (7, "twice"), (7, "twice")]
    got = pieces.decoded(pieces.encoded(docs_of(rows), vocabulary), vocabulary).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, set()).add(t or "")
    assert all(r.decoded == r.text and r.text in want[r.doc_id] for r in got)
    assert all((len(r.ids) == 0) == (r.text == "") for r in got)


def test_decoded_beside(docs_of, vocabulary):
    rows = list(enumerate(NASTY))
    assert all(r.decoded == r.text for r in pieces.encoded(docs_of(rows), vocabulary, decode=True).collect())


def test_whole_texts_equal_the_library(vocabulary, library):
    texts = [" ".join(w).replace("q", "\n") for w in zip(words(300), words(300, seed=3), words(300, seed=4))]
    texts += ["reed*** (ndsh), x²y m². it's_a-b 12,5% «é» 漢字。 a_b__c", "THE!! | END:)"]
    got = pieces.Words(vocabulary).encode(texts)
    assert [g.tolist() for g in got] == [library.encode(t) for t in texts]


def test_words_end_only_where_no_piece_goes_on():
    glued = pieces.Pieces({"▁": (0, 0), "a.": (0, 1), "b": (0, 2), "ab": (0, 3), "!": (0, 4)}, list(range(256)), [])
    assert pieces.word_pattern(glued).findall(" b!bc ab.!\n  x") == [" b!b", "c", " ab.!", "\n", "  x"]


def test_forgetting_words_changes_nothing(vocabulary, monkeypatch):
    texts = ["".join(w) for w in zip(words(400), words(400, seed=9))]
    whole = pieces.Words(vocabulary).encode(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    few = pieces.Words(vocabulary)
    again = [few.encode([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(whole, again))


def test_decoding_odd_ids(spark, vocabulary):
    rows = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (3, [None, 99999999, -1, vocabulary.byte_ids[0xE2]], "x")], "n int, ids array<int>, text string")
    got = {r.n: r.decoded for r in pieces.decoded(rows, vocabulary).collect()}
    assert got == {1: "", 2: "", 3: "�"}


def test_column_of_the_same_name(spark, vocabulary):
    rows = spark.createDataFrame([(1, [vocabulary.scores["▁"][1]], "mine")], "n int, ids array<int>, decoded string")
    with pytest.raises(ValueError):
        pieces.decoded(rows, vocabulary)
    assert [tuple(r) for r in pieces.decoded(rows, vocabulary, "text").select("decoded", "text").collect()] == [("mine", "")]


def test_pairs_of_pieces(vocabulary):
    """The test at the edge of two pieces agrees with merging all of their characters."""
    trie, scores, rng = pieces.Trie(vocabulary), vocabulary.scores, random.Random(4)
    some = [p for p in rng.sample(sorted(scores), 3000) if pieces.merged(p, scores) == [p]]
    some += [c * n for c in "ae=" for n in range(1, 9) if c * n in scores and pieces.merged(c * n, scores) == [c * n]]
    for _ in range(20_000):
        a, b = rng.choice(some), rng.choice(some)
        assert trie._apart(a, b) == (pieces.merged(a + b, scores) == [a, b]), (a, b)


def test_little_memory_for_a_large_batch(vocabulary, library):
    """Of a batch of 5 MB of text a worker holds a few MB of words and ids at a time; all rows and ids come out."""
    texts = [" ".join(words(40, seed=n % 5)) for n in range(15_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    known = pieces.Words(vocabulary)
    known.encode(texts[:5])
    want, seen, most = [library.encode(t) for t in texts[:5]], 0, 0
    tracemalloc.start()
    for part in pieces.batches_encoded(iter([batch]), known, True):
        most = max(most, tracemalloc.get_traced_memory()[1])
        for row in part.slice(0, 3).to_pylist():
            assert row["text"] == row["decoded"] == texts[row["doc_id"]] and row["ids"] == want[row["doc_id"] % 5]
        assert part.column("doc_id").to_pylist() == list(range(seen, seen + part.num_rows))
        seen += part.num_rows
    tracemalloc.stop()
    assert batch.nbytes > 5e6 and seen == len(texts)
    assert most < 15e6, most


def test_no_rows(docs_of, vocabulary):
    assert pieces.encoded(docs_of([]), vocabulary).count() == 0


def test_query_on_whole_table(spark, sf_dir, library):
    got = {r.doc_id: r for r in op9_pieces(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got.values())
    for r in rows:
        assert got[r.doc_id].n_tokens == len(library.encode(r.text))
