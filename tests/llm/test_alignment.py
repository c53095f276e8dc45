import hashlib
import random
from collections import Counter

import pytest

from drivetrace.llm import alignment
from drivetrace.llm.queries import BYTE_LEVEL, PIECE_MODEL, op11_alignment


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers.read(BYTE_LEVEL, PIECE_MODEL)


def ranges(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def plain_tokens(text):
    """Byte ranges of both sides' tokens by the libraries alone; none where the bytes differ."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not plain_tokens.made:
        a = Tokenizer.from_file(BYTE_LEVEL)
        a.encode_special_tokens = True
        plain_tokens.made += [a, SentencePieceProcessor(model_file=PIECE_MODEL)]
    a, b = plain_tokens.made
    if not text:
        return [], []
    entry = {i: e for e, i in a.get_vocab().items()}
    back = alignment.byte_alphabet()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = {i: bytes(back[c] for c in entry[i]) for i in ids_a}
    shown = {i: b.id_to_piece(i) for i in ids_b}
    bytes_b = {i: bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in shown.items()}
    whole = (" " + text).encode()
    if b"".join(bytes_a[i] for i in ids_a) != whole or b"".join(bytes_b[i] for i in ids_b) != whole:
        return [], []
    return ranges(ids_a, bytes_a), ranges(ids_b, bytes_b)


plain_tokens.made = []


def brute(rows):
    """Rows of ``aligned`` without the as-of merge: ends compared one by one."""
    per, counts = [], Counter()
    for i, text in rows:
        a, b = plain_tokens(text)
        ends = sorted({z for _, z, _ in a} & {z for _, z, _ in b})
        links = [(x, y) for _, z, x in a for _, w, y in b if z == w]
        counts.update(links)
        groups, lo = [], 0
        for hi in ends:
            groups.append("|".join(",".join(str(k) for _, z, k in side if lo < z <= hi) for side in (a, b)))
            lo = hi
        per.append((i, len(a), len(b), links, ";".join(groups), len(ends)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        ((i, na, nb, n, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), text) for i, na, nb, links, text, n in per),
        key=str,
    )


def texts(seed=3, n=60):
    rng = random.Random(seed)
    words = ["the", "Zürich", "2024", "😀", "naïve", "unbelievable", "\n", "\t", "  ", "कि", "ﬁne", "don't", "<|endoftext|>", "</s>", "<0x41>", "x" * 40, "漢字", "é"]
    rows = [(i * 5, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(n)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "a ▁ mark"), (1004, "▁"), (None, "no id here"), (None, None), (1005, "\u0000nul"), (1006, "end \n")]
    return rows + rows[:7] + [(0, "another text of one id")]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.mark.parametrize("at_once, together, shared_pairs", [(200, 700, 0), (200, 700, 1 << 20), (1 << 20, 8 << 20, 1 << 20)])
def test_alignment(docs_of, tokenizers, at_once, together, shared_pairs):
    rows = texts()
    df = docs_of(rows).coalesce(2)
    got = alignment.aligned(df, tokenizers, at_once=at_once, together=together, shared_pairs=shared_pairs).select(*COLUMNS).collect()
    want = brute(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(r[4] for r in want) > 500 and any(r[5] < r[4] for r in want)
    hashed = alignment.aligned(df, tokenizers, digest=True).select("doc_id", "groups").collect()
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert Counter((r.doc_id, r.groups) for r in hashed) == Counter((r[0], digest(r[7])) for r in want)


def test_overlaps(docs_of, tokenizers):
    rows = [r for r in texts() if r[0] is not None][:60]
    got = Counter((r.doc_id, r.a, r.b, r.a_id, r.b_id, r.together, r.group) for r in alignment.overlaps(docs_of(rows), tokenizers).collect())
    want = Counter()
    for i, text in rows:
        a, b = plain_tokens(text)
        ends = sorted({z for _, z, _ in a} & {z for _, z, _ in b})
        for m, (s, z, x) in enumerate(a):
            for n, (t, w, y) in enumerate(b):
                if max(s, t) < min(z, w):
                    want[i, m, n, x, y, z == w, sum(e < min(z, w) for e in ends)] += 1
    assert got == want


def test_batches_cut_nothing():
    """Batches end between texts, and many batches give what one gives."""
    sides = alignment.Tokenizers.read(BYTE_LEVEL, PIECE_MODEL).sides()
    some = [t or "" for _, t in texts()]
    one = alignment.Aligned(some, sides)
    _, whole = one.groups()
    single = [alignment.Aligned([t], sides) for t in some]
    assert whole == [s.groups()[1][0] for s in single]
    assert one.pairs().tolist() == [p for s in single for p in s.pairs().tolist()]


def test_long_text_and_nothing(docs_of, tokenizers):
    text = "some words that go on and on, " * 60_000
    (row,) = alignment.aligned(docs_of([(1, text)]), tokenizers).collect()
    assert row.n_a > 400_000 and row.n_links == row.n_groups == row.groups.count(";") + 1
    assert alignment.aligned(docs_of([]), tokenizers).collect() == []
    assert alignment.overlaps(docs_of([(1, None)]), tokenizers).collect() == []


def test_kept_rows_stay_small(docs_of, tokenizers, monkeypatch):
    """However much text a task has, no value that it keeps is a large one, nor is what is read at a time."""
    import pyarrow.parquet as pq

    kept, real = [], alignment.written
    monkeypatch.setattr(alignment, "written", lambda *a: kept.append(real(*a)) or kept[-1])
    rng = random.Random(8)
    parts = ["the", "on", "er", "tion", "in", "an", "ed", "or", "ea", "ou", "st", "nt"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(5_000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(9_000))) for i in range(150)]
    got = alignment.aligned(docs_of(rows).coalesce(1), tokenizers, digest=True).collect()
    assert len(got) == 150 and all(r.n_links > 9_000 and r.count_sum >= r.n_links for r in got)
    tables = [pq.ParquetFile(f.removeprefix("file:")) for f in kept[0].inputFiles()]
    values = [v for t in tables for row in t.read().to_pylist() for v in row.values() if isinstance(v, bytes)]
    assert max(map(len, values)) < 512 << 10
    groups = [t.metadata.row_group(i).total_byte_size for t in tables for i in range(t.metadata.num_row_groups)]
    assert len(groups) > 1 and max(groups) < 3 << 20


def test_query(spark, sf_dir, tokenizers):
    """The registered query over the smallest documents against the plain version."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in docs]
    got = {r.doc_id: r for r in op11_alignment(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    per, counts, most = {}, Counter(), Counter()
    for i, text in short:
        a, b = plain_tokens(text)
        of = {z: x for _, z, x in a}
        per[i] = len(a), len(b), [(of[z], y) for _, z, y in b if z in of]
        counts.update(per[i][2])
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for i, (na, nb, links) in per.items():
        r = got[i]
        assert (r.n_a, r.n_b, r.n_links) == (na, nb, len(links))
        assert r.n_best == sum(counts[p] == most[p[1]] for p in links) and r.count_sum == sum(counts[p] for p in links)
        assert (r.groups_sha256 == "") == (na == 0)


def test_byte_level_tokens_are_the_librarys(sf_dir):
    """Over documents and odd texts, special tokens' strings and all kinds of white space among them."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_LEVEL)
    library.encode_special_tokens = True
    rng = random.Random(9)
    some = [t or "" for _, t in texts()] + pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    some += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x2000, 0x30FF), rng.randint(0x1F300, 0x1F9FF), 32, 10, 9, 39])) for _ in range(200)) for _ in range(300)]
    with open(BYTE_LEVEL, encoding="utf-8") as file:
        own = alignment.ByteLevel(file.read())
    assert own.encode(some) == [e.ids for e in library.encode_batch_fast([" " + t for t in some], add_special_tokens=False)]
