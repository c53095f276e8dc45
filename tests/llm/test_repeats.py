import hashlib
import random

import numpy as np
import pytest

from drivetrace.llm import blocks, chunking, suffix
from drivetrace.llm.queries import op10_suffix_array


def brute(rows, width=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), for distinct ids."""
    least = {}
    bodies = [(2**63 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in bodies:
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, b in bodies:
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < i:
                gone[k : k + width] = [True] * width
        spans = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((None if i == 2**63 else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed=2):
    rng = random.Random(seed)
    words = ["the", "öde", "of", "zanzibar", "house", "and", "😀", "stands", "ion", "erth"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", ".", "er"]) for _ in range(n))
    passages = [prose(30), prose(60), prose(9)]
    rows = []
    for i in range(120):
        t = prose(rng.randint(0, 80))
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(t))
            cut = rng.randint(0, 20)
            t = t[:at] + p[cut:] + t[at:]
        rows.append((i * 3 % 360, t))
    rows += [(1000 + i, rows[i * 7][1]) for i in range(12)]
    rows += [(2000, "a" * 3000), (2001, "a" * 700 + "b"), (2002, "x" * 49), (2003, "x" * 49), (2004, "ab" * 400), (2005, "ab" * 300)]
    rows += [(3000, None), (3001, ""), (None, rows[5][1]), (3002, rows[5][1] + rows[6][1])]
    rng.shuffle(rows)
    return rows


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("each", [700, 1 << 20])
def test_repeated_strings(docs_of, each):
    rows = texts()
    got = suffix.repeated(docs_of(rows), bytes_each=each).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_slices_of_long_documents(docs_of, monkeypatch):
    rng = random.Random(4)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, long_), (2, long_[:4000] + "X" + long_[4000:]), (3, long_[1000:2500]), (4, "zz" + long_[8000:])]
    small = blocks.Buffer(_frame(rows))
    monkeypatch.setattr(suffix, "TOGETHER", 1000)
    got = suffix.Runs(small, 50)
    strings = suffix._windows(small, got, np.arange(0, len(got.first), 3), 50)
    whole = set()
    for f, l, d in zip(got.first, got.last, got.digit):
        whole |= {(k, int(d)) for k in range(f, l + 1)}
    monkeypatch.undo()
    want = suffix.Runs(small, 50)
    for at, i, h in list(zip(*strings))[::97]:
        row = small.bytes[at : at + 50].reshape(1, -1)
        assert small.starts[small.ids.tolist().index(i)] <= at and h == blocks.windows_hash(row, 1)[0] ^ (blocks.windows_hash(row, 0)[0] * np.uint64(3))
    assert whole == {(k, int(d)) for f, l, d in zip(want.first, want.last, want.digit) for k in range(f, l + 1)}
    monkeypatch.setattr(blocks, "SLICE", 1000)
    cut = chunking.Chunks(small, 24)
    monkeypatch.undo()
    assert (cut.ends == chunking.Chunks(small, 24).ends).all()


def _frame(rows):
    import pandas as pd

    return pd.DataFrame({"doc_id": [i for i, _ in rows], "body": [t.encode() for _, t in rows]})


def test_digits_fall_evenly_into_buckets():
    rng = np.random.default_rng(7)
    body = rng.integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    digits = np.unique(suffix.Runs(blocks.Buffer(_frame([(1, body.decode())])), 50).digit)
    counts = np.bincount(blocks.bucket_of(digits, 32), minlength=32)
    assert len(digits) > 5_000 and counts.max() < 1.5 * counts.mean()


def test_answers_of_a_bucket():
    """Against sets, cell by cell."""
    rng = np.random.default_rng(6)
    some = lambda n, most=600: np.unique(rng.integers(0, most, n))
    once, many = [some(n) for n in (40, 0, 80, 3, 60)], [some(n, 900) for n in (5, 4, 0, 0, 9)]
    once = [np.setdiff1d(o, m) for o, m in zip(once, many)]
    cells = [(9 - b, 0, 3, o.astype(np.uint32).tobytes(), m.astype(np.uint32).tobytes()) for b, (o, m) in enumerate(zip(once, many))]
    held = [set(o.tolist()) | set(m.tolist()) for o, m in zip(once, many)]
    shared = {k for k in set().union(*held) if sum(k in h for h in held) > 1 or any(k in m for m in many)}
    got = suffix.digits_elsewhere(blocks.packed_frame(cells))
    assert {(r.block, r.bucket): set(np.frombuffer(r.keys, np.uint32).tolist()) for r in got.itertuples()} == {
        (9 - b, 3): h & shared for b, h in enumerate(held) if h & shared
    }
    runs = [rng.integers(0, 2, len(o)).astype(np.uint64) for o in once]
    cells = [(b, 1, 3, np.concatenate([o, m]).astype(np.uint32).tobytes(), r.tobytes()) for b, (o, m, r) in enumerate(zip(once, many, runs))]
    of = {}
    for o, m, r in zip(once, many, runs):
        for k, v in [*zip(o.tolist(), r.tolist()), *((k, v) for k in m.tolist() for v in (-1, -2))]:
            of.setdefault(k, set()).add(v)
    want = {b: {k for k in h if len(of[k]) > 1} for b, h in enumerate(held)}
    got = suffix.runs_elsewhere(blocks.packed_frame(cells))
    assert {r.block: set(np.frombuffer(r.keys, np.uint32).tolist()) for r in got.itertuples()} == {b: w for b, w in want.items() if w}
    ids = [rng.integers(0, 5, len(o)) for o in once]
    least = {}
    for o, i in zip(once, ids):
        for k, v in zip(o.tolist(), i.tolist()):
            least[k] = min(least.get(k, v), v)
    cells = [(b, 2, 3, blocks.planes(o.astype(np.uint64)), blocks.planes(i.astype(np.int64))) for b, (o, i) in enumerate(zip(once, ids))]
    got = blocks.smallest_elsewhere(blocks.packed_frame(cells))
    assert {b: dict(zip(*(x.tolist() for x in blocks.unpacked(got[got["block"] == b], 2)))) for b in got["block"]} == {
        b: less for b, (o, i) in enumerate(zip(once, ids)) if (less := {k: least[k] for k, v in zip(o.tolist(), i.tolist()) if least[k] < v})
    }


def test_repeated_rows_and_no_rows(docs_of):
    row = (5, "one row twice " * 9)
    got = suffix.repeated(docs_of([row, row])).collect()
    assert [(r.doc_id, r.n_removed) for r in got] == [(5, 0), (5, 0)]
    assert suffix.repeated(docs_of([])).count() == 0
    assert chunking.deduplicated(docs_of([])).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op10_suffix_array(spark, sf_dir).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == brute(rows)


def slow_cuts(data, reach):
    h = [0] * len(data)
    for i in range(len(data)):
        for j in range(chunking.ROLL):
            if i >= j:
                h[i] = (h[i] + (int(chunking.GEAR[data[i - j]]) << j)) & 0xFFFFFFFF
    return [
        i + 1 for i in range(reach, len(data) - reach)
        if h[i] > max(h[i - reach : i]) and h[i] >= max(h[i + 1 : i + 1 + reach])
    ]


def test_chunk_ends():
    data = np.frombuffer(random.Random(1).randbytes(3000) + b"a" * 200 + b"ab" * 90, np.uint8)
    assert chunking.cuts(data, 24).tolist() == slow_cuts(data, 24)


def slow_dedup(rows, reach=24):
    seen, out = set(), []
    for i, t in sorted(((2**63 if i is None else i, (t or "").encode()) for i, t in rows)):
        ends = [*(slow_cuts(t, reach) if len(t) > 2 * reach else []), len(t)]
        kept, gone, at = b"", 0, 0
        for e in ends:
            piece, at = t[at:e], e
            if piece and piece in seen:
                gone += len(piece)
                continue
            seen.add(piece)
            kept += piece
        out.append((None if i == 2**63 else i, gone, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("each", [700, 1 << 20])
def test_chunk_dedup(docs_of, each):
    rows = texts()
    got = chunking.deduplicated(docs_of(rows), bytes_each=each).select("doc_id", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_dedup(rows)


def test_short_texts_are_compared(docs_of):
    rows = [(1, "short equal text"), (2, "short equal text"), (3, "x"), (4, "x"), (5, ""), (6, ""), (7, "y"), (None, "x")]
    got = {r.doc_id: (r.n_removed, r.n_repeated) for r in chunking.deduplicated(docs_of(rows)).collect()}
    assert got == {1: (0, 0), 2: (16, 1), 3: (0, 0), 4: (1, 1), 5: (0, 0), 6: (0, 0), 7: (0, 0), None: (1, 1)}


def test_pairs_among_others():
    rng = np.random.default_rng(5)
    keys, checks = rng.integers(0, 40, 300, dtype=np.uint64), rng.integers(0, 5, 300, dtype=np.uint64)
    have = set(zip(keys[:150].tolist(), checks[:150].tolist()))
    got = chunking.among(keys, checks, keys[:150], checks[:150])
    assert got.tolist() == [p in have for p in zip(keys.tolist(), checks.tolist())]
    assert not chunking.among(keys, checks, keys[:0], checks[:0]).any()


def test_insertions_move_few_chunks():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20000, dtype=np.uint8)
    moved = np.concatenate([data[:9000], data[:7], data[9000:]])
    a, b = chunking.cuts(data, 24), chunking.cuts(moved, 24)
    same = set(a[a < 9000]) & set(b) | {x for x in a[a >= 9000] if x + 7 in set(b)}
    assert len(a) - len(same) <= 4
