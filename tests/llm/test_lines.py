import random

import numpy as np
import pytest

from drivetrace.llm import lines

BLANK = " \t\n\v\f\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, least=3, chars=20):
    """(doc_id, kept text, n_lines, n_dropped) of each row."""
    held = {}
    rows = [(2**63 if i is None else i, t or "") for i, t in rows]
    for i, t in rows:
        for line in t.split("\n"):
            held.setdefault(key_of(line), set()).add(i)
    out = []
    for i, t in rows:
        all_ = t.split("\n")
        kept = [x for x in all_ if not (len(key_of(x)) >= chars and len(held[key_of(x)]) >= least and i < max(held[key_of(x)]))]
        out.append((None if i == 2**63 else i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=str)


def texts(seed=5, n=150):
    rng = random.Random(seed)
    common = ["All rights reserved, 2024 edition.", "  Öffnungszeiten: täglich zwölf bis acht \t", "x" * 19, "é" * 19 + "É", "é" * 20, "İstanbul DIŞ kapının mandalı", " not stripped, but long enough"]
    rows = []
    for i in range(n):
        parts = [rng.choice(["", "short", f"only in {i} and nowhere else", "a b"]) for _ in range(rng.randint(0, 4))]
        for c in rng.sample(common, rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice([c, c.upper() if c.isascii() else c, f"\v{c}\f\r", c]))
        rows.append((i * 7 % 1009, "\n".join(parts)))
    return rows


@pytest.mark.parametrize("each", [300, 1 << 20])
def test_shared_lines(docs_of, each):
    rows = texts()
    rows += rows[3:40]  # repeated rows are one document
    rows += [(5000, None), (5001, ""), (None, rows[7][1]), (None, None), (5002, "\n\n"), (5003, "a line that stands in two documents"), (5004, "A line that stands in two documents ")]
    rows += [(6000 + n, "word " * 60_000 + f"\nthe same short paragraph\n{n}") for n in range(3)]
    rows += [(7000, "the same short paragraph\n" * 3 + "end"), (7000, "another text of the same document")]
    got = lines.deduplicated(docs_of(rows), bytes_each=each).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert sum(r.n_dropped for r in got) > 50


def test_limits_are_parameters(docs_of):
    rows = [(i, f"tiny\nmedium line\n{i}") for i in range(4)]
    got = lines.deduplicated(docs_of(rows), documents_least=4, chars=5).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(i, f"tiny\n{i}") for i in range(3)] + [(3, "tiny\nmedium line\n3")]
    assert all(r.n_dropped == 0 for r in lines.deduplicated(docs_of(rows), documents_least=5, chars=5).collect())


def test_nothing(docs_of):
    assert lines.deduplicated(docs_of([])).collect() == []
    assert [tuple(r) for r in lines.deduplicated(docs_of([(1, None)])).collect()] == [(1, "", 1, 0)]


def test_numbers_have_no_gaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        low, high = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64)
        low[: n // 2] = 7  # half of them differ in the upper half only
        made = lines.PerfectHash.of(low, high)
        assert sorted(made.number(low, high).tolist()) == list(range(n))
        assert made.words.nbytes * 8 <= 6 * n + 64 * 12
        foreign = made.number(low + np.uint64(1), high)
        assert len(foreign) == n and (foreign < max(n, 1)).all()


def test_foreign_keys_are_refused():
    """Keys that no document sent are told by their fingerprints."""
    rng = np.random.default_rng(2)
    low, high = rng.integers(0, 2**63, (2, 2000), dtype=np.uint64)
    ids = np.arange(3).repeat(2000)
    shard = lines.Shard(*lines.Shard.packed(np.tile(low, 3), np.tile(high, 3), ids, 3), 3)
    hit, last = shard.repeated(low, high)
    assert hit.all() and (last == 2).all()
    assert shard.repeated(low, high + np.uint64(1))[0].sum() == 0


def test_hashes_are_of_keys():
    got = dict(lines.line_keys("  Some Line that is Long enough \nshort\n".encode(), 20))
    assert list(got.values())[1:] == [None, None]
    again = dict(lines.line_keys(b"some line that is long enough", 20))
    assert list(got.values())[0] == list(again.values())[0]
