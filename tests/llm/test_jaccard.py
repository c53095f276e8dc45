import random

import numpy as np
import pytest

from drivetrace.llm import jaccard, shingles
from drivetrace.llm.queries import op4_chosen_path


def shingle_set(text, words=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    sets = [shingle_set(t) for _, t in rows]
    by = {}
    for n, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(n)
    shared = {}
    for members in by.values():
        for x, a in enumerate(members):
            for b in members[:x]:
                shared[b, a] = shared.get((b, a), 0) + 1
    near = [set() for _ in rows]
    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            near[a].add(b)
            near[b].add(a)
    out = []
    for n in range(len(rows)):
        seen, todo = {n}, [n]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min(ids[k] for k in seen)
        out.append((rows[n][0], None if low == 2**63 - 1 else low, len(near[n])))
    return sorted(out, key=str)


def texts(n=220, seed=8):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line, bases, rows = prose(14), [prose(rng.randint(20, 150)) for _ in range(30)], []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.6 else prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            w = line + w
        rows.append((i * 2, rng.choice([" ", "\n", "  "]).join(w)))
    hot = prose(120)
    for i in range(150):
        w = list(hot)
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((5000 + i, " ".join(w)))
    rows += [(6000 + i, "  a b  c") for i in range(3)] + [(6100, None), (6101, ""), (6102, " \n"), (None, rows[0][1]), (None, "quite alone here and there now")]
    rows += [(6200, "a b c d"), (6201, "öde 😀 x"), (6202, "öde\t😀\nx ")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaf,tile", [(256, 512), (20, 16)])
def test_all_links(docs_of, leaf, tile):
    rows = texts()
    got = jaccard.near_texts(docs_of(rows), leaf=leaf, tile=tile).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)
    kept = {}
    for r in got:
        kept[r.class_id] = kept.get(r.class_id, 0) + r.kept
    assert {c for c, n in kept.items() if n != 1} <= {None}


def test_repeated_and_no_rows(docs_of):
    rows = [(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g"), (2, "other words stand here now too")]
    got = jaccard.near_texts(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(1, 1, 3), (1, 1, 3), (1, 1, 3), (2, 1, 3), (2, 2, 0)]
    assert jaccard.near_texts(docs_of([])).count() == 0


def test_any_column_names(spark):
    names = ["_h", "_d", "id", "row", "text_hash", "digest", "node", "class"]
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text, *names), (2, text + " twelve", *names), (2, text + " twelve", *names), (None, None, *names), (5, "", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = jaccard.distinct_texts(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[3], rows[4]], docs.schema).collect()))


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = (" ".join("x" * rng.randint(1, 30) + str(rng.randint(0, 9)) for _ in range(900)) + " " + "y" * 5000 + " end").encode()
    want = [h for _, h, _ in shingles.shingled([text, b"a b"], 5)]
    monkeypatch.setattr(shingles.B, "SLICE", 1000)
    got = [h for _, h, _ in shingles.shingled([text, b"a b"], 5)]
    monkeypatch.undo()
    a, b = np.concatenate(want), np.concatenate(got)
    assert len(a) == len(b) == len(text.split()) - 4 + 1
    assert (a == b).sum() >= len(a) - 5  # the word longer than a piece has another hash, the same everywhere


def test_runs_for_a_recall():
    assert jaccard.runs_needed(0.8, 0.9999, 3) > jaccard.runs_needed(0.8, 0.9, 3) >= 2


def test_query_on_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op4_chosen_path(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)
