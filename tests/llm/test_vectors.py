import math
import random

import numpy as np
import pytest

from drivetrace.llm import embed_dedup, vptree
from drivetrace.llm.queries import op2_vp_tree, op5_embedding_dedup

KIND = "vec_id long, embedding array<double>, label int, block int, lead string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 0, "x", 1) for i, v, l in rows], KIND)


def clustered(n, d=16, groups=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    rows = []
    for i in range(n):
        v = centres[i % groups] + rng.normal(scale=0.25 if i % 3 else 0.02, size=d)
        rows.append((i * 5, [float(x) for x in v * rng.uniform(0.5, 3)], int(rng.integers(3))))
    return rows


ODD = [
    (100001, None, 1), (100002, [], 1), (100003, [0.0] * 16, 1), (100004, [None] + [1.0] * 15, 1),
    (100005, [math.nan] + [1.0] * 15, 1), (100006, [math.inf] + [1.0] * 15, 1), (100007, [1.0] * 16, None),
    (100008, [1.0, 2.0], 1), (100010, [1.0, 2.0], 1), (None, [1.0] * 16, 1),
]


def brute_nearest(rows, every=20, k=20):
    rows = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in rows:
        if q % every:
            continue
        scored = []
        for i, b in rows:
            if i != q and len(a) == len(b):
                s = 0.0
                for x, y in zip(a, b):
                    s += float(x) * float(y)
                scored.append((-s, i))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_exact_search(spark):
    rows = clustered(700) + ODD
    rows += [(7000 + i, rows[4][1], 1) for i in range(60)]  # many equal vectors: ties to the smaller id
    got = vptree.nearest(frame(spark, rows + rows[:5]), shard_rows=256, block_rows=64)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_nearest(rows))


@pytest.mark.parametrize("sizes", [(1e200, 3.0), (1e160, 1e170), (1e300, 1.0), (1e-200, 1e-170), (5e-324, 1.0)])
def test_search_of_any_length(spark, sizes):
    """Vectors whose squares overflow or vanish neither empty the result nor change that of the others."""
    rows = clustered(300) + [(9000 + n, [s * x for x in (0.5, -1.0, 0.25, 0.0) * 4], 1) for n, s in enumerate(sizes)]
    got = vptree.nearest(frame(spark, rows), shard_rows=128)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_nearest(rows))


def test_relaxed_search_prunes_and_keeps_recall(spark):
    rows = clustered(2000, groups=40)
    want = {(q, i) for q, _, i, _ in brute_nearest(rows, every=100)}
    got = {(r.query_id, r.vec_id) for r in vptree.nearest(frame(spark, rows), every=100, factor=1.3, shard_rows=1000).collect()}
    assert len(got & want) >= 0.9 * len(want)
    points = np.array([v for _, v, _ in rows])
    longest = np.sqrt((points**2).sum(1).max())
    full = np.concatenate([points, np.sqrt(np.maximum(0, longest**2 - (points**2).sum(1)))[:, None]], axis=1)
    visits = []
    for factor in (1.0, 1.3, 3.0):
        at = vptree.Search(vptree.Tree(full), np.arange(len(points)), points, np.arange(20), points[:20], 5, factor, longest)
        at.run()
        visits.append(at.visited)
    assert visits[0] > visits[1] > visits[2]


def test_no_rows(spark):
    assert vptree.nearest(frame(spark, [])).count() == 0
    assert embed_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert vptree.nearest(frame(spark, ODD[:7])).count() == 0


def brute_links(rows, threshold=0.93):
    """Per vec_id: links and smallest reachable id."""
    ok = {}
    for i, v, label in rows:
        if i is not None:
            ok[i] = (v, label)
    use = [(i, np.array(v), l) for i, (v, l) in ok.items() if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in ok}
    for n, (i, a, l) in enumerate(use):
        for j, b, m in use[:n]:
            if l == m and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in ok:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((i, len(near[i]), min(seen), i == min(seen)))
    return sorted(out)


@pytest.mark.parametrize("tile", [64, 1024])
def test_links(spark, tile):
    rows = clustered(400) + ODD
    rows += [(7000 + i, rows[4][1], 1) for i in range(90)] + [(8000, [x * 1e200 for x in rows[4][1]], 1)]
    random.Random(1).shuffle(rows)
    got = embed_dedup.near_duplicates(frame(spark, rows + rows[:5]), tile=tile, sample=100)
    got = sorted(tuple(r) for r in got.collect())
    assert [g for g in got if g[0] != 8000] == [w for w in brute_links([(i, [x / 1e200 for x in v] if i == 8000 else v, l) for i, v, l in rows]) if w[0] != 8000]


def test_queries_on_whole_table(spark, sf_dir):
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op2_vp_tree(spark, sf_dir).collect()) == sorted(brute_nearest(rows))
    assert sorted(tuple(r) for r in op5_embedding_dedup(spark, sf_dir).collect()) == brute_links(rows)
