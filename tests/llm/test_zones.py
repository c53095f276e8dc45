import hashlib
import math

import numpy as np
import pytest

from drivetrace.llm import zones

KIND = "vec_id long, embedding array<double>, label int, cluster int, key string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], KIND)


def groups(n, d=64, k=10, noise=0.05, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=0.3, size=(k, d))
    return [(i * 3, [float(x) for x in centres[i % k] + rng.normal(scale=noise, size=d)]) for i in range(n)]


def brute(rows, k=8, rounds=10, seed=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) with plain Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        at = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    sums = [sum(d for d, c in at if c == n) for n in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums), names[c]) for (i, _), (d, c) in zip(kept, at)), key=str)


def result(df, **options):
    return sorted((tuple(r)[:6] for r in zones.clustered(df, **options).collect()), key=str)


ODD = [
    (100001, None), (100002, []), (100003, [1.0] * 63), (100004, [None] + [1.0] * 63), (100005, [math.nan] + [1.0] * 63),
    (100006, [math.inf] + [1.0] * 63), (100007, [0.0] * 64), (100008, [-0.0] * 64), (None, [0.1] * 64), (100009, [100.0] * 64),
]


@pytest.mark.parametrize("each", [7, 512])
def test_clusters(spark, each):
    rows = groups(220) + ODD + [(9001 + n, [0.25] * 64) for n in range(60)]  # a hot vector
    assert result(frame(spark, rows), each=each) == brute(rows)


def test_repeated_rows_count_each(spark):
    rows = groups(40) + groups(40)[:15]
    assert result(frame(spark, rows)) == brute(rows)


def test_few_and_none(spark):
    assert result(frame(spark, [])) == []
    assert result(frame(spark, ODD[:6])) == []
    for rows in (groups(1), groups(5), [(n, [0.5] * 64) for n in range(20)]):
        assert result(frame(spark, rows)) == brute(rows)


def test_large_components(spark):
    """Distances of large components are exact; those that could overflow are null and disturb nothing."""
    rows = groups(30) + [(5000, [130_000.0] * 64), (5001, [-130_000.5] * 64), (5002, [4000.3] * 32 + [-9.7] * 32)]
    far = [(6000, [1e300] * 64), (6001, [1e6] + [0.0] * 63)]
    got = result(frame(spark, rows + far))
    assert [r for r in got if r[0] not in (6000, 6001)] == brute(rows)
    assert [r[1:] for r in got if r[0] in (6000, 6001)] == [(None,) * 5] * 2


def test_other_lengths(spark):
    rows = [(n, [n / 7.0, float(n % 3)]) for n in range(50)]
    got = zones.clustered(frame(spark, rows), k=3, rounds=4, size=2).collect()
    assert len(got) == 50 and {r.cluster for r in got} <= {0, 1, 2}


def test_boxes_prune(spark):
    """Blocks of vectors in groups meet few of the centroids, and every vector keeps its nearest one."""
    rows = groups(3000, noise=0.02, k=8)
    got = zones.clustered(frame(spark, rows), each=64).collect()
    assert np.mean([r.candidates for r in got]) < 4
    assert result(frame(spark, rows), each=64) == result(frame(spark, rows), each=5000)


def test_hilbert_neighbours_touch():
    """Places one after another on the curve differ by one step on one axis, and every cell has one."""
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = [k.tobytes() for k in zones.hilbert(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[np.array(sorted(range(len(cells)), key=keys.__getitem__))]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
