"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are rotated into the principal axes of a bounded sample, so that leading coordinates hold most
of the length. Tiles of bounded size follow the first axis within a label; two tiles meet only if
their ranges on that axis leave the threshold in reach. In a pair of tiles the products of the leading
coordinates are added block by block; the rest is bounded by the product of the suffix norms, and a
pair of vectors stops as soon as its cosine cannot reach the threshold. What is left is decided on
the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivetrace.llm.common import components, written
from drivetrace.llm.vectors import matrix, one_row_each, usable

#: Added dimension counts at which the bound is tested again, and the slack that rounding needs.
STEPS, SLACK = (8, 16, 32), 1e-9


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two at their largest component: exact, and no square overflows."""
    return m / np.exp2(np.floor(np.log2(np.abs(m).max(axis=1))))[:, None]


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def principal_axes(valid: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """For each vector length, the axes of a sample of at most ``sample`` vectors, longest spread first."""
    rows = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r[0]), []).append(r[0])
    axes = {}
    for length, vectors in by_length.items():
        m = unit(scaled(np.array(vectors, dtype=np.float64)))
        axes[length] = np.linalg.eigh(m.T @ m)[1][:, ::-1].copy()
    return axes


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool):
    """Index pairs of rows of ``a`` and ``b`` with cosine of at least ``threshold``."""
    a, b = unit(scaled(a)), a if same else unit(scaled(b))
    b = a if same else b
    ra, rb = (a, b) if axes is None else (a @ axes, b @ axes)
    d = a.shape[1]
    ends = [s for s in STEPS if s < d]
    tails = {s: (np.sqrt((ra[:, s:] ** 2).sum(1)), np.sqrt((rb[:, s:] ** 2).sum(1))) for s in ends}
    found_i, found_j = [], []
    for top in range(0, len(a), 256):
        rows = slice(top, top + 256)
        first = ends[0] if ends else d
        part = ra[rows, :first] @ rb[:, :first].T
        reach = part + tails[first][0][rows, None] * tails[first][1][None, :] if ends else part
        i, j = np.nonzero(reach >= threshold - SLACK)
        if same:
            i, j = i[i + top < j], j[i + top < j]
        dots = part[i, j]
        i = i + top
        for at, end in zip(ends, [*ends[1:], d]):
            dots = dots + np.einsum("ij,ij->i", ra[i, at:end], rb[j, at:end])
            if end < d:
                alive = dots + tails[end][0][i] * tails[end][1][j] >= threshold - SLACK
                i, j, dots = i[alive], j[alive], dots[alive]
        near = dots >= threshold - SLACK
        found_i.append(i[near])
        found_j.append(j[near])
    return np.concatenate(found_i), np.concatenate(found_j)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, tile: int = 1024, sample: int = 4096
) -> DataFrame:
    """Links of vectors with equal label and cosine >= ``threshold``: vec_id, n_links, component_id, kept.

    ``vectors`` has vec_id, embedding (array of numbers) and label; other columns are ignored. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows with a null label, link
    with nothing; lengths that differ never link. Of rows with one vec_id the smallest (label,
    embedding) stands for all, so that copies of a row count once. Rows without vec_id have no name to
    report and are left out. ``sample`` bounds the vectors that fit the axes; all rows are compared.
    """
    table = one_row_each(vectors.select("vec_id", "label", "embedding"), "label", "embedding")
    valid = table.where(usable(F.col("embedding")) & F.col("label").isNotNull())
    axes = principal_axes(valid, sample)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def tiles(parts):
        number, held = TaskContext.get().partitionId() << 32, None

        def packed(rows: pd.DataFrame):
            nonlocal number
            number += 1
            return pd.DataFrame(
                {
                    "label": [rows.label.iloc[0]], "length": [rows.length.iloc[0]], "tile": [number],
                    "low": [rows.lead.min()], "high": [rows.lead.max()],
                    "ids": [rows.vec_id.to_numpy(np.int64).tobytes()], "rows": [matrix(rows.embedding).tobytes()],
                }
            )

        for pdf in parts:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(held):
                continue
            groups = [g for _, g in held.groupby(["label", "length"], sort=False)]
            for g in groups[:-1]:
                for k in range(0, len(g), tile):
                    yield packed(g.iloc[k : k + tile])
            last, k = groups[-1], 0
            while len(last) - k > tile:
                yield packed(last.iloc[k : k + tile])
                k += tile
            held = last.iloc[k:]
        if held is not None and len(held):
            for k in range(0, len(held), tile):
                yield packed(held.iloc[k : k + tile])

    def compared(parts):
        for pdf in parts:
            for r in pdf.itertuples():
                same = r.tile_a == r.tile_b
                ia, a = np.frombuffer(r.ids_a, np.int64), np.frombuffer(r.rows_a).reshape(-1, r.length)
                ib, b = (ia, a) if same else (np.frombuffer(r.ids_b, np.int64), np.frombuffer(r.rows_b).reshape(-1, r.length))
                i, j = linked_pairs(a, b, axes.get(r.length), threshold, same)
                exact = np.concatenate([cosines(a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
                i, j = i[exact >= threshold], j[exact >= threshold]
                ids = np.concatenate([ia] if same else [ia, ib])
                j = j if same else j + len(ia)
                order = np.argsort(ids, kind="stable")  # roots are the smallest ids, not the smallest places
                place = np.empty(len(ids), np.int64)
                place[order] = np.arange(len(ids))
                n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                root = ids[order][local_roots(len(ids), place[i], place[j])[place]]
                yield pd.DataFrame({"a": ids[n > 0], "b": root[n > 0], "n": n[n > 0]})

    placed = valid.withColumns({"length": F.size("embedding"), "lead": _lead(axes)})
    ranged = placed.repartitionByRange("label", "length", "lead", "vec_id").sortWithinPartitions("label", "length", "lead", "vec_id")
    kind = dict(valid.dtypes)["label"]
    packs = written(ranged.mapInPandas(tiles, f"label {kind}, length int, tile long, low double, high double, ids binary, rows binary"), "tiles")
    plan = packs.select("label", "length", "tile", "low", "high")
    other = plan.select("label", "length", *(F.col(c).alias(f"{c}_b") for c in ("tile", "low", "high")))
    met = plan.join(other, ["label", "length"]).where(
        (F.col("tile") <= F.col("tile_b")) & (F.col("low_b") <= F.col("high") + reach) & (F.col("low") <= F.col("high_b") + reach)
    )
    met = met.select("length", F.col("tile").alias("tile_a"), "tile_b")
    for s in "ab":
        met = met.join(packs.select(F.col("tile").alias(f"tile_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("rows").alias(f"rows_{s}")), f"tile_{s}")
    links = written(met.mapInPandas(compared, "a long, b long, n long"), "links")
    roots = components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    return (
        table.select("vec_id")
        .join(counts, "vec_id", "left")
        .join(roots.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def _lead(axes: dict[int, np.ndarray]) -> Column:
    """The first coordinate of the unit vector along the axes of its length; that of the vector itself without axes."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    small = F.transform("embedding", lambda x: x.cast("double") / most)
    add = lambda s, x: s + x
    along = F.element_at(small, 1)
    for length, basis in axes.items():
        axis = F.array(*map(F.lit, basis[:, 0].tolist()))
        product = F.aggregate(F.zip_with(small, axis, lambda x, y: x * y), F.lit(0.0), add)
        along = F.when(F.size("embedding") == length, product).otherwise(along)
    return along / F.sqrt(F.aggregate(F.transform(small, lambda x: x * x), F.lit(0.0), add))
