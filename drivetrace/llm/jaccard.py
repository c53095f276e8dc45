"""Near-duplicate texts by word shingles and Jaccard similarity, with a chosen-path join.

Texts with equal sets of shingles are one class; its smallest document stands for it. A run of the join
splits the classes recursively: a bucket of sets is dealt by one of its sampled shared tokens, the
first token of a set in a random order that the path of the bucket chooses. Buckets that are small
enough, or that do not get smaller, are leaves. Each run finds a pair above the threshold with a
probability that the threshold bounds from below; runs repeat until the target recall.

In leaves all pairs are compared on their whole sets. Leaves of equal members count once, and a pair
counts in the first leaf that holds both, so that no link counts twice and none is ever listed: a
leaf gives the number of links of each member and a tree of links. Large leaves with members in common
are one leaf, compared in tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivetrace.llm import blocks as B
from drivetrace.llm.common import components, doc_texts, written
from drivetrace.llm.embed_dedup import local_roots
from drivetrace.llm.shingles import shingled

ORDERS = 32
_FACTORS = B._random.integers(1, 2**63, size=ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_needed(threshold: float, recall: float, levels: int) -> int:
    """Runs after which a pair at the threshold is found with probability ``recall`` at least."""
    found = threshold * (1 - (1 - threshold) ** 2) ** levels
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def _set_digest(hashes: np.ndarray) -> bytes:
    own = np.unique(hashes)
    return np.array([own.sum(dtype=np.uint64), (own * (own | np.uint64(1))).sum(dtype=np.uint64), len(own)], np.uint64).tobytes()


def _rows(documents: DataFrame) -> DataFrame:
    rows = doc_texts(documents)
    return rows.select(F.coalesce("doc_id", F.lit(B.NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("body"))


def sketches(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, digest of the set (null without words), and the first token in each of ORDERS orders."""

    def sketch(parts):
        for part in (some for batch in parts for some in B.sliced(batch, "body")):
            digest, least = [], []
            for _, hashes, offsets in shingled(part.column("body").to_pylist(), words):
                some = np.flatnonzero(np.diff(offsets))
                rows = np.zeros((len(offsets) - 1, ORDERS), np.uint32)
                if len(some):
                    for k in range(ORDERS):
                        v = hashes * _FACTORS[k]
                        v ^= v >> np.uint64(29)
                        rows[some, k] = np.minimum.reduceat((v >> np.uint64(32)).astype(np.uint32), offsets[some])
                for lo, hi, row in zip(offsets[:-1], offsets[1:], rows):
                    digest.append(_set_digest(hashes[lo:hi]) if hi > lo else None)
                    least.append(row.tobytes())
            digest, least = pa.array(digest, pa.binary()), pa.array(least, pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), digest, least], ["doc_id", "text_hash", "digest", "tokens"])

    return _rows(documents).mapInArrow(sketch, "doc_id long, text_hash long, digest binary, tokens binary")


def _token(tokens: F.Column, order) -> F.Column:
    return F.substring(tokens, order * 4 + 1, F.lit(4))


def leaves_of(classes: DataFrame, runs: int, leaf: int, levels: int) -> DataFrame:
    """Members of leaves: key, node; keys of one run are smaller than those of the next."""
    start = classes.select("node", "tokens", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    key = lambda *of: F.col("run").cast("long") * F.lit(1 << 56) + F.shiftrightunsigned(F.xxhash64(*of), 8)
    rows = start.select("run", "node", key("run", _token(F.col("tokens"), F.col("run"))).alias("key"))
    done = None
    for level in range(levels + 1):
        rows = written(rows, f"paths-{level}")
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"))
        sizes = sizes.where("size > 1")
        last = level == levels
        ready = sizes if last else sizes.where(F.col("size") <= leaf)
        # Leaves of equal members, in this level, are compared once.
        ready = ready.groupBy("size", "members").agg(F.min("key").alias("key"))
        found = rows.join(ready.select("key"), "key").select("key", "node")
        done = found if done is None else done.union(found)
        if last:
            break
        large = rows.join(sizes.where(F.col("size") > leaf).select("key"), "key")
        if large.isEmpty():
            break
        picks = [F.pmod(F.xxhash64("key", F.lit(n)), F.lit(ORDERS - runs)).cast("int") + runs for n in (0, 1)]
        large = large.join(classes.select("node", "tokens"), "node").select("run", "node", "key", "tokens", F.explode(F.array_distinct(F.array(*picks))).alias("order"))
        rows = large.select("run", "node", key("key", "order", _token(F.col("tokens"), F.col("order"))).alias("key"))
    return done.distinct()


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None, at_once: int = 1 << 20) -> np.ndarray:
    """Sizes of the intersections of sorted sets, by products of 0/1 matrices over some tokens at a time."""
    both = sets if others is None else sets + others
    n, total_size = len(sets), sum(len(s) for s in both)
    total = np.zeros((n, n if others is None else len(others)), np.float32)
    parts = max(1, -(-total_size // at_once))
    cuts = np.array([2**64 * k // parts for k in range(1, parts)], np.uint64)
    places = [np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]]) for s in both]
    for p in range(parts):
        some = [s[at[p] : at[p + 1]] for s, at in zip(both, places)]
        owner = np.repeat(np.arange(len(both)), [len(s) for s in some])
        values, token, counts = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
        rank = np.cumsum(counts > 1) - 1
        owner, token = owner[counts[token] > 1], rank[token[counts[token] > 1]]
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        edges = np.searchsorted(token, np.arange(0, (token[-1] if len(token) else -1) + 4097, 4096))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi > lo:
                m = np.zeros((len(both), int(token[hi - 1] - token[lo]) + 1), np.float32)
                m[owner[lo:hi], token[lo:hi] - token[lo]] = 1
                total += m[:n] @ (m if others is None else m[n:]).T
    return total


def near_texts(
    documents: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.9999, leaf: int = 256, levels: int = 3, tile: int = 512
) -> DataFrame:
    """Links of texts whose shingle sets have Jaccard similarity >= ``threshold``.

    doc_id, class_id (smallest doc_id reachable by links), n_links (other rows linked directly, copies
    included), kept (first row of its class), text_hash. One row per row of ``documents``. Words are
    separated by ASCII white space; a text of fewer than ``words`` words has one shingle of all of them;
    texts without words, also null ones, link with nothing. A null doc_id counts as larger than all and
    is null in the result. Of equal doc_ids that start a class, the smallest text_hash is kept; equal
    rows share their result. Columns other than doc_id and text are ignored.
    """
    runs = runs_needed(threshold, recall, levels)
    sketch = written(sketches(documents, words), "sketches")
    classes = sketch.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"), F.min("tokens").alias("tokens")
    )
    classes = written(classes.select(F.xxhash64("digest").alias("node"), "digest", "first.*", "copies", "tokens"), "classes")
    members = _gathered(written(leaves_of(classes, runs, leaf, levels), "leaves"), leaf)
    targets = _targets(members, leaf, tile)
    targets = targets.join(classes.select("node", "doc_id", "text_hash", "copies"), "node")
    texts = _rows(documents).groupBy("doc_id", "text_hash").agg(F.first("body").alias("body"))

    def sets(parts):
        names = ["bucket", "key", "side", "node", "copies", "keys", "body"]
        for pdf in parts:
            for first, hashes, offsets in shingled(pdf["body"].to_list(), words):
                out = []
                for n, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:]), first):
                    body = np.unique(hashes[lo:hi]).tobytes()
                    keys = np.array(pdf["keys"].iat[n], np.int64).tobytes()
                    out += [(t["bucket"], t["key"], t["side"], pdf["node"].iat[n], pdf["copies"].iat[n], keys, body) for t in pdf["targets"].iat[n]]
                yield pd.DataFrame(out, columns=names)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_compared(key, part, threshold) for key, part in pdf.groupby("key")])

    chosen = texts.join(targets, ["doc_id", "text_hash"]).select("node", "copies", "keys", "targets", "body")
    dealt = chosen.mapInPandas(sets, "bucket long, key long, side int, node long, copies long, keys binary, body binary")
    links = written(dealt.groupBy("bucket").applyInPandas(compared, "a long, b long, n long"), "links")
    roots = components(links.select("a", "b"), "linked").withColumnRenamed("root", "class")
    more = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    told = classes.select("node", "digest", "doc_id", "text_hash", "copies").join(more, "node", "left").join(roots, "node", "left")
    told = written(told.select("digest", "doc_id", "text_hash", F.coalesce("class", "node").alias("class"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "told")
    heads = told.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    told = told.select("digest", "class", "n_links").join(heads, "class").select("digest", "n_links", "head")
    result = sketch.select("doc_id", "text_hash", "digest").join(told, "digest", "left")
    named = lambda c: F.when(c != B.NO_ID, c)
    own = F.struct("doc_id", "text_hash")
    return result.select(
        named(F.col("doc_id")).alias("doc_id"),
        named(F.coalesce("head.doc_id", "doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        (F.coalesce("head", own) == own).alias("kept"),
        "text_hash",
    )


def distinct_texts(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that start their class, with all their columns, whatever they are called.

    Of rows equal in doc_id and text one stays. Texts without words are alone in their classes and stay.
    """
    kept = near_texts(documents, **options).where("kept").select("text_hash", F.coalesce("doc_id", F.lit(B.NO_ID)).alias("id"))
    # The row as one struct: no name of a column of its own meets those used here.
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    own = {"text_hash": F.xxhash64(F.coalesce("row.text", F.lit(""))), "id": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(B.NO_ID))}
    return rows.withColumns(own).join(kept, ["text_hash", "id"], "left_semi").dropDuplicates(["text_hash", "id"]).select("row.*")


def _gathered(members: DataFrame, leaf: int) -> DataFrame:
    """Large leaves that share members as one leaf, which comes before all others: key, node.

    A group of near-copies is too alike to be split, so every run leaves it as large leaves with mostly the
    same members. Taken together they are compared once, not once for each run.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("hub"))
    large = members.join(sizes.where(F.col("size") > leaf), "key")
    roots = components(large.select(F.col("node").alias("a"), F.col("hub").alias("b")), "large-leaves")
    key = -1 - F.shiftrightunsigned("root", 1)  # below every other key
    small = members.join(sizes.where(F.col("size") <= leaf).select("key"), "key").select("key", "node")
    return written(small.union(roots.select(key.alias("key"), "node")), "gathered")


def _targets(members: DataFrame, leaf: int, tile: int) -> DataFrame:
    """Where the set of each node is compared: node, keys (its leaves), targets (bucket, key, side).

    Leaves in which all members met before need no look. Small ones are gathered into buckets; large ones
    are cut into tiles, and each pair of tiles is a bucket. Side 0 is compared with itself, 1 with 2.
    """
    firsts = members.groupBy("node").agg(F.min("key").alias("first"), F.array_sort(F.collect_list("key")).alias("keys"))
    rows = members.join(firsts.select("node", "first"), "node")
    whole = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("first").alias("least"), F.max("first").alias("most"))
    whole = written(whole.where("size > 1 AND (least <> most OR least = key)").select("key", "size"), "open-leaves")
    small = whole.where(F.col("key") >= 0).select("key")
    in_small = rows.join(small, "key").select("node", F.pmod(F.xxhash64("key"), F.lit(max(8, small.count() // 64))).alias("bucket"), "key", F.lit(0).alias("side"))

    parts = whole.where(F.col("key") < 0).withColumn("parts", F.ceil(F.col("size") / tile).cast("int")).select("key", "parts")
    placed = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A tile meets itself and every other one.
    met = placed.select("node", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    bucket = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    in_large = met.select("node", bucket.alias("bucket"), "key", side.alias("side"))
    target = F.collect_list(F.struct("bucket", "key", "side")).alias("targets")
    return in_small.union(in_large).groupBy("node").agg(target).join(firsts.select("node", "keys"), "node")


def _compared(key: int, part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links among the members of a leaf, or between two tiles, that have no earlier leaf in common."""
    part = part.drop_duplicates(["side", "node"]).sort_values(["side", "node"])
    sets = [np.frombuffer(b, np.uint64) for b in part["body"]]
    mine, tiled = int((part["side"] < 2).sum()), bool(part["side"].max())
    shared = _overlaps(sets[:mine], sets[mine:] if tiled else None)
    size = np.array([len(s) for s in sets], np.float64)
    shift = mine if tiled else 0
    i, j = np.nonzero(shared >= (threshold - 1e-6) * (size[:mine, None] + size[None, shift:] - shared))
    if not tiled:
        i, j = i[i < j], j[i < j]
    both = shared[i, j].astype(np.float64)
    j = j + shift
    linked = both >= threshold * (size[i] + size[j] - both)
    i, j = i[linked], j[linked]
    earlier = [np.frombuffer(k, np.int64) for k in part["keys"]]
    earlier = [set(k[k < key].tolist()) for k in earlier]
    here = np.array([earlier[a].isdisjoint(earlier[b]) for a, b in zip(i.tolist(), j.tolist())], bool)
    i, j = i[here], j[here]
    ids, copies = part["node"].to_numpy(np.int64), part["copies"].to_numpy(np.int64)
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, i, copies[j])
    np.add.at(n, j, copies[i])
    order = np.argsort(ids)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root = ids[order][local_roots(len(ids), place[i], place[j])[place]]
    return pd.DataFrame({"a": ids[n > 0], "b": root[n > 0], "n": n[n > 0]})
