"""Shared pieces: the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset and all runs in one process, as in tests, a temporary folder is set in its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="drivetrace-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later plans start there, also after a loss. ``options`` are the
    writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_texts(documents: DataFrame) -> DataFrame:
    """The two columns ``doc_id`` and ``text``; a null text is an empty one."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def block_count(texts: DataFrame, bytes_each: int) -> int:
    """Blocks of about ``bytes_each`` text bytes that a table of texts is dealt into."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, -(-total // bytes_each))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node reachable from each node of the undirected ``edges`` (a, b): columns node, root.

    Alternates the large-star and the small-star step until every node points at a root. A node with
    many neighbours is no bottleneck: its smallest neighbour is found by an aggregate that combines before
    the shuffle, and the join back can be split. Each round is written to the shared folder. Null nodes
    and loops are ignored; without edges the result is empty.
    """

    def directed(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    def flat(df: DataFrame) -> bool:
        """Whether each node has one neighbour below it, and that one none."""
        ends = df.select(F.col("a").alias("node"), "b").union(df.select("b", F.lit(None).cast("long")))
        nodes = ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count_if(F.col("b").isNull()).alias("below"))
        return nodes.where("low <> high OR (low IS NOT NULL AND below > 0)").isEmpty()

    now = written(directed(edges.select("a", "b")), name)
    while not flat(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = directed(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(directed(small.union(lowest.select("a", F.col("m").alias("b")))).distinct(), name)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b"))
    return nodes.distinct()
