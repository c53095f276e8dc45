"""Tables that a plan stores once, in the folder that driver and executors share.

A frame that several results need is computed once and read by each of them, also after executors are
lost. ``spark.checkpoint.dir`` names the folder; an application's tables lie in a folder of its own there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's folder. In one process (master ``local``) an unset folder is a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="drivetrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/drivetrace-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table; plans on it start there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """``df`` as a table in buckets by ``keys``: joins and aggregates on them need not exchange it.

    There are as many buckets as shuffle partitions, and rows are exchanged once before they are written, so
    that a bucket is one file.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys)
    writer.format("parquet").option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


#: Names of the tables of ``stored_by``.
_tables: list[str] = []


def clear_shared(spark: SparkSession) -> None:
    """Delete what this application has stored; frames on it can no longer be read."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS `{_tables.pop()}`")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
