"""Durable intermediate tables and size-checked lookups."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest lookup side, in rows, that is broadcast: some 30 MB in the driver, of which a loop's rounds hold several.
BROADCAST_ROWS = 100_000
#: Narrow rows of one key (a few numbers a volume) take a fifth of that: this many times as many are broadcast.
NARROW = 5


def workspace(spark: SparkSession) -> str:
    """Shared folder of this application, below ``spark.checkpoint.dir``.

    Where the setting is missing, a session on one machine gets a folder of its own;
    on a cluster that is an error, because executors would not see each other's files.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{context.applicationId}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage durably: a lost executor re-reads files instead of
    replaying earlier rounds, and later joins are planned on real sizes.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing will read again, such as those of earlier rounds."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows (stops counting beyond)."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join ``big`` to a lookup side whose size is checked first.

    ``small`` is evaluated once, into a stored table whose files tell the number of rows.
    Up to ``BROADCAST_ROWS`` (``NARROW`` times as many if rows are a key and up to three numbers)
    it is broadcast; beyond, Spark joins by shuffle and splits
    keys that turn out hot.  The hint is needed: Spark judges a stored table by its
    compressed files, and would broadcast millions of rows of ten megabytes.
    """
    if not hasattr(small, "_stored_at"):
        small = store(small, "lookup")
    narrow = len(on) == 1 and len(small.columns) <= 4 and all(isinstance(f.dataType, T.NumericType) for f in small.schema)
    most = BROADCAST_ROWS * NARROW if narrow else BROADCAST_ROWS
    return big.join(F.broadcast(small) if small.count() <= most else shuffled(small), on, how)


def shuffled(side: DataFrame) -> DataFrame:
    """``side`` of a join that grows with the input: never broadcast, however well its files compress."""
    return side.hint("merge")


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for df in rest:
        first = first.unionByName(df)
    return first


def by_block(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows to tasks by block before a grouped-map step.

    The partition count is pinned to ``spark.sql.shuffle.partitions``: merging
    small partitions would leave compute-heavy blocks on too few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
