"""Small helpers on DataFrames for the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a lookup side that may be broadcast.
BROADCAST_ROWS = 100_000


#: Most texts in one Arrow batch; a batch, not only a slice of it, is in memory at once.
BATCH_ROWS = 1_000


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows: texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if it has at most ``rows`` rows; else a plain join side.

    Counting stops beyond the bound.  ``df`` should be stored or cheap.
    """
    few = df.select(F.lit(1)).limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def with_columns(df: DataFrame, **new: T.DataType) -> T.StructType:
    """Schema of ``df`` with the new columns behind it.

    A column of the same name is an error of the caller: see ``fresh``.
    """
    return T.StructType([*df.schema.fields, *(T.StructField(k, t) for k, t in new.items())])


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without earlier columns of these names: results replace them."""
    taken = {n.lower() for n in names}
    return df.drop(*(c for c in df.columns if c.lower() in taken))


def text_of(df: DataFrame, name: str = "text"):
    return F.coalesce(df[name], F.lit(""))


def kth_largest(df: DataFrame, name: str, k: int, last: int = 10_000, bins: int = 4096) -> float | None:
    """The k-th largest value of a double column, exactly; None if k < 1.

    Counts per bin narrow the interval until few values are left, so neither a
    task nor the driver ever sorts all of them.
    """
    low, high, n = df.agg(F.min(name), F.max(name), F.count(name)).first()
    if k < 1 or n == 0:
        return None
    k = min(k, n)
    inside, rest = df.select(F.col(name).alias("v")).where("v is not null"), k
    while n > last and low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
        rows = inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for b in sorted(rows, key=lambda r: -r["b"]):
            if rest <= b["n"]:
                inside, low, high, n = inside.where((F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"])), b["lo"], b["hi"], b["n"]
                break
            rest -= b["n"]
    if low == high:
        return low
    counts = inside.groupBy("v").count().orderBy(F.desc("v")).limit(last + bins).collect()
    for r in counts:
        if rest <= r["count"]:
            return r["v"]
        rest -= r["count"]
    return low
