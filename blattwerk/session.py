"""Session helpers: tables, checkpoints, salted joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and everything runs in one local process, as in tests, a temporary folder is
    used, which is removed at exit; on a cluster without the setting this
    raises, since executors can't share a local path.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        own = tempfile.mkdtemp(prefix="blattwerk-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    Used where one result feeds several branches: a lost executor then costs a
    re-read, not a recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def salted_left_join(
    left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, by: Column | None = None
) -> DataFrame:
    """Left join of skewed ``left`` with ``right``, which has one row per key.

    ``right`` is replicated ``salts`` times, ``left`` takes a salt from ``by``
    (or from a hash of the row), so a key that holds a third of all rows is
    spread over ``salts`` tasks.
    """
    by = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if c not in on]) if by is None else by
    lo = left.withColumn("__salt", F.pmod(by, F.lit(salts)).cast("int"))
    ro = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn(
        "__salt", F.col("__salt").cast("int")
    )
    return lo.join(ro, [*on, "__salt"], "left").drop("__salt")


def in_ranges(df: DataFrame, key: list[str], order: list[str], name: str = "__range") -> DataFrame:
    """``df`` in ranges of ``key`` and ``order``, each row with its range's number.

    The numbers ascend in the order of the rows, so a key that holds a third of
    all rows is several ranges. The result is stored: the numbers stay the same.
    """
    return cut(df.repartitionByRange(*key, *order).withColumn(name, F.spark_partition_id()))


def carried(df: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` before the row in its key's order.

    ``order`` must be unique within the key. Values are carried within ranges,
    then from range to range, so no window ever holds a whole key.
    """
    r = in_ranges(df, key, order)
    inner = Window.partitionBy(*key, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per key and range; of these only the ranges of one key are in a window
    last = r.groupBy(*key, "__range").agg(F.max_by(value, F.struct(F.col(value).isNotNull(), *order)).alias("__v"))
    last = last.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__range").alias("__r"), F.last("__v", ignorenulls=True).over(upto).alias("__before"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)] + [F.col("__range") == F.col("__r")]
    j = r.withColumn("__inner", F.last(value, ignorenulls=True).over(inner)).join(last, on)
    return j.select(*df.columns, F.coalesce("__inner", "__before").alias(name))


def running_sum(df: DataFrame, key: list[str], order: list[str], value: Column, chunk: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to the row, by key.

    ``chunk`` must ascend with ``order``. Sums are taken by chunk, then over the
    chunks, so a key with a third of all rows is spread over many tasks.
    """
    sums = df.groupBy(*key, chunk).agg(F.sum(value).alias("__s"))
    upto = Window.partitionBy(*key).orderBy(chunk)
    sums = sums.select(*key, chunk, (F.sum("__s").over(upto) - F.col("__s")).alias("__before"))
    inner = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__in", F.sum(value).over(inner)).join(sums, [*key, chunk]).withColumn(name, F.col("__before") + F.col("__in")).drop("__before", "__in")
