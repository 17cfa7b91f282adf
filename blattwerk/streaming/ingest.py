"""The inbox as a stream, a cache kept up to date by it, and windowed events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blattwerk.sources.readers import SUFFIXES, name_of


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as a stream: ``path``, ``length``, ``modificationTime``, ``content``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(folder)
    name = name_of(F.col("path"))
    return files.where(~F.startswith(name, F.lit("~$")) & ~F.startswith(name, F.lit(".")))


def process_inbox(files: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Every file that is there goes through ``step`` once, then the stream ends.

    A file that fails is a row with an error, as ``step`` says; a batch that is
    cut off is done again, and its part of the target is written over.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, time: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of kinds by tumbling window; events later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def deduplicated(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """A stream without events delivered twice within ``late``."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
