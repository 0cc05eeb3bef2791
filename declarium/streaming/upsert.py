"""Streams of declarations: windowed counts, duplicates, and a cache kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.caches import latest, upsert


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows for each window and group; state older than ``late`` is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def first_arrivals(stream: DataFrame, time: str, key: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def keep_cache(stream: DataFrame, key: str, order: list[str], folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert every micro-batch into a Parquet table of versions below ``folder``.

    A batch writes ``v=<batch id>`` from the version before it, so a batch that runs
    again after a failure overwrites its own result."""

    def merge(batch: DataFrame, number: int) -> None:
        new = latest(batch, [key], order)
        old = version(batch.sparkSession, folder, number - 1)
        out = new if old is None else upsert(old, new, key)
        out.write.mode("overwrite").parquet(f"{folder}/v={number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def version(spark, folder: str, number: int) -> DataFrame | None:
    if number < 0:
        return None
    return spark.read.parquet(f"{folder}/v={number}")
