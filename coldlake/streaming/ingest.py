"""Structured Streaming into archives, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.sources.archive import append_archive, read_manifest, write_archive


def stream_to_archive(stream: DataFrame, path: str, checkpoint: str, **options):
    """Append each micro-batch of a stream to an archive; returns the started query.

    The batch number is kept in the archive's comment and changes with the same manifest swap as the
    batch's rows, so a batch that is replayed after a failure is not appended twice.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        try:
            manifest = read_manifest(spark, path)
        except FileNotFoundError:
            write_archive(batch, path, comment=f"batch {number}", **options)
            return
        done = int(manifest.comment.rpartition(" ")[2]) if manifest.comment.startswith("batch ") else -1
        if number <= done or batch.isEmpty():
            return
        append_archive(batch, path, verify=False, comment=f"batch {number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(df: DataFrame, time: str, width: str, keys: list[str] = (), late: str | None = None):
    """Rows grouped by window of event time and keys; ``late`` bounds the state of streams."""
    rows = df.withWatermark(time, late) if late else df
    return rows.groupBy(F.window(time, width).alias("window"), *keys)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str]):
    """Rows grouped by sessions that a pause of ``gap`` ends."""
    return df.groupBy(F.session_window(time, gap).alias("session"), *keys)


def stream_to_table(result: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write a stream's result rows to Parquet files with exactly-once commits, up to what is there now."""
    writer = result.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)
