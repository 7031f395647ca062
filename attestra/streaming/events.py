"""Streams of events with late and repeated rows: each event once, sessions, and pairs of events that follow each other.

What is late: a batch's watermark is the newest event time of the batches before it, less ``late``. A row is late if its time is not after the
watermark; a session takes a row whose session would end after it. Late rows are dropped, wherever they would have gone: that bounds the state,
which holds ids, sessions and unpaired rows no older than the watermark. Rows with a null time or key never end a session, so they go at the start.

Each function takes a streaming frame and returns one; caught_up() runs it over all files there are, so that a later run goes on
from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """All files below a folder, as they come. A row that isn't of the schema has nulls."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").format(kind).load(path)


def once(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """Rows whose key hasn't been seen; repeats within the watermark's delay go, and all that is late."""
    known = stream.where(F.col(ts).isNotNull())
    return known.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str | None = None, value: str | None = None) -> DataFrame:
    """(key, began, ended, events[, total]): rows of a key less than gap apart are one session, given out when the watermark has
    passed its end, gap after its last row. late is left out where the stream already has a watermark, as after once()."""
    told = _marked(stream, ts, late).where(F.col(key).isNotNull())
    sums = [F.sum(value).alias("total")] if value else []
    grouped = told.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), *sums)
    return grouped.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events", *[c for c in ("total",) if value])


def followed(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, late: str | None = None, how: str = "inner") -> DataFrame:
    """Pairs of a left row and a right row of the same key that comes after it, at most ``within`` later. leftOuter: left rows
    without one too, with nulls, once the watermark tells that none can come. late as in sessions()."""
    a, b = _marked(left, left_ts, late), _marked(right, right_ts, late).withColumnRenamed(key, f"_{key}")
    on = (F.col(key) == F.col(f"_{key}")) & (F.col(right_ts) > F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}"))
    return a.join(b, on, how).drop(f"_{key}")


def _marked(stream: DataFrame, ts: str, late: str | None) -> DataFrame:
    return stream if late is None else stream.where(F.col(ts).isNotNull()).withWatermark(ts, late)


def caught_up(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what the stream gives for all files not yet read to path, and return path's rows so far."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
