"""Streams over append-only logs. The library's reference semantics have no streams: this is what the host offers on top.

Streams keep their state in Spark's checkpoint. A keyed table is a folder of versions, one for each batch, in buckets of the
key; a version holds the buckets that its batch touched, and the newest complete one of each bucket counts. A batch
reads and writes only the buckets it touches; one that is run again after a failure writes the same version again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.functions import urls
from attestra.operators.joins import keep_last

#: Buckets of a keyed table.
BUCKETS = 32


def read(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(path)


def merged(current: DataFrame | None, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The keyed table after a batch: of equal keys the row with the largest order counts, whichever side it is on."""
    rows = batch if current is None else current.unionByName(batch, allowMissingColumns=True)
    return keep_last(rows, F.col(key), [F.col(order)])


def keyed_sink(stream: DataFrame, table: str, checkpoint: str, key: str = "url_norm", order: str = "ts", available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the last row of each key of a stream of rows with url in the folder table. Buckets that two later versions hold go."""

    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        _drop_superseded(spark, table, version)
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most buckets rows
        before = {b: v for b, v in newest(spark, table, version).items() if b in touched}
        merged(_read(spark, table, before), rows, key, order).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={version}")

    rows = stream.withColumn("url_norm", urls.normalize_url(F.col("url"))) if "url" in stream.columns else stream
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _names(spark: SparkSession, path: str, prefix: str) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def newest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """bucket -> its newest complete version, of those before a version."""
    done = [v for v in _names(spark, table, "v=") if (before is None or v < before) and _exists(spark, f"{table}/v={v}/_SUCCESS")]
    return {b: v for v in done for b in _names(spark, f"{table}/v={v}", "bucket=")}


def _drop_superseded(spark: SparkSession, table: str, version: int) -> None:
    """Delete the buckets that the version before this one had already left behind; nothing reads them, even if it is run again."""
    current = newest(spark, table, version)
    for v in _names(spark, table, "v="):
        held = _names(spark, f"{table}/v={v}", "bucket=")
        old = [b for b in held if v < current.get(b, -1) < version]
        for path in [f"{table}/v={v}"] if held and len(old) == len(held) else [f"{table}/v={v}/bucket={b}" for b in old]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _read(spark: SparkSession, table: str, versions: dict[int, int]) -> DataFrame | None:
    parts = [spark.read.option("basePath", f"{table}/v={v}").parquet(*[f"{table}/v={v}/bucket={b}" for b, own in sorted(versions.items()) if own == v]) for v in sorted(set(versions.values()))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def latest(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of a keyed table, None before its first version."""
    found = _read(spark, table, newest(spark, table))
    return None if found is None else found.drop("bucket")


def status_counts(stream: DataFrame, ts: str, status: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of each status in tumbling windows; rows later than the watermark are dropped, which bounds the state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), status).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), status, "n")
