"""Shared-folder tables: lineage is cut by writing a table where every executor and the driver can read it."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.session import new_path, own_dir

#: Bytes of ids that are broadcast at most; beyond it a join is left to shuffle.
BROADCAST_BYTES = 32 * 2**20


@dataclass
class _Block:
    """What a block of scratch() has seen made."""

    paths: list[str] = field(default_factory=list)
    lasting: set[str] = field(default_factory=set)
    broadcasts: list[Broadcast] = field(default_factory=list)


#: The open blocks of scratch(), of this thread alone.
_SCRATCH: contextvars.ContextVar[tuple[_Block, ...]] = contextvars.ContextVar("scratch", default=())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has stored, once nothing reads their results any more."""
    _delete(spark, own_dir(spark))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return a reader of it, without df's lineage."""
    return _stored(df, label)[0]


def _stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, label)
    for block in _SCRATCH.get():
        block.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(df: DataFrame) -> None:
    """Delete the table behind what stored() returned, once nothing reads it any more."""
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, top)


def shared(spark: SparkSession, value) -> Broadcast:
    """value at all executors; it goes with the innermost open block of scratch(), else once nothing refers to it."""
    made = spark.sparkContext.broadcast(value)
    if blocks := _SCRATCH.get():
        blocks[-1].broadcasts.append(made)
    return made


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete the tables stored inside the block, and the values shared in it, at its end, but those stored by the function
    that it yields. Blocks of other threads are not concerned.

    with scratch(spark) as keep: out = keep(query(...), "result")
    """
    block = _Block()

    def keep(df: DataFrame, label: str) -> DataFrame:
        out, path = _stored(df, label)
        block.lasting.add(path)
        return out

    token = _SCRATCH.set((*_SCRATCH.get(), block))
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for path in block.paths:
            if path not in block.lasting:
                _delete(spark, path)
        for made in block.broadcasts:
            made.destroy()


def sampled(key: Column, share: float, seed: str) -> Column:
    """Whether a row is in the sample that has this share of the keys, by all 64 bits of a hash: any share above 1e-18 works.

    Samples of different seeds are independent of each other.
    """
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(key, F.lit(seed)) < F.lit(bound(share)).cast("long")


def bound(share: float) -> int:
    """The signed 64-bit number that this share of all such numbers is under."""
    return int(share * 2**64) - 2**63


#: Bytes of an Arrow batch at most, so that a task's memory doesn't follow the length of its texts.
BATCH_BYTES = 2**20


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes (a session setting, as Spark has no other place for it).

    Python workers are used again, by other operators too, so a task hands the memory it has freed back to the system.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        yield from f(batches)
        _release()

    return df.mapInArrow(run, schema)


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def few(ids: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """ids, a stored table of fixed-width columns, marked for broadcast while its rows take at most ``most`` bytes."""
    width = 16 + 8 * len(ids.columns)
    return F.broadcast(ids) if ids.count() * width <= most else ids


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone. Rows with null doc_id stay."""
    ids = stored(gone.select("doc_id").where("doc_id is not null").distinct(), "gone")
    return docs.join(few(ids), "doc_id", "left_anti").select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """(_row, _doc): docs' rows as structs, written with a number each, so that verdicts can be given row by row."""
    return stored(docs.select(F.struct(*docs.columns).alias("_doc")).withColumn("_row", F.monotonically_increasing_id()), "rows")


def remaining(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """What is left of numbered() rows without those whose _row is in gone, still numbered."""
    return rows.select("_row", "_doc").join(few(stored(gone.select("_row"), "gone")), "_row", "left_anti")
