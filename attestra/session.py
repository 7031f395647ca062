"""Session and table helpers shared by the library, the tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the applications of this process.
_DIRS: dict[str, str] = {}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("attestra")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables. The path may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local master, as in tests, may do without: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _DIRS.setdefault("local", "file://" + tempfile.mkdtemp(prefix="attestra-"))


def own_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one. It goes when the application ends, whatever of it is left by then."""
    app = spark.sparkContext.applicationId
    if app not in _DIRS:
        _DIRS[app] = f"{shared_dir(spark)}/attestra-{app}"
        at = spark._jvm.org.apache.hadoop.fs.Path(_DIRS[app])
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return _DIRS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, so that all who read it see the same rows."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(rows: DataFrame, row_bytes: int | None = None, most: int = 32 * 2**20) -> DataFrame:
    """rows, a written table, marked for broadcast while it takes at most ``most`` bytes; beyond that joins shuffle it.

    row_bytes: what a row takes; by default that of fixed-width columns.
    """
    return F.broadcast(rows) if rows.count() * (row_bytes or 16 + 8 * len(rows.columns)) <= most else rows
