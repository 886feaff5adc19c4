"""Session defaults and the few helpers that touch the cluster's settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

# A side is broadcast only after a count has shown that it has at most this
# many rows; past it the same join runs as a shuffle join.
BROADCAST_ROWS = 200_000


def build_session(app: str = "tabweave", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master,
    where driver and executors share one disk, may fall back to a temporary
    folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        current = tempfile.mkdtemp(prefix="tabweave-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables an operator writes."""
    return f"{shared_dir(spark).rstrip('/')}/tabweave/{uuid.uuid4().hex}/{name}"


def freeze(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder.

    Used where several later jobs read the same fitted or aggregated table;
    it outlives lost executors, unlike a cache.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_PLAIN = (BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType)


def store(df: DataFrame) -> DataFrame:
    """``freeze`` as Parquet, for tables with a row per input row: a fraction of
    the bytes, and a later job reads the columns it needs."""
    if any(not isinstance(f.dataType, _PLAIN) for f in df.schema) or len({c.lower() for c in df.columns}) < len(df.columns):
        return freeze(df)  # what Parquet does not hold
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` (frozen, so cheap to read) has no more than ``rows`` rows."""
    return df.count() <= rows


def small_side(frozen: DataFrame, rows: int = BROADCAST_ROWS, counted: int | None = None) -> DataFrame:
    """Mark ``frozen`` for broadcast if its counted size allows it."""
    fits = counted <= rows if counted is not None else has_at_most(frozen, rows)
    return F.broadcast(frozen) if fits else frozen


def sizes_by(frozen: DataFrame, column: str) -> dict[str, int]:
    """Rows per value of a column that names the parts of a fitted table."""
    return {r[0]: r[1] for r in frozen.groupBy(column).count().collect()}


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small scan or frozen table out to all cores.

    For work that is heavy per row: a file with a single row group is one task
    however much there is to compute. Tables that come in as many partitions
    as there are cores, as any large one does, are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
