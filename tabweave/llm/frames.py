"""Small helpers shared by the operators: tables, materialised stages, Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.session import scratch_path

# The separators are 0x09-0x0D and the space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and
    still there when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for work that takes one batch at a time."""
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(over, schema)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names, in either case, under fresh ones,
    and the names to give back with ``withColumnsRenamed``."""
    used = {c.lower() for c in (*docs.columns, *names)}
    back = {}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            fresh = c
            while fresh.lower() in used:
                fresh += "_"
            used.add(fresh.lower())
            back[fresh] = c
    return docs.withColumnsRenamed({c: fresh for fresh, c in back.items()}), back
