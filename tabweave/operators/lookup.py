"""Nearest-key lookups on a number line without a cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.ordered import ONE_TASK_ROWS, carry, layout
from tabweave.session import freeze, has_at_most

# Up to this many keys the sorted key list travels in the plan.
LISTED_KEYS = 10_000


def _listed(df: DataFrame, value: str, table: DataFrame, key: str) -> DataFrame:
    """Add ``_below`` (last key <= value) and ``_above`` (first key >= value) by
    binary search in the sorted keys, row by row and with no shuffle."""
    keys = sorted(r[0] for r in table.select(key).where(F.col(key).isNotNull()).distinct().collect())
    if not keys:
        return df.withColumns({"_below": F.lit(None).cast("double"), "_above": F.lit(None).cast("double")})
    splits = [float("-inf"), *keys, float("inf")]
    search = Bucketizer(splits=splits, inputCol=value, outputCol="_slot", handleInvalid="keep")
    # _slot = number of keys <= value (nulls land in an extra last slot)
    slot = F.col("_slot").cast("int")
    found = search.transform(df)
    listed = F.lit(keys) if len(keys) > 1 else F.array(F.lit(keys[0]))
    below = F.when(F.col(value).isNotNull() & (slot > 0), F.get(listed, slot - 1))
    above = F.when(F.col(value).isNotNull(), F.get(listed, slot))
    return found.withColumn("_below", below).withColumn(
        "_above", F.when(F.col("_below") == F.col(value), F.col("_below")).otherwise(above)
    ).drop("_slot")


def _merged(df: DataFrame, value: str, table: DataFrame, key: str, columns: Sequence[str], one_task_rows: int) -> DataFrame:
    """Add ``_lower`` and ``_upper``, the rows of ``table`` (key and ``columns``)
    on both sides of ``value``.

    Rows and keys are put in one order, cut into ranges, and each range is told the
    keys at its edges, so nothing is joined back by value. A hash of the row
    stands last in the order: a value that a third of all rows have is cut too.
    """
    whole = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    entry = F.struct(F.col(key).cast("double").alias("_key"), *columns)
    rows = df.withColumns({"_x": F.col(value).cast("double"), "_kind": F.lit(1), "_tie": F.xxhash64(*whole)})
    keys = table.where(F.col(key).isNotNull()).select(
        F.col(key).cast("double").alias("_x"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"), entry.alias("_entry"))
    order = ["_x", "_kind", "_tie"]  # a key stands before the rows of its value
    laid = layout(rows.unionByName(keys, allowMissingColumns=True), [], order, one_task_rows=one_task_rows)
    up = carry(laid, [], order, {"_lower": ("max", "_entry")})
    both = carry(up, [], order, {"_after": ("min", "_entry")}, backward=True)
    upper = F.when(F.col("_lower._key") == F.col("_x"), F.col("_lower")).when(F.col("_x").isNotNull(), F.col("_after"))
    return both.where("_kind = 1").select(*df.columns, "_lower", upper.alias("_upper"))


def join_payload(
    df: DataFrame, at: str, table: DataFrame, key: str, payload: Sequence[str], prefix: str
) -> DataFrame:
    """Left join ``payload`` of the frozen ``table`` on ``df.at = table.key``."""
    side = table.select(F.col(key).alias(f"_{prefix}_key"), *[F.col(p).alias(f"{prefix}{p}") for p in payload])
    if has_at_most(table, LISTED_KEYS):
        side = F.broadcast(side)
    return df.join(side, df[at] == side[f"_{prefix}_key"], "left").drop(f"_{prefix}_key")


def nearest(
    df: DataFrame,
    value: str,
    table: DataFrame,
    key: str,
    tie: str,
    payload: Sequence[str],
    *,
    listed_keys: int = LISTED_KEYS,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add the payload of the key closest to ``value``; on equal distance the
    key with the smaller ``tie`` wins. Null values find nothing. ``table``
    holds each key once."""
    base = list(df.columns)
    table = freeze(table)
    columns = [tie, *[p for p in payload if p != tie]]
    if has_at_most(table, listed_keys):
        found = _listed(df, value, table, key)
        found = join_payload(found, "_below", table, key, columns, "_b_")
        found = join_payload(found, "_above", table, key, columns, "_a_")
    else:
        found = _merged(df, value, table, key, columns, one_task_rows)
        sides = {"_b_": "_lower", "_a_": "_upper"}
        found = found.select(*base, F.col("_lower._key").alias("_below"), F.col("_upper._key").alias("_above"),
                             *[F.col(side)[c].alias(mark + c) for mark, side in sides.items() for c in columns])
    left, right = F.col(value) - F.col("_below"), F.col("_above") - F.col(value)
    use_left = F.col("_above").isNull() | (left < right) | (
        (left == right) & (F.col(f"_b_{tie}") <= F.col(f"_a_{tie}"))
    )
    use_left = use_left & F.col("_below").isNotNull()
    return found.select(
        *base, *[F.when(use_left, F.col(f"_b_{p}")).otherwise(F.col(f"_a_{p}")).alias(p) for p in payload]
    )
