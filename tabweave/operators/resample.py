"""Class rebalancing: interpolated minority rows, dropped majority rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.hashing import row_hash, uniform
from tabweave.operators.neighbors import knn
from tabweave.operators.sample import global_rank, minority, sample_n
from tabweave.session import freeze


def smote_rows(minor: DataFrame, features: Sequence[str], key: str, n: int, k: int = 5, seed: object = 5,
               **limits: int) -> DataFrame:
    """``n`` new rows ``base + gap * (neighbour - base)``.

    Row i picks its base row, one of the base's k nearest rows and the gap
    from three words of one hash. Both look-ups are equi-joins on keys that
    are spread evenly, since the picks are uniform. Output columns: ``row_id``,
    ``base``, ``neighbour`` and the features.
    """
    minor = freeze(minor.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in features]))
    count = minor.count()
    if count <= k:
        raise ValueError(f"{k} neighbours need at least {k + 1} rows of the smaller class, there are {count}")
    near = knn(minor, key, list(features), k, **limits)
    ranked = global_rank(minor, [key], seed, into="_rank")
    bases = ranked.join(near, key).select(
        "_rank", F.col(key).alias("base"), *[F.col(c).alias(f"_b_{c}") for c in features], "neighbours")
    spark = minor.sparkSession
    h = row_hash(["row_id"], seed)
    picks = spark.range(n).select(
        F.col("id").alias("row_id"),
        (F.floor(uniform(h, 0) * count) + 1).cast("long").alias("_rank"),
        F.floor(uniform(h, 1) * k).cast("int").alias("_pick"),
        uniform(h, 2).alias("_gap"))
    chosen = picks.join(bases, "_rank").withColumn("neighbour", F.get("neighbours", F.col("_pick"))["neighbour"])
    others = minor.select(F.col(key).alias("neighbour"), *[F.col(c).alias(f"_n_{c}") for c in features])
    both = chosen.join(others, "neighbour")
    return both.select("row_id", "base", "neighbour", *[
        (F.col(f"_b_{c}") + F.col("_gap") * (F.col(f"_n_{c}") - F.col(f"_b_{c}"))).alias(c) for c in features])


def smote_size(few: int, many: int, ratio: float) -> int:
    """New rows that lift the smaller class to ``int(ratio * larger)``."""
    n = int(ratio * many) - few
    if n < 0:
        raise ValueError(f"the smaller class already exceeds ratio {ratio}")
    return n


def smote(df: DataFrame, label: str, features: Sequence[str], key: str, ratio: float = 1.0, k: int = 5,
          seed: object = 5, **limits: int) -> DataFrame:
    """The input features and label plus the interpolated minority rows."""
    (value, few), (_, many) = minority(df, label)
    real = df.select(*[F.col(c).cast("double").alias(c) for c in features], label)
    new = smote_rows(df.where(F.col(label) == F.lit(value)), features, key, smote_size(few, many, ratio), k, seed, **limits)
    return real.unionByName(new.select(*features, F.lit(value).cast(df.schema[label].dataType).alias(label)))


def rebalance(df: DataFrame, label: str, features: Sequence[str], key: str, over: float = 0.1, under: float = 0.5,
              k: int = 5, seed: object = 5, **limits: int) -> DataFrame:
    """SMOTE up to ``over``, then undersample down to ``under``."""
    (value, few), (other, many) = minority(df, label)
    grown = few + smote_size(few, many, over)
    keep = int(grown / under)
    if keep > many:
        raise ValueError(f"ratio {under} asks for {keep} majority rows, there are {many}")
    small = df.where(F.col(label) == F.lit(value))
    new = smote_rows(small, features, key, grown - few, k, seed, **limits)
    kind = df.schema[label].dataType
    cast = [F.col(c).cast("double").alias(c) for c in features]
    return (
        small.select(*cast, label)
        .unionByName(new.select(*features, F.lit(value).cast(kind).alias(label)))
        .unionByName(sample_n(df.where(F.col(label) == F.lit(other)), keep, [key], seed).select(*cast, label))
    )
