"""Category encoders and column scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.ordered import exact_quantiles, long_values, running
from tabweave.operators.clean import string_columns
from tabweave.operators.lookup import nearest
from tabweave.session import freeze, sizes_by, small_side

ENCODED = "_target_encoded"


@dataclass(frozen=True)
class EncoderTable:
    """A fitted target encoder: one row per (column, category) with n and mean."""

    table: DataFrame
    columns: tuple[str, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        """Replace each category by its mean, in a column placed at the end.

        Categories not seen in training, and nulls, get null.
        """
        out = df
        sizes = sizes_by(self.table, "column")
        for c in self.columns:
            side = small_side(self.table.where(F.col("column") == c).select(
                F.col("category").alias(f"_{c}"), F.col("mean").alias(c + ENCODED)), counted=sizes.get(c, 0))
            out = out.join(side, out[c] == side[f"_{c}"], "left").drop(f"_{c}")
        kept = [c for c in df.columns if c not in self.columns]
        return out.select(*kept, *[c + ENCODED for c in self.columns])

    def means(self, column: str) -> DataFrame:
        """The decoding dictionary of one column.

        Categories that share a mean collide: the first of them (in sorted
        order) fixes the place in the tie order, the last one is decoded to.
        """
        return (
            self.table.where(F.col("column") == column).groupBy("mean")
            .agg(F.min("category").alias("first_category"), F.max("category").alias("decoded"))
        )

    def decode(self, df: DataFrame, **limits: int) -> DataFrame:
        """Replace each encoded value by the category with the nearest mean."""
        out = df
        for c in self.columns:
            if c + ENCODED not in df.columns:
                raise ValueError(f"no encoded column for {c}")
            out = nearest(out, c + ENCODED, self.means(c), "mean", "first_category", ["decoded"], **limits)
            out = out.drop(c + ENCODED).withColumnRenamed("decoded", c)
        return out


def te_fit(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> EncoderTable:
    """Fit on training rows: one scan and one map-side-combined aggregate for
    all columns. ``None`` means every string column but the target."""
    names = list(columns) if columns is not None else string_columns(df, exclude=[target])
    long = df.select(F.col(target).cast("double").alias("_y"), *[F.col(c).cast("string").alias(c) for c in names])
    long = long.unpivot(["_y"], names, "column", "category").where(F.col("category").isNotNull())
    # sum/count of a 0/1 target is exact, so equal shares give equal means
    fitted = long.groupBy("column", "category").agg(
        F.count("_y").alias("n"), (F.sum("_y") / F.count("_y")).alias("mean"))
    return EncoderTable(freeze(fitted), tuple(names))


def te_roundtrip(df: DataFrame, target: str, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Encode, decode, and count the rows that come back unchanged, by column.

    The original categories ride along under other names, so nothing has to
    be joined back by key.
    """
    coder = te_fit(df, target, columns)
    kept = df.select(*key, target, *columns, *[F.col(c).alias(f"was_{c}") for c in columns])
    back = coder.decode(coder.apply(kept))
    pairs = back.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"was_{c}").eqNullSafe(F.col(c)).alias("same")) for c in columns
    ])).alias("p")).select("p.*")
    return pairs.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("same").alias("matches"))


def code_fit(df: DataFrame, columns: Sequence[str], **limits: int) -> DataFrame:
    """Sorted distinct values of each column numbered from 0:
    ``(column, value, code)``."""
    distinct = long_values(df, columns, "string").where(F.col("value").isNotNull()).distinct()
    ranked = running(distinct.withColumn("_one", F.lit(1).cast("long")), ["column"], ["value"],
                     {"upto": ("sum", "_one")}, **limits)
    return freeze(ranked.select("column", "value", (F.col("upto") - 1).cast("long").alias("code")))


def code_apply(df: DataFrame, codes: DataFrame, columns: Sequence[str], unseen: int | None = None) -> DataFrame:
    """Replace values by their codes in place; others get ``unseen``."""
    out = df
    sizes = sizes_by(codes, "column")
    for c in columns:
        side = small_side(codes.where(F.col("column") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_code_{c}")), counted=sizes.get(c, 0))
        out = out.join(side, out[c].cast("string") == side[f"_v_{c}"], "left")
    return out.select(*[
        (F.coalesce(F.col(f"_code_{c}"), F.lit(unseen).cast("long")) if c in columns else F.col(c)).alias(c)
        for c in df.columns
    ])


def label_encode(df: DataFrame, columns: Sequence[str], **limits: int) -> DataFrame:
    """Category -> dense integer by sorted order, fitted on this very frame."""
    return code_apply(df, code_fit(df, columns, **limits), columns)


def cat_index(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes for the classifier: fitted once on ``train``; null and categories
    not seen there share the code -1."""
    return code_apply(df, code_fit(train, columns), columns, unseen=-1)


def robust_scale(df: DataFrame, columns: Sequence[str], prefix: str = "scaled_") -> DataFrame:
    """(x - median) / IQR, scaled columns first, originals dropped.

    A zero IQR divides by 1. Only three numbers per column reach the driver.
    """
    quartiles = {r["column"]: r["q"] for r in exact_quantiles(df, columns, (0.25, 0.5, 0.75)).collect()}
    scaled = []
    for c in columns:
        low, mid, high = quartiles.get(c, (0.0, 0.0, 1.0))
        spread = high - low
        scaled.append(((F.col(c) - F.lit(mid)) / F.lit(spread if spread else 1.0)).alias(prefix + c))
    return df.select(*scaled, *[c for c in df.columns if c not in columns])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns."""
    moments = long_values(df, columns).where(F.col("value").isNotNull()).groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    # both sides have one row per described column
    return moments.join(F.broadcast(quartiles), "column").select(
        "column", "count", "mean", "std", "min", F.get("q", F.lit(0)).alias("q25"),
        F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q75"), "max")
