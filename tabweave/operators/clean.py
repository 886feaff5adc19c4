"""Row-wise cleaning and column work. Everything here is a narrow projection
or filter: no shuffle, full codegen, and filters reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.rounding import half_even


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def _replace(df: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    """Swap columns in one projection, keeping their order."""
    return df.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in df.columns])


def clean_sentinel(df: DataFrame, marks: Sequence[str] = ("?",)) -> DataFrame:
    """Turn missing-value marks (padded or not) into null in every text column."""
    return _replace(df, {
        c: F.when(F.trim(F.col(c)).isin(*marks), F.lit(None)).otherwise(F.col(c))
        for c in string_columns(df)
    })


def clean_dropna(df: DataFrame) -> DataFrame:
    """Drop every row with a null or NaN in any column."""
    return df.dropna("any")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing, as null does."""
    return _replace(df, {
        f.name: F.when(F.isnan(f.name), F.lit(None)).otherwise(F.col(f.name))
        for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    })


def label_recode(df: DataFrame, column: str, mapping: Mapping[str, int]) -> DataFrame:
    """Text labels to integers; padding is ignored and other texts become null."""
    text = F.trim(F.col(column))
    coded = F.lit(None).cast("int")
    for value, code in mapping.items():
        coded = F.when(text == value.strip(), F.lit(code)).otherwise(coded)
    return _replace(df, {column: coded})


def unknown_labels(df: DataFrame, column: str, mapping: Mapping[str, int]) -> DataFrame:
    """How many labels ``label_recode`` would turn into null."""
    known = [v.strip() for v in mapping]
    odd = F.col(column).isNotNull() & ~F.trim(F.col(column)).isin(*known)
    return df.agg(F.count_if(odd).alias("unknown"), F.count(F.lit(1)).alias("rows"))


def label_decode(df: DataFrame, column: str, mapping: Mapping[int, str]) -> DataFrame:
    """Integer (or boolean) labels back to text."""
    text = F.lit(None).cast("string")
    for code, value in mapping.items():
        text = F.when(F.col(column).cast("int") == code, F.lit(value)).otherwise(text)
    return _replace(df, {column: text})


def cast_cols(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; text that does not parse becomes null instead of failing."""
    return _replace(df, {c: F.col(c).try_cast(t) for c, t in types.items()})


def drop_col(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {missing}")
    return df.drop(*columns)


def reorder(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Put ``order`` first and leave the remaining columns in place after it."""
    return df.select(*order, *[c for c in df.columns if c not in order])


def flatten(df: DataFrame) -> DataFrame:
    """Turn one level of struct columns into ``<column>_<field>`` columns."""
    out: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [F.col(f"`{f.name}`.`{n}`").alias(f"{f.name}_{n}".strip("_")) for n in f.dataType.names]
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def cond_replace(df: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    """``value`` where ``condition`` holds, the old value elsewhere (also where
    the condition is null)."""
    return _replace(df, {column: F.when(condition, value).otherwise(F.col(column))})


def derive_diff(df: DataFrame, after: str, before: str, name: str = "diff") -> DataFrame:
    return df.withColumn(name, F.col(after) - F.col(before))


def add_const(df: DataFrame, **values: object) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def round_all(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every fractional column half-to-even, leave the others."""
    return _replace(df, {
        f.name: F.bround(f.name, digits) if isinstance(f.dataType, T.DecimalType) else half_even(F.col(f.name), digits)
        for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))
    })
