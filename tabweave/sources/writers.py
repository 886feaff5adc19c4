"""Sinks. All refuse to overwrite unless told otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.clean import label_decode


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write parquet or headered CSV, in a folder per value of ``by``."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "csv":
        # padding is part of a label's text
        writer = writer.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False)
    writer.format(fmt).save(path)


def write_split(df: DataFrame, path: str, fmt: str = "parquet", split: str = "split", mode: str = "errorifexists") -> None:
    """Train, validation and test rows in one table, a folder each."""
    write_table(df, path, fmt, [split], mode)


def write_synthetic(df: DataFrame, path: str, label: str, decode: Mapping[int, str] | None = None, fmt: str = "csv",
                    by: Sequence[str] = (), mode: str = "errorifexists", **stamps: object) -> None:
    """Synthetic rows with their label as text; ``stamps`` (data, experiment,
    tuned, ...) become partition folders in place of name prefixes."""
    out = label_decode(df, label, decode) if decode else df
    out = out.withColumns({k: F.lit(v) for k, v in stamps.items()}) if stamps else out
    write_table(out, path, fmt, [*by, *stamps], mode)
