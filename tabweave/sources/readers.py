"""Scans: headered CSV and parquet, named datasets, key/value results, and
many result files at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabweave.operators.clean import clean_dropna, clean_sentinel, label_recode

# Result keys that are scores, not parameters.
SCORE_KEYS = ("tuned_val_roc", "untuned_val_roc", "tuned_test_roc", "untuned_test_roc", "elapsed_time")


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str | StructType | None = None) -> DataFrame:
    """CSV with a header, or parquet, told apart by the path's ending.

    Give a schema for CSV: inferring one costs a pass over the file.
    """
    first = path if isinstance(path, str) else path[0]
    if first.rstrip("/").endswith(".parquet"):
        reader = spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(*([path] if isinstance(path, str) else path))
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path if isinstance(path, str) else list(path))


@dataclass(frozen=True)
class Dataset:
    """A named table: where it is, what it predicts, how it is cleaned."""

    path: str
    target: str
    schema: str | None = None
    clean: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)


class Registry:
    """Datasets by name; the target column travels with the name."""

    def __init__(self, datasets: Mapping[str, Dataset]):
        self._datasets = dict(datasets)

    def __getitem__(self, name: str) -> Dataset:
        if name not in self._datasets:
            raise ValueError(f"unknown dataset: {name} (known: {sorted(self._datasets)})")
        return self._datasets[name]

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        d = self[name]
        return d.clean(read_table(spark, d.path, d.schema))


def income_cleaning(df: DataFrame, target: str = "income") -> DataFrame:
    """Recode the label, turn ``?`` into null, drop incomplete rows."""
    return clean_dropna(clean_sentinel(label_recode(df, target, {"<=50K": 0, ">50K": 1})))


def default_registry(folder: str) -> Registry:
    """The three tables of the experiments, below ``folder``."""
    return Registry({
        "adult": Dataset(f"{folder}/adult/adult.csv", "income", clean=income_cleaning),
        "balanced_credit_card": Dataset(f"{folder}/credit_card/credit_card_balanced.csv", "Class"),
        "unbalanced_credit_card": Dataset(f"{folder}/credit_card/credit_card_unbalanced.csv", "Class"),
    })


def read_params(spark: SparkSession, path: str | Sequence[str], drop: Sequence[str] = SCORE_KEYS) -> DataFrame:
    """A key/value result file as ``(param, value)`` rows, without its scores."""
    pairs = spark.read.option("header", True).schema("param string, value string").option(
        "enforceSchema", True).csv(path if isinstance(path, str) else list(path))
    return pairs.where(~F.col("param").isin(*drop))


def params_dict(params: DataFrame, limit: int = 10_000) -> dict[str, str]:
    """The parameters of one run on the driver (a handful by nature)."""
    rows = params.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("that is not the parameter list of one run")
    return {r["param"]: r["value"] for r in rows}


def read_many(spark: SparkSession, pattern: str | Sequence[str], name_pattern: str, stamps: Sequence[str],
              schema: str | StructType | None = None) -> DataFrame:
    """All files that match a glob, stamped with parts of their names.

    ``name_pattern`` is a regular expression over the file path with one group
    per stamp. Files that do not exist are simply not matched; no name loop.
    """
    df = read_table(spark, pattern, schema)
    path = F.col("_metadata.file_path")
    stamped = df.select("*", *[F.regexp_extract(path, name_pattern, i + 1).alias(s) for i, s in enumerate(stamps)],
                        F.regexp_like(path, F.lit(name_pattern)).alias("_named"))
    # an index column written without a name is the experiment number
    for c in df.columns:
        if c in ("_c0", "Unnamed: 0"):
            stamped = stamped.withColumnRenamed(c, "row")
    return stamped.where("_named").drop("_named")


def union_shapes(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of results with different columns; missing ones become null."""
    if not frames:
        raise ValueError("nothing to read")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_shapes(spark: SparkSession, patterns: Sequence[str], name_pattern: str, stamps: Sequence[str]) -> DataFrame:
    """One read per file shape, unioned loosely; a pattern without files is skipped."""
    frames = []
    for p in patterns:
        try:
            frames.append(read_many(spark, p, name_pattern, stamps))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return union_shapes(frames)


def external_source(df: DataFrame, source: str) -> DataFrame:
    """Rows made elsewhere (by a neural generator, say) as a mixture source."""
    return df.withColumn("source", F.lit(source))


def gather_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Several sources as one table with a ``source`` column."""
    return union_shapes([external_source(df, name) for name, df in sources.items()])
