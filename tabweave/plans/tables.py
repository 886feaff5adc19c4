"""Sources and sinks, read back from the shared folder they were written to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators.clean import clean_dropna, label_recode
from tabweave.operators.sample import split3
from tabweave.plans.inputs import EXPERIMENTS, KEY, LABELLED, METRICS, SPLIT, experiments, labelled, table
from tabweave.session import scratch_path
from tabweave.sources.readers import (
    SCORE_KEYS, Dataset, Registry, gather_sources, read_many, read_params, read_shapes, read_table)
from tabweave.sources.writers import write_split, write_synthetic, write_table


def src_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "customer.csv")
    write_table(table(spark, folder, "customer"), path, "csv")
    return read_table(spark, path, "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING")


def src_dataset(spark: SparkSession, folder: str) -> DataFrame:
    registry = Registry({"orders": Dataset(
        f"{folder}/orders.parquet", "o_orderstatus",
        clean=lambda df: clean_dropna(label_recode(df, "o_orderstatus", {"F": 0, "O": 1})))})
    return registry.load(spark, "orders").select("o_orderkey", "o_totalprice", registry["orders"].target)


def src_kv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "params.csv")
    pairs = table(spark, folder, "supplier").select(
        F.col("s_name").alias("key"), F.col("s_acctbal").cast("string").alias("Value"))
    scores = pairs.groupBy().agg(F.max("Value").alias("Value")).select(
        F.explode(F.array(*[F.lit(k) for k in SCORE_KEYS])).alias("key"), "Value")
    write_table(pairs.unionByName(scores), path, "csv")
    return read_params(spark, path)


def _run_files(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "runs")
    write_table(experiments(spark, folder), path, "csv", ["experiment", "data"])
    return path


def src_many(spark: SparkSession, folder: str) -> DataFrame:
    path = _run_files(spark, folder)
    read = read_many(spark, f"{path}/*/*/*.csv", r"experiment=(\d+)/data=(\w+)/", ["experiment", "data"],
                     "method STRING, " + ", ".join(f"{m} DOUBLE" for m in METRICS))
    return read.select("data", F.col("experiment").cast("long").alias("experiment"), "method", *METRICS)


def collect_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Best parameters, per-source scores and real baselines, files of three
    shapes, gathered into one table."""
    path = scratch_path(spark, "setups")
    results = experiments(spark, folder)
    best = results.groupBy("data").agg(F.max("untuned_val_auc").alias("alpha_1"), F.max("tuned_val_auc").alias("val_roc"))
    single = results.groupBy("data").agg(F.min("untuned_test_auc").alias("clf_auc_val"))
    real = results.groupBy("data").agg(F.count(F.lit(1)).alias("train"))
    for kind, df in (("best", best), ("single", single), ("real", real)):
        write_table(df.withColumn("setup", F.col("data")), f"{path}/{kind}", "csv", ["data"])
    shapes = [f"{path}/{kind}/*/*.csv" for kind in ("best", "single", "real", "absent")]
    out = read_shapes(spark, shapes, r"/(\w+)/data=(\w+)/", ["kind", "data"])
    return out.select("kind", "data", "setup", "alpha_1", "val_roc", "clf_auc_val", F.col("train").cast("long").alias("train"))


def src_external(spark: SparkSession, folder: str) -> DataFrame:
    return gather_sources({
        "customers": table(spark, folder, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")),
        "suppliers": table(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")),
    })


def sink_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "experiments")
    write_table(experiments(spark, folder), path, "parquet", ["data", "experiment"])
    return spark.read.parquet(path).select("data", F.col("experiment").cast("long").alias("experiment"), "method", *METRICS)


def sink_split(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    write_split(split3(labelled(spark, folder), KEY), path)
    return spark.read.parquet(path).select(*KEY, "label", "split")


def sink_synth(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "synthetic")
    rows = labelled(spark, folder).select(*KEY, "label")
    write_synthetic(rows, path, "label", {0: " <=50K", 1: " >50K"}, data="lineitem", tuned=True)
    read = spark.read.option("header", True).schema(
        ", ".join(f"{k} BIGINT" for k in KEY) + ", label STRING, data STRING, tuned BOOLEAN").csv(path)
    return read.select(*KEY, "label", "data", "tuned")


QUERIES = {f.__name__: f for f in (src_csv, src_dataset, src_kv, src_many, collect_runs, src_external, sink_csv, sink_split, sink_synth)}

_EXPERIMENT_COLUMNS = ", ".join(["data", "experiment", "method", *METRICS])
ORACLES = {
    "src_csv": "SELECT * FROM customer",
    "src_dataset": """SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS o_orderstatus
      FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "src_kv": "SELECT s_name AS param, s_acctbal::VARCHAR AS value FROM supplier",
    "src_many": f"SELECT {_EXPERIMENT_COLUMNS} FROM {EXPERIMENTS} e",
    "collect_runs": f"""WITH e AS {EXPERIMENTS}
      SELECT 'best' AS kind, data, data AS setup, max(untuned_val_auc) AS alpha_1, max(tuned_val_auc) AS val_roc,
        NULL::DOUBLE AS clf_auc_val, NULL::BIGINT AS train FROM e GROUP BY data
      UNION ALL SELECT 'single', data, data, NULL, NULL, min(untuned_test_auc), NULL FROM e GROUP BY data
      UNION ALL SELECT 'real', data, data, NULL, NULL, NULL, count(*) FROM e GROUP BY data""",
    "src_external": """SELECT c_acctbal AS balance, c_nationkey AS nation, 'customers' AS source FROM customer
      UNION ALL SELECT s_acctbal, s_nationkey, 'suppliers' FROM supplier""",
    "sink_csv": f"SELECT {_EXPERIMENT_COLUMNS} FROM {EXPERIMENTS} e",
    "sink_split": f"SELECT {', '.join(KEY)}, label, split FROM {SPLIT} s",
    "sink_synth": f"""SELECT {', '.join(KEY)}, CASE label WHEN 0 THEN ' <=50K' ELSE ' >50K' END AS label,
      'lineitem' AS data, TRUE AS tuned FROM {LABELLED} l""",
}
