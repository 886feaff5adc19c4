"""Cleaning, labels, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import clean
from tabweave.plans.inputs import EXPERIMENTS, KEY, LABELLED, METRICS, experiments, half_even_sql, labelled, table


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    """Events with two of the types written as missing-value marks."""
    kind = F.when(F.col("event_type") == "error", "?").when(F.col("event_type") == "view", " ?").otherwise(F.col("event_type"))
    return table(spark, folder, "events").select("event_id", kind.alias("event_type"), "value")


def clean_sentinel(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_sentinel(_marked(spark, folder))


def clean_dropna(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_dropna(clean.clean_sentinel(_marked(spark, folder)))


def label_recode(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit(" "), "o_orderstatus").alias("o_orderstatus"))
    return clean.label_recode(orders, "o_orderstatus", {"F": 0, "O": 1})


def label_unknown(spark: SparkSession, folder: str) -> DataFrame:
    return clean.unknown_labels(table(spark, folder, "orders"), "o_orderstatus", {"F": 0, "O": 1})


def label_decode(spark: SparkSession, folder: str) -> DataFrame:
    return clean.label_decode(labelled(spark, folder).select(*KEY, "label"), "label", {0: " <=50K", 1: " >50K"})


def cast_bool(spark: SparkSession, folder: str) -> DataFrame:
    return clean.cast_cols(labelled(spark, folder).select(*KEY, "label"), {"label": "boolean"})


def cast_float(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return clean.cast_cols(table(spark, folder, "orders").select("o_orderkey", text.alias("metric")), {"metric": "double"})


def drop_col(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_col(table(spark, folder, "part"), "p_name", "p_retailprice")


def reorder_cols(spark: SparkSession, folder: str) -> DataFrame:
    return clean.reorder(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey"])


def rename(spark: SparkSession, folder: str) -> DataFrame:
    nested = experiments(spark, folder).groupBy("data", "method").agg(
        F.struct(F.min("tuned_val_auc").alias("min"), F.max("tuned_val_auc").alias("max")).alias("tuned_val_auc"),
        F.struct(F.min("untuned_val_auc").alias("min"), F.max("untuned_val_auc").alias("max")).alias("untuned_val_auc"))
    return clean.flatten(nested).withColumnsRenamed({"data": "data_set"})


def filter_eq(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").where(F.col("l_returnflag") == "R").select(*KEY, "l_quantity")


def filter_isin(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


def filter_and_or(spark: SparkSession, folder: str) -> DataFrame:
    f = (F.col("l_returnflag") == "A") & ((F.col("l_linestatus") == "F") | (F.col("l_discount") > 0.05))
    return table(spark, folder, "lineitem").where(f).select(*KEY, "l_discount")


def cond_replace(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(*KEY, "l_quantity", "l_tax", "l_discount")
    return clean.cond_replace(rows, "l_tax", F.col("l_quantity") > 25, F.col("l_discount"))


def derive_diff(spark: SparkSession, folder: str) -> DataFrame:
    return clean.derive_diff(experiments(spark, folder).select("data", "method", "experiment", "tuned_test_auc", "untuned_test_auc"),
                             "tuned_test_auc", "untuned_test_auc")


def add_const(spark: SparkSession, folder: str) -> DataFrame:
    return clean.add_const(table(spark, folder, "supplier").select("s_suppkey", "s_acctbal"), data="suppliers", experiment=1)


def fn_math(spark: SparkSession, folder: str) -> DataFrame:
    return experiments(spark, folder).select(
        "data", "method", "experiment", F.abs(F.col("tuned_val_auc") - F.col("untuned_val_auc")).alias("gap"),
        F.least(*METRICS).alias("low"), F.greatest(*METRICS).alias("high"),
        F.floor(100.0 * F.col("tuned_test_auc")).cast("long").alias("whole"))


def fn_string(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey", F.concat_ws("_", F.lit("tuned"), "p_brand", "p_type").alias("name"),
        F.contains("p_type", F.lit("ECON")).alias("economy"), F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("short"))


def round_all(spark: SparkSession, folder: str) -> DataFrame:
    return clean.round_all(experiments(spark, folder))


QUERIES = {f.__name__: f for f in (
    clean_sentinel, clean_dropna, label_recode, label_unknown, label_decode, cast_bool, cast_float, drop_col, reorder_cols,
    rename, filter_eq, filter_isin, filter_and_or, cond_replace, derive_diff, add_const, fn_math, fn_string, round_all)}

_K = ", ".join(KEY)
_TYPE = "CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE event_type END"
ORACLES = {
    "clean_sentinel": f"SELECT event_id, {_TYPE} AS event_type, value FROM events",
    "clean_dropna": "SELECT event_id, event_type, value FROM events WHERE event_type NOT IN ('error', 'view')",
    "label_recode": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS o_orderstatus FROM orders",
    "label_unknown": "SELECT count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS unknown, count(*) AS rows FROM orders",
    "label_decode": f"SELECT {_K}, CASE label WHEN 0 THEN ' <=50K' ELSE ' >50K' END AS label FROM {LABELLED} l",
    "cast_bool": f"SELECT {_K}, label = 1 AS label FROM {LABELLED} l",
    "cast_float": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS metric FROM orders",
    "drop_col": "SELECT p_partkey, p_brand, p_type, p_size FROM part",
    "reorder_cols": "SELECT c_acctbal, c_nationkey, c_custkey, c_name, c_mktsegment FROM customer",
    "rename": f"""SELECT data AS data_set, method, min(tuned_val_auc) AS tuned_val_auc_min, max(tuned_val_auc) AS tuned_val_auc_max,
      min(untuned_val_auc) AS untuned_val_auc_min, max(untuned_val_auc) AS untuned_val_auc_max FROM {EXPERIMENTS} e GROUP BY ALL""",
    "filter_eq": f"SELECT {_K}, l_quantity FROM lineitem WHERE l_returnflag = 'R'",
    "filter_isin": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_and_or": f"""SELECT {_K}, l_discount FROM lineitem
      WHERE l_returnflag = 'A' AND (l_linestatus = 'F' OR l_discount > 0.05::DOUBLE)""",
    "cond_replace": f"""SELECT {_K}, l_quantity, CASE WHEN l_quantity > 25 THEN l_discount ELSE l_tax END AS l_tax,
      l_discount FROM lineitem""",
    "derive_diff": f"""SELECT data, method, experiment, tuned_test_auc, untuned_test_auc,
      tuned_test_auc - untuned_test_auc AS diff FROM {EXPERIMENTS} e""",
    "add_const": "SELECT s_suppkey, s_acctbal, 'suppliers' AS data, 1 AS experiment FROM supplier",
    "fn_math": f"""SELECT data, method, experiment, abs(tuned_val_auc - untuned_val_auc) AS gap,
      least({', '.join(METRICS)}) AS low, greatest({', '.join(METRICS)}) AS high,
      floor(100.0::DOUBLE * tuned_test_auc)::BIGINT AS whole FROM {EXPERIMENTS} e""",
    "fn_string": """SELECT p_partkey, concat_ws('_', 'tuned', p_brand, p_type) AS name, contains(p_type, 'ECON') AS economy,
      replace(p_brand, 'Brand#', 'B') AS short FROM part""",
    "round_all": f"SELECT data, method, experiment, {', '.join(f'{half_even_sql(m, 4)} AS {m}' for m in METRICS)} FROM {EXPERIMENTS} e",
}
