"""Scores: AUC, the log-odds scorer and the tree models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import replicate, sample, score
from tabweave.operators.generate import gen_copula
from tabweave.operators.sample import split3
from tabweave.plans.inputs import (
    KEY, LABELLED, NUMERIC, SOURCES, SPLIT, auc_sql, bins, chain_sql, joins_sql, labelled, long_bins_sql, sources, table)
from tabweave.session import freeze, spread, store


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return split3(labelled(spark, folder), KEY)


def auc(spark: SparkSession, folder: str) -> DataFrame:
    out = score.auc(labelled(spark, folder), "l_extendedprice", "label", ["l_linestatus"])
    return out.withColumn("auc", F.round("auc", 9))


def train_auc_guard(spark: SparkSession, folder: str) -> DataFrame:
    """AUC within every order; an order with one class gets 0.5."""
    out = score.auc(labelled(spark, folder), "l_extendedprice", "label", ["l_orderkey"], one_class=0.5)
    return out.withColumn("auc", F.round("auc", 9))


def log_odds(spark: SparkSession, folder: str) -> DataFrame:
    """Split, fit bin weights on the training part, AUC on the validation part."""
    parts = _parts(spark, folder).where("split <> 'test'")
    out = score.log_odds_auc(parts, "label", bins()).where("split = 'val'")
    return out.select("positives", "negatives", F.round("auc", 9).alias("auc"))


def score_trainval(spark: SparkSession, folder: str) -> DataFrame:
    """One model, all splits scored in one pass."""
    out = score.log_odds_auc(_parts(spark, folder), "label", bins())
    return out.withColumn("auc", F.round("auc", 9))


def per_source_score(spark: SparkSession, folder: str) -> DataFrame:
    """Every source, in two variants, against validation and test rows."""
    rows = sources(spark, folder).withColumn("tuned", F.col("l_linestatus") == "O")
    real = _parts(spark, folder).where("split <> 'train'")
    out = score.per_source_score(rows, real, "label", bins(), ["source", "tuned"])
    return out.withColumn("auc", F.round("auc", 9))


def _dear(spark: SparkSession, folder: str) -> DataFrame:
    """Split rows whose label the price tells in part: whether price times
    quantity is above a million; the quantity is withheld."""
    return store(_parts(spark, folder).select(
        "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
        (F.col("l_extendedprice") * F.col("l_quantity") > 1e6).cast("int").alias("label"), "split"))


def tstr_score(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees on copula rows, AUC on real validation and test rows."""
    parts = _dear(spark, folder)
    train = parts.where("split = 'train'")
    made = store(gen_copula(train, train.count(), ["l_extendedprice", "l_discount", "l_tax"], ["l_linestatus", "label"]).drop("row_id"))
    return score.tstr_score(made, parts.where("split <> 'train'"), "label", by=["split"])


def real_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees on real rows; AUC and row counts of the three splits."""
    return score.score_trainval(_dear(spark, folder), "label")


def tree_score(spark: SparkSession, folder: str) -> DataFrame:
    """One decision tree on the customers' orders."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"), "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    parts = freeze(split3(orders, ["o_orderkey"]))
    return score.tree_score(parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split"),
                            "label", ignore=["o_orderkey"])


def _replicated(out: DataFrame) -> DataFrame:
    return out.select("replicate", "split", *[F.round(c, 7).alias(c) for c in ("auc", "mean", "std")])


def replicate_auc(spark: SparkSession, folder: str) -> DataFrame:
    """50 draws of a tenth of the training rows, a model of each, AUC on validation and test rows."""
    parts = freeze(_parts(spark, folder))
    train = parts.where("split = 'train'")
    draws = sample.replicate(train.drop("split"), train.count() // 10, 50, KEY)
    return _replicated(replicate.replicate_scores(draws, parts.where("split <> 'train'"), "label", bins()))


def replicate_model(spark: SparkSession, folder: str) -> DataFrame:
    """The same for 50 draws from one copula of the training rows."""
    parts = freeze(_parts(spark, folder))
    train = spread(parts.where("split = 'train'"))
    return _replicated(replicate.replicate_model(train, parts.where("split <> 'train'"), train.count() // 10, "label", bins(), NUMERIC,
                                                 ["l_linestatus", "label"]))


QUERIES = {f.__name__: f for f in (
    auc, train_auc_guard, log_odds, score_trainval, per_source_score, tstr_score, real_baseline, tree_score,
    replicate_auc, replicate_model)}

_MODEL = "ln((sum(label) + 1.0::DOUBLE) / (sum(1 - label) + 1.0::DOUBLE))"


def _weights(rows: str, by: str = "") -> str:
    keep = f"{by}, " if by else ""
    long = long_bins_sql(rows, by if by else "1 AS one")
    return f"SELECT {keep}feature, bin, {_MODEL} AS weight FROM ({long}) GROUP BY {keep}feature, bin"


def _rounded(sql: str) -> str:
    return f"SELECT * REPLACE (round(auc, 9) AS auc) FROM ({sql})"


_TRAINED = f"parts AS MATERIALIZED {SPLIT}, train AS (SELECT * FROM parts WHERE split = 'train'), w AS MATERIALIZED ({_weights('train')})"
_SCORED = f"SELECT split, label AS y, {chain_sql()} AS s FROM parts r {joins_sql('w')}"
_PER_SOURCE = f"""WITH parts AS MATERIALIZED {SPLIT}, src AS (SELECT *, l_linestatus = 'O' AS tuned FROM {SOURCES}),
  w AS MATERIALIZED ({_weights('src', 'source, tuned')}), names AS (SELECT DISTINCT source, tuned FROM src),
  scored AS (SELECT n.source, n.tuned, r.split, label AS y, {chain_sql()} AS s FROM parts r CROSS JOIN names n
    {joins_sql('w', 'AND w_{f}.source = n.source AND w_{f}.tuned = n.tuned')} WHERE r.split <> 'train')
  SELECT source, tuned, split, round(auc, 9) AS auc FROM ({auc_sql('SELECT * FROM scored', 'source, tuned, split')})"""
_REPLICATES = "(SELECT unnest(range(1, 51))::INTEGER AS replicate)"
_REPLICATE = f"""WITH parts AS MATERIALIZED {SPLIT}, train AS (SELECT * EXCLUDE (split) FROM parts WHERE split = 'train'),
  drawn AS MATERIALIZED (SELECT * FROM (SELECT t.*, replicate, row_number() OVER (PARTITION BY replicate
      ORDER BY md5(concat_ws('-', {', '.join(KEY)}, replicate, '5'))) AS place, count(*) OVER (PARTITION BY replicate) AS pool
    FROM train t, {_REPLICATES} r) WHERE place <= pool // 10),
  w AS MATERIALIZED ({_weights('drawn', 'replicate')}),
  scored AS (SELECT c.replicate, r.split, label AS y, {chain_sql()} AS s FROM parts r CROSS JOIN {_REPLICATES} c
    {joins_sql('w', 'AND w_{f}.replicate = c.replicate')} WHERE r.split <> 'train')
  SELECT replicate, split, round(auc, 7) AS auc, round(avg(auc) OVER (PARTITION BY split), 7) AS mean,
    round(stddev_samp(auc) OVER (PARTITION BY split), 7) AS std FROM ({auc_sql('SELECT * FROM scored', 'replicate, split')})"""
ORACLES = {
    "replicate_auc": _REPLICATE,
    "auc": _rounded(auc_sql(f"SELECT l_linestatus, l_extendedprice AS s, label AS y FROM {LABELLED} l", "l_linestatus")),
    "train_auc_guard": "SELECT * REPLACE (coalesce(round(auc, 9), 0.5) AS auc) FROM ("
        + auc_sql(f"SELECT l_orderkey, l_extendedprice AS s, label AS y FROM {LABELLED} l", "l_orderkey") + ")",
    "log_odds": f"WITH {_TRAINED} {_rounded(auc_sql(f'SELECT * FROM ({_SCORED}) WHERE split = ' + chr(39) + 'val' + chr(39), ''))}",
    "score_trainval": f"WITH {_TRAINED} {_rounded(auc_sql(_SCORED, 'split'))}",
    "per_source_score": _PER_SOURCE,
}
