"""Sampling, splitting, rebalancing and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import resample, sample
from tabweave.operators.neighbors import knn
from tabweave.plans.inputs import (
    HASH_KEY, KEY, LABELLED, SKEWED, SKEWED_FEATURES, SPLIT, hash_sql, labelled, skewed, table, uniform_sql)

# Fixed value: the row cap of the experiments.
CAP = 50_000


def global_rank(spark: SparkSession, folder: str) -> DataFrame:
    return sample.global_rank(labelled(spark, folder).select(*KEY), KEY)


def sample_cap(spark: SparkSession, folder: str) -> DataFrame:
    return sample.sample_cap(labelled(spark, folder), CAP, KEY)


def sample_n(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return sample.sample_n(orders, orders.count() // 3, ["o_orderkey"])


def split3(spark: SparkSession, folder: str) -> DataFrame:
    return sample.split3(labelled(spark, folder).select(*KEY, "label"), KEY)


def split2(spark: SparkSession, folder: str) -> DataFrame:
    return sample.split2(labelled(spark, folder).select(*KEY, "label"), KEY)


def sample_condition(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the rows with the class shares of the whole table."""
    rows = labelled(spark, folder).select(*KEY, "label")
    n, share = rows.agg(F.count(F.lit(1)), F.sum("label") / F.count("label")).first()
    return sample.sample_condition(rows, "label", sample.class_sizes(n // 4, share), KEY)


def undersample(spark: SparkSession, folder: str) -> DataFrame:
    return sample.undersample(skewed(spark, folder), "toxic", 0.5, ["doc_id"])


def smote(spark: SparkSession, folder: str) -> DataFrame:
    out = resample.smote(skewed(spark, folder), "toxic", SKEWED_FEATURES, "doc_id")
    return out.select("toxic", *[F.round(c, 6).alias(c) for c in SKEWED_FEATURES])


def rebalance(spark: SparkSession, folder: str) -> DataFrame:
    """The rare class is 13% here, so it is raised to 50% before undersampling to 80%."""
    out = resample.rebalance(skewed(spark, folder), "toxic", SKEWED_FEATURES, "doc_id", over=0.5, under=0.8)
    return out.select("toxic", *[F.round(c, 6).alias(c) for c in SKEWED_FEATURES])


def gen_smote(spark: SparkSession, folder: str) -> DataFrame:
    """As many interpolated rows as there are rows of the rare class."""
    rare = skewed(spark, folder).where("toxic = 1")
    out = resample.smote_rows(rare, SKEWED_FEATURES, "doc_id", rare.count())
    return out.select("row_id", "base", "neighbour", *[F.round(c, 6).alias(c) for c in SKEWED_FEATURES])


def replicate(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return sample.replicate(customers, customers.count() // 3, 50, ["c_custkey"])


def join_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest other vectors of every vector."""
    near = knn(table(spark, folder, "embeddings"), "vec_id", "embedding", 5)
    return near.select("vec_id", F.posexplode("neighbours").alias("place", "n")).select(
        "vec_id", "place", F.col("n")["neighbour"].alias("neighbour"), F.round(F.sqrt(F.col("n")["distance2"]), 6).alias("distance"))


QUERIES = {f.__name__: f for f in (
    global_rank, sample_cap, sample_n, split3, split2, sample_condition, undersample, smote, rebalance, gen_smote,
    replicate, join_knn)}

_K = ", ".join(KEY)
_DOC_HASH = hash_sql(["doc_id"], 5)
_ROW_HASH = "md5(concat_ws('-', row_id, '5'))"


def _smote(n: str) -> str:
    """CTEs ending in ``made``: n interpolated rows of the rare class."""
    gap = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in SKEWED_FEATURES)
    u = [uniform_sql("h", i) for i in range(3)]
    made = ", ".join(f"b.{c} + gap * (o.{c} - b.{c}) AS {c}" for c in SKEWED_FEATURES)
    return f"""rows AS {SKEWED}, rare AS (SELECT * FROM rows WHERE toxic = 1),
      size AS (SELECT {n} AS n, (SELECT count(*) FROM rare) AS few),
      near AS (SELECT * FROM (SELECT a.doc_id AS base, b.doc_id AS neighbour, row_number() OVER (
          PARTITION BY a.doc_id ORDER BY {gap}, b.doc_id) - 1 AS place FROM rare a JOIN rare b ON a.doc_id <> b.doc_id) WHERE place < 5),
      ranked AS (SELECT doc_id AS base, row_number() OVER (ORDER BY {_DOC_HASH}) AS rank FROM rare),
      picks AS (SELECT row_id, floor({u[0]} * few) + 1 AS rank, floor({u[1]} * 5) AS place, {u[2]} AS gap
        FROM (SELECT row_id, few, {_ROW_HASH} AS h FROM (SELECT unnest(range(n::BIGINT)) AS row_id, few FROM size))),
      made AS (SELECT row_id, base, neighbour, {made} FROM picks JOIN ranked USING (rank) JOIN near USING (base, place)
        JOIN rare b ON b.doc_id = base JOIN rare o ON o.doc_id = neighbour)"""


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in SKEWED_FEATURES)
_COUNTS = "(SELECT count(*) FROM rows WHERE toxic = 0)"
ORACLES = {
    "global_rank": f"SELECT {_K}, row_number() OVER (ORDER BY {HASH_KEY}) AS rank FROM lineitem",
    "sample_cap": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY {HASH_KEY}) AS rn FROM {LABELLED} l)
      WHERE rn <= {CAP}""",
    "sample_n": """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', o_orderkey, '5'))) AS rn,
      count(*) OVER () AS n FROM orders) WHERE rn <= n // 3""",
    "split3": f"SELECT {_K}, label, split FROM {SPLIT} s",
    "split2": f"""SELECT {_K}, label, CASE WHEN rn <= n - ceil(0.2 * n) THEN 'train' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (ORDER BY {HASH_KEY}) AS rn, count(*) OVER () AS n FROM {LABELLED} l)""",
    "sample_condition": f"""SELECT {_K}, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH_KEY}) AS rn,
        round_even((count(*) OVER () // 4) * (sum(label) OVER ())::DOUBLE / count(*) OVER (), 0) AS ones,
        count(*) OVER () // 4 AS n FROM {LABELLED} l) WHERE rn <= CASE label WHEN 1 THEN ones ELSE n - ones END""",
    "undersample": f"""SELECT doc_id, n_chars, n_words, n_lines, toxic FROM (SELECT *, row_number() OVER (
        PARTITION BY toxic ORDER BY {_DOC_HASH}) AS rn, sum(toxic) OVER () AS few FROM {SKEWED} s)
      WHERE toxic = 1 OR rn <= floor(few / 0.5)""",
    "smote": f"""WITH {_smote(f'{_COUNTS} - (SELECT count(*) FROM rare)')}
      SELECT toxic, {_ROUNDED} FROM rows UNION ALL SELECT 1, {_ROUNDED} FROM made""",
    "rebalance": f"""WITH {_smote(f'floor(0.5 * {_COUNTS}) - (SELECT count(*) FROM rare)')},
      many AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_DOC_HASH}) AS rn FROM rows WHERE toxic = 0)
        WHERE rn <= floor(floor(0.5 * {_COUNTS}) / 0.8))
      SELECT toxic, {_ROUNDED} FROM rare UNION ALL SELECT 1, {_ROUNDED} FROM made UNION ALL SELECT toxic, {_ROUNDED} FROM many""",
    "gen_smote": f"WITH {_smote('(SELECT count(*) FROM rare)')} SELECT row_id, base, neighbour, {_ROUNDED} FROM made",
    "replicate": """SELECT c_custkey, c_acctbal, replicate FROM (SELECT c_custkey, c_acctbal, r AS replicate, row_number() OVER (
        PARTITION BY r ORDER BY md5(concat_ws('-', c_custkey, r, '5'))) AS rn, count(*) OVER (PARTITION BY r) AS n
      FROM customer, (SELECT unnest(range(1, 51)) AS r)) WHERE rn <= n // 3""",
    "join_knn": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
      SELECT vec_id, place, neighbour, round(d, 6) AS distance FROM (SELECT a.vec_id, b.vec_id AS neighbour,
        list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) - 1 AS place
        FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE place < 5""",
}
