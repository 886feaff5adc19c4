"""Encoders, scaling and nearest-value look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import encode
from tabweave.operators.lookup import nearest
from tabweave.operators.sample import split3
from tabweave.plans.inputs import CATEGORIES, CATEGORY_COLUMNS, HASH_KEY, KEY, LABELLED, NUMERIC, categories, labelled, table


def te_fit(spark: SparkSession, folder: str) -> DataFrame:
    fitted = encode.te_fit(categories(spark, folder), "label", CATEGORY_COLUMNS).table
    return fitted.select("column", "category", "n", "mean")


def te_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted on the training split, applied to every row."""
    rows = categories(spark, folder)
    train = split3(rows, KEY).where("split = 'train'").drop("split")
    return encode.te_fit(train, "label", CATEGORY_COLUMNS).apply(rows).drop("l_discount", "label")


def te_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Decode means that have been moved off their place."""
    rows = categories(spark, folder)
    coder = encode.te_fit(rows, "label", CATEGORY_COLUMNS)
    moved = coder.apply(rows)
    for c in CATEGORY_COLUMNS:
        name = c + encode.ENCODED
        moved = moved.withColumn(name, F.col(name) + (F.col("l_discount") - 0.05) * 0.1)
    return coder.decode(moved).select(*KEY, *CATEGORY_COLUMNS)


def te_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return encode.te_roundtrip(categories(spark, folder), "label", CATEGORY_COLUMNS, KEY)


def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    return encode.label_encode(part, ["p_brand", "p_type"])


def cat_index(spark: SparkSession, folder: str) -> DataFrame:
    """Codes fitted on the training split of part, applied to all of it."""
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    train = split3(part, ["p_partkey"]).where("split = 'train'")
    return encode.cat_index(train, part, ["p_brand", "p_type"])


def robust_scale(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("amount"), F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("time"))
    scaled = encode.robust_scale(orders, ["amount", "time"])
    return scaled.select(F.round("scaled_amount", 6).alias("scaled_amount"), F.round("scaled_time", 6).alias("scaled_time"), "o_orderkey")


def describe(spark: SparkSession, folder: str) -> DataFrame:
    stats = encode.describe(labelled(spark, folder), NUMERIC)
    return stats.select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def join_dict(spark: SparkSession, folder: str) -> DataFrame:
    """Category codes looked up in a fitted dictionary."""
    rows = labelled(spark, folder).select(*KEY, "l_linestatus")
    return encode.code_apply(rows, encode.code_fit(rows, ["l_linestatus"]), ["l_linestatus"])


def join_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """For every customer the supplier with the closest balance."""
    suppliers = table(spark, folder, "supplier").groupBy("s_acctbal").agg(F.min("s_suppkey").alias("s_suppkey"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return nearest(customers, "c_acctbal", suppliers, "s_acctbal", "s_suppkey", ["s_suppkey"])


QUERIES = {f.__name__: f for f in (
    te_fit, te_apply, te_decode, te_roundtrip, label_encode, cat_index, robust_scale, describe, join_dict, join_nearest)}

_K = ", ".join(KEY)
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS category, label FROM {{rows}} r" for c in CATEGORY_COLUMNS)


def _fit(rows: str) -> str:
    return f"""SELECT "column", category, count(*) AS n, sum(label)::DOUBLE / count(*)::DOUBLE AS mean
      FROM ({_LONG.format(rows=rows)}) GROUP BY ALL"""


# ranked in place: at the smallest scale one key occurs twice, and a join on it would double the row
_TRAIN_CATEGORIES = f"""(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {HASH_KEY}) AS rn, count(*) OVER () AS n
  FROM {CATEGORIES} c) WHERE rn <= n - ceil(0.3 * n))"""


def _decoded(column: str) -> str:
    """value -> category with the nearest mean, over the distinct values."""
    return f"""d_{column} AS (SELECT mean, min(category) AS first_category, max(category) AS category FROM fit
        WHERE "column" = '{column}' GROUP BY mean),
      v_{column} AS (SELECT DISTINCT e_{column} AS x FROM moved),
      m_{column} AS (SELECT x, category FROM (SELECT x, category, row_number() OVER (
          PARTITION BY x ORDER BY abs(mean - x), first_category) AS rn FROM v_{column}, d_{column}) WHERE rn = 1)"""


def _decode_sql() -> str:
    cols = CATEGORY_COLUMNS
    moved = ", ".join(f"f_{c}.mean + (l_discount - 0.05::DOUBLE) * 0.1::DOUBLE AS e_{c}" for c in cols)
    joins = " ".join(f"JOIN fit f_{c} ON f_{c}.\"column\" = '{c}' AND f_{c}.category = r.{c}" for c in cols)
    back = " ".join(f"JOIN m_{c} ON m_{c}.x = e_{c}" for c in cols)
    return f"""WITH fit AS ({_fit(CATEGORIES)}), moved AS (SELECT {_K}, {moved} FROM {CATEGORIES} r {joins}),
      {', '.join(_decoded(c) for c in cols)}
      SELECT {_K}, {', '.join(f'm_{c}.category AS {c}' for c in cols)} FROM moved {back}"""


def _codes(columns: list[str], rows: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS f, value, (row_number() OVER (ORDER BY value) - 1)::BIGINT AS code
        FROM (SELECT DISTINCT {c} AS value FROM {rows})""" for c in columns)


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
    round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
    round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM lineitem""" for c in NUMERIC)

ORACLES = {
    "te_fit": _fit(CATEGORIES),
    "te_apply": f"""WITH fit AS ({_fit(_TRAIN_CATEGORIES)}) SELECT {_K},
      {', '.join(f'f_{c}.mean AS {c}_target_encoded' for c in CATEGORY_COLUMNS)} FROM {CATEGORIES} r
      {' '.join(f"LEFT JOIN fit f_{c} ON f_{c}.\"column\" = '{c}' AND f_{c}.category = r.{c}" for c in CATEGORY_COLUMNS)}""",
    "te_decode": _decode_sql(),
    "te_roundtrip": f"""WITH fit AS ({_fit(CATEGORIES)}), back AS (SELECT "column", mean, max(category) AS decoded FROM fit GROUP BY ALL)
      SELECT "column", count(*) AS rows, count(*) FILTER (category = decoded) AS matches
      FROM ({_LONG.format(rows=CATEGORIES)}) l JOIN fit USING ("column", category) JOIN back USING ("column", mean) GROUP BY ALL""",
    "label_encode": f"""WITH codes AS ({_codes(['p_brand', 'p_type'], 'part')})
      SELECT p_partkey, b.code AS p_brand, t.code AS p_type FROM part
      JOIN codes b ON b.f = 'p_brand' AND b.value = p_brand JOIN codes t ON t.f = 'p_type' AND t.value = p_type""",
    "cat_index": f"""WITH train AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', p_partkey, '5'))) AS rn,
        count(*) OVER () AS n FROM part) WHERE rn <= n - ceil(0.3 * n)),
      codes AS ({_codes(['p_brand', 'p_type'], 'train')})
      SELECT p_partkey, coalesce(b.code, -1) AS p_brand, coalesce(t.code, -1) AS p_type FROM part
      LEFT JOIN codes b ON b.f = 'p_brand' AND b.value = p_brand LEFT JOIN codes t ON t.f = 'p_type' AND t.value = p_type""",
    "robust_scale": """WITH o AS (SELECT o_orderkey, o_totalprice AS amount,
        date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS time FROM orders),
      q AS (SELECT quantile_cont(amount, [0.25, 0.5, 0.75]) AS a, quantile_cont(time, [0.25, 0.5, 0.75]) AS t FROM o)
      SELECT round((amount - a[2]) / (a[3] - a[1]), 6) AS scaled_amount, round((time - t[2]) / (t[3] - t[1]), 6) AS scaled_time,
        o_orderkey FROM o, q""",
    "describe": _DESCRIBE,
    "join_dict": f"""WITH codes AS ({_codes(['l_linestatus'], LABELLED)})
      SELECT {_K}, code AS l_linestatus FROM {LABELLED} l JOIN codes ON value = l_linestatus""",
    "join_nearest": """WITH s AS (SELECT s_acctbal, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_acctbal)
      SELECT c_custkey, c_acctbal, s_suppkey FROM (SELECT c_custkey, c_acctbal, s_suppkey, row_number() OVER (
        PARTITION BY c_custkey ORDER BY abs(s_acctbal - c_acctbal), s_suppkey) AS rn FROM customer, s) WHERE rn = 1""",
}
