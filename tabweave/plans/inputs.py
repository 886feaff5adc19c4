"""The roles the given tables play, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.sources.readers import read_table

# unique only as a whole
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- labelled rows


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as a labelled table: numeric and text columns, a 0/1 label."""
    return table(spark, folder, "lineitem").select(
        *KEY, *NUMERIC, "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("label"))


LABELLED = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  l_linestatus, (l_returnflag = 'R')::INTEGER AS label FROM lineitem)"""


def hash_sql(key: list[str], seed: object) -> str:
    return f"md5(concat_ws('-', {', '.join(key)}, '{seed}'))"


def uniform_sql(hashed: str, part: int) -> str:
    return f"(('0x' || substr({hashed}, {1 + 8 * part}, 8))::BIGINT / 4294967296.0::DOUBLE)"


HASH_KEY = hash_sql(KEY, 5)

# split3 of the labelled rows
SPLIT = f"""(SELECT x.*, CASE WHEN rn <= n - ceil(0.3 * n) THEN 'train'
    WHEN rn <= n - ceil((1 - 0.6666666::DOUBLE) * ceil(0.3 * n)) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY {HASH_KEY}) AS rn, count(*) OVER () AS n FROM {LABELLED}) x)"""


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with the text columns of part. The part side grows with the
    data, so its size decides the join, not a hint."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return labelled(spark, folder).join(part, "l_partkey").select(
        *KEY, "l_discount", "l_linestatus", "p_brand", "p_type", "label")


CATEGORIES = f"""(SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_discount, l.l_linestatus,
  p.p_brand, p.p_type, l.label FROM {LABELLED} l JOIN part p ON p.p_partkey = l.l_partkey)"""
CATEGORY_COLUMNS = ["l_linestatus", "p_brand", "p_type"]


# ---------------------------------------------------------------- skewed label


def skewed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a rare 0/1 label and numeric features of the whole text."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"))
    return docs.join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")


SKEWED = """(SELECT d.doc_id, d.n_chars::DOUBLE AS n_chars, len(string_split(d.text, ' '))::DOUBLE AS n_words,
  len(string_split(d.text, chr(10)))::DOUBLE AS n_lines, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
SKEWED_FEATURES = ["n_chars", "n_words", "n_lines"]


# ---------------------------------------------------------------- experiments

METRICS = ["untuned_val_auc", "tuned_val_auc", "untuned_test_auc", "tuned_test_auc"]
METHODS = [s + str(i) for s in "FO" for i in range(1, 8)]
MIXTURE = "O7"


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates of lineitem as results per data set, method and experiment.

    Integer sums, so a mean has the same bits in any engine and any order.
    """
    n = F.count(F.lit(1)).cast("double")

    def mean(column: str, cents: float, scale: float) -> Column:
        return F.sum(F.round(F.col(column) * cents).cast("long")) / n / F.lit(scale)

    return table(spark, folder, "lineitem").groupBy(
        F.col("l_returnflag").alias("data"),
        F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("method"),
        (F.col("l_suppkey") % 10).alias("experiment"),
    ).agg(mean("l_discount", 100.0, 10.0).alias("untuned_val_auc"), mean("l_tax", 100.0, 10.0).alias("tuned_val_auc"),
          mean("l_quantity", 1.0, 50.0).alias("untuned_test_auc"),
          mean("l_extendedprice", 100.0, 1e7).alias("tuned_test_auc"))


EXPERIMENTS = """(SELECT l_returnflag AS data, concat(l_linestatus, l_linenumber) AS method, l_suppkey % 10 AS experiment,
  sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*)::DOUBLE / 10.0::DOUBLE AS untuned_val_auc,
  sum(round(l_tax * 100)::BIGINT)::DOUBLE / count(*)::DOUBLE / 10.0::DOUBLE AS tuned_val_auc,
  sum(round(l_quantity)::BIGINT)::DOUBLE / count(*)::DOUBLE / 50.0::DOUBLE AS untuned_test_auc,
  sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*)::DOUBLE / 10000000.0::DOUBLE AS tuned_test_auc
  FROM lineitem GROUP BY ALL)"""


# ---------------------------------------------------------------- trials


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """Events as trial histories: a series per user, a score per event."""
    return table(spark, folder, "events").select("user_id", "ts", "event_id", (F.col("value") / 1000.0).alias("score"))


TRIALS = "(SELECT user_id, ts, event_id, value / 1000.0::DOUBLE AS score FROM events)"


# ---------------------------------------------------------------- sources


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as four mixture sources of unequal size."""
    return labelled(spark, folder).withColumn("source", F.concat(F.lit("s"), F.least("l_linenumber", F.lit(4)).cast("string")))


SOURCES = f"(SELECT *, concat('s', least(l_linenumber, 4)) AS source FROM {LABELLED})"

# log-odds bins of the labelled rows
BINS_SQL = {
    "l_quantity": "floor(l_quantity / 5)::INTEGER::VARCHAR",
    "l_extendedprice": "floor(l_extendedprice / 10000)::INTEGER::VARCHAR",
    "l_discount": "round(l_discount * 100)::INTEGER::VARCHAR",
    "l_tax": "round(l_tax * 100)::INTEGER::VARCHAR",
    "l_linestatus": "l_linestatus",
}


def bins() -> dict[str, Column]:
    return {
        "l_quantity": F.floor(F.col("l_quantity") / 5).cast("int"),
        "l_extendedprice": F.floor(F.col("l_extendedprice") / 10000).cast("int"),
        "l_discount": F.round(F.col("l_discount") * 100).cast("int"),
        "l_tax": F.round(F.col("l_tax") * 100).cast("int"),
        "l_linestatus": F.col("l_linestatus"),
    }


def half_even_sql(x: str, digits: int) -> str:
    """Half-to-even by the exact value of the double ``x``."""
    scale, twice, split = f"1e{digits}::DOUBLE", f"2e{digits}::DOUBLE", f"(({x}) * 134217729.0::DOUBLE)"
    high = f"({split} - ({split} - ({x})))"
    below = f"floor(({x}) * {scale})"
    side = f"(({high} * {twice} - (2 * {below} + 1)) + (({x}) - {high}) * {twice})"
    return f"({below} + CASE WHEN {side} > 0 OR ({side} = 0 AND {below}::BIGINT % 2 <> 0) THEN 1 ELSE 0 END) / {scale}"


def long_bins_sql(rows: str, keep: str) -> str:
    """The (feature, bin) rows of a table with a label."""
    return " UNION ALL ".join(
        f"SELECT {keep}, label, '{f}' AS feature, {sql} AS bin FROM {rows} r" for f, sql in BINS_SQL.items())


def auc_sql(rows: str, by: str, score: str = "s", label: str = "y") -> str:
    """Rank-sum AUC of ``rows`` per ``by`` (a comma list), null for one class."""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    first = f"{by}, " if by else ""
    return f"""SELECT {first}sum({label})::BIGINT AS positives, sum(1 - {label})::BIGINT AS negatives,
      CASE WHEN sum({label}) > 0 AND sum(1 - {label}) > 0 THEN
        (sum(CASE WHEN {label} = 1 THEN place ELSE 0 END) - sum({label}) * (sum({label}) + 1) / 2.0::DOUBLE)
        / (sum({label})::DOUBLE * sum(1 - {label})::DOUBLE) END AS auc
      FROM (SELECT *, rank() OVER ({part} ORDER BY {score})
              + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{score}) - 1) / 2.0::DOUBLE AS place
            FROM ({rows}) q0) q1 {group}"""


def chain_sql() -> str:
    """Sum of a row's weights in feature order, rounded as the scorer does."""
    total = " + ".join(["0.0::DOUBLE", *[f"coalesce(w_{f}.weight, 0.0::DOUBLE)" for f in BINS_SQL]])
    return f"floor(({total}) * 1e9::DOUBLE + 0.5::DOUBLE)::DOUBLE / 1e9::DOUBLE"


def joins_sql(weights: str, on: str = "") -> str:
    return " ".join(
        f"LEFT JOIN {weights} w_{f} ON w_{f}.feature = '{f}' AND w_{f}.bin = {sql.replace('l_', 'r.l_')} {on.format(f=f)}"
        for f, sql in BINS_SQL.items())
