"""Result tables: joins, aggregates, arg-max rows, tests and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import report
from tabweave.plans.inputs import (
    EXPERIMENTS, KEY, LABELLED, METRICS, MIXTURE, SKEWED, experiments, half_even_sql, labelled, skewed, table)

GROUP = ["data", "experiment"]
ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


def _rounded(df: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _winners(df: DataFrame) -> DataFrame:
    return report.argmax_group(df, GROUP, "untuned_val_auc", ["method"])


def join_left_multi(spark: SparkSession, folder: str) -> DataFrame:
    rows = experiments(spark, folder)
    best = _winners(rows).select(*GROUP, F.col("method").alias("best_method"), F.col("untuned_test_auc").alias("best_test_auc"))
    return rows.join(best, GROUP, "left").select(*GROUP, "method", "untuned_test_auc", "best_method", "best_test_auc")


def join_left_report(spark: SparkSession, folder: str) -> DataFrame:
    """Means next to t-tests; the mixture has no test against itself."""
    means = agg_mean_std(spark, folder)
    tests = ttest_greater(spark, folder)
    return means.join(tests, ["data", "method"], "left")


def agg_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    out = report.agg_mean_std(experiments(spark, folder), ["data", "method"], METRICS)
    return _rounded(out, [f"{m}_{s}" for m in METRICS for s in ("mean", "std")])


def agg_mean(spark: SparkSession, folder: str) -> DataFrame:
    diff = F.col("tuned_test_auc") - F.col("untuned_test_auc")
    return _rounded(experiments(spark, folder).groupBy(*GROUP).agg(F.avg(diff).alias("diff")), ["diff"])


def agg_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the methods add up to 1 within a data set."""
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("data"), "l_linenumber").count()
    total = rows.groupBy("data").agg(F.sum("count").alias("_n"))
    return _rounded(rows.join(total, "data").groupBy("data").agg(F.sum(F.col("count") / F.col("_n")).alias("weight")), ["weight"])


def agg_class_share(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelled(spark, folder).select("l_linenumber", "l_linestatus", "label")
    return report.agg_class_share(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'"), "label", ["l_linenumber"])


def agg_class_desc(spark: SparkSession, folder: str) -> DataFrame:
    return report.agg_class_desc(labelled(spark, folder), "label", ["l_linenumber", "l_linestatus"])


def agg_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return report.agg_value_counts(table(spark, folder, "lineitem"), "l_returnflag")


def agg_count_mean(spark: SparkSession, folder: str) -> DataFrame:
    return report.agg_count_mean(labelled(spark, folder), "l_linestatus", "label")


def agg_class_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return report.agg_class_ratio(skewed(spark, folder), "toxic")


def agg_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderpriority").distinct()


def argmax_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = experiments(spark, folder)
    u = _winners(rows).select(*GROUP, F.lit("untuned").alias("variant"), "method", F.col("untuned_test_auc").alias("test_auc"))
    t = report.argmax_group(rows, GROUP, "tuned_val_auc", ["method"]).select(
        *GROUP, F.lit("tuned").alias("variant"), "method", F.col("tuned_test_auc").alias("test_auc"))
    return u.unionByName(t)


def argmax_override(spark: SparkSession, folder: str) -> DataFrame:
    out = report.argmax_override(experiments(spark, folder), GROUP, "method", MIXTURE, "untuned_val_auc", "untuned_test_auc", ["method"])
    return out.select(*GROUP, "method", "untuned_test_auc")


def topk_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(*KEY, "l_returnflag", (F.col("l_tax") - F.col("l_discount")).alias("diff"))
    return report.topk_group(rows, ["l_returnflag"], "diff", 5, KEY)


def sort_multi(spark: SparkSession, folder: str) -> DataFrame:
    return experiments(spark, folder).select("data", "method", "experiment", "tuned_test_auc").orderBy("data", "method", "experiment")


def sort_custom(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    placed = orders.withColumn("place", report.custom_position("o_orderpriority", ORDER))
    return report.sort_custom(placed, ["o_orderstatus"], "o_orderpriority", ORDER, ["o_orderkey"])


def limit_head(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows of the sorted results, as a report shows them."""
    return experiments(spark, folder).orderBy("data", "method", "experiment").limit(5)


def union_all(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(*KEY, "l_returnflag")
    return rows.where("l_returnflag = 'A'").unionByName(rows.where("l_returnflag <> 'A'")).unionByName(rows)


def union_loose(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), "s_name")
    return c.unionByName(s, allowMissingColumns=True)


def unpivot_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Key/value rows of every experiment, back to one row per set."""
    names = dict(zip(METRICS, ["untuned_val_roc", "tuned_val_roc", "untuned_test_roc", "tuned_test_roc"]))
    wide = experiments(spark, folder).withColumnsRenamed(names)
    pairs = wide.unpivot(["data", "method", "experiment"], list(names.values()), "key", "value")
    return report.unpivot_metrics(pairs, ["data", "method", "experiment"])


def wide_to_long(spark: SparkSession, folder: str) -> DataFrame:
    names = {"untuned_val_auc": "clf_auc_val_a", "tuned_val_auc": "clf_auc_val_b", "untuned_test_auc": "clf_auc_val_c", "tuned_test_auc": "val_roc"}
    wide = experiments(spark, folder).withColumnsRenamed(names).withColumn("name", F.concat_ws("-", *GROUP, "method"))
    return report.wide_to_long(wide, "name", "val", {"a": "A", "b": "B", "c": "C"}, "MIX")


def _alphas(spark: SparkSession, folder: str) -> DataFrame:
    names = {m: f"alpha_{i + 1}" for i, m in enumerate(METRICS)}
    return experiments(spark, folder).withColumnsRenamed(names)


def alpha_long(spark: SparkSession, folder: str) -> DataFrame:
    runs = _alphas(spark, folder).withColumnRenamed("method", "run")
    return report.alpha_long(runs, ["data", "experiment", "run"], ["A", "B", "C", "D"])


def alpha_percent(spark: SparkSession, folder: str) -> DataFrame:
    return report.alpha_percent(_alphas(spark, folder), [f"alpha_{i}" for i in range(1, 5)])


def ttest_greater(spark: SparkSession, folder: str) -> DataFrame:
    tests = report.ttest_greater(experiments(spark, folder), ["data"], "method", MIXTURE, ["untuned_test_auc", "tuned_test_auc"])
    return _rounded(tests, [f"{m}_{s}" for m in ("untuned_test_auc", "tuned_test_auc") for s in ("t", "p")], 6)


def avg_std_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = experiments(spark, folder)
    long = rows.select("data", "method", F.lit(False).alias("tuned"), F.col("untuned_test_auc").alias("auc")).unionByName(
        rows.select("data", "method", F.lit(True).alias("tuned"), F.col("tuned_test_auc").alias("auc")))
    out = report.avg_std_table(long, ["data", "method"], "tuned", "auc")
    return _rounded(out, [f"{t}_{s}" for t in ("untuned", "tuned") for s in ("avg", "std")])


def history_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = experiments(spark, folder).withColumnsRenamed({"untuned_val_auc": "train_auc", "tuned_val_auc": "val_auc"})
    return report.history_series(rows, ["data", "method", "experiment"])


QUERIES = {f.__name__: f for f in (
    join_left_multi, join_left_report, agg_mean_std, agg_mean, agg_sum, agg_class_share, agg_class_desc, agg_value_counts,
    agg_count_mean, agg_class_ratio, agg_distinct, argmax_group, argmax_override, topk_group, sort_multi, sort_custom,
    limit_head, union_all, union_loose, unpivot_metrics, wide_to_long, alpha_long, alpha_percent, ttest_greater,
    avg_std_table, history_series)}

_K = ", ".join(KEY)


def _best(value: str) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY data, experiment ORDER BY {value} DESC, method) AS rn
      FROM {EXPERIMENTS} e) WHERE rn = 1)"""


def _test(metric: str, where: str) -> str:
    """t, and p from the finite series for even degrees of freedom (odd ones
    take the arc tangent form)."""
    return f"""{where}_m AS (SELECT data, method, count({metric}) AS n, avg({metric}) AS a, var_samp({metric}) AS v FROM {EXPERIMENTS} e GROUP BY ALL),
    {where}_t AS (SELECT o.data, o.method, (m.n + o.n - 2)::BIGINT AS df, (m.a - o.a) / nullif(sqrt(((m.n - 1) * m.v + (o.n - 1) * o.v)
        / nullif(m.n + o.n - 2, 0) * (1.0::DOUBLE / m.n + 1.0::DOUBLE / o.n)), 0) AS t
      FROM {where}_m o LEFT JOIN {where}_m m ON m.data = o.data AND m.method = '{MIXTURE}' WHERE o.method <> '{MIXTURE}'),
    {where}_p AS (SELECT data, method, t, CASE WHEN df % 2 = 0 THEN
        (1 - t / sqrt(df + t * t) * list_sum(list_transform(range(df // 2), lambda j:
          exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - 2 * j * ln(2)) * pow(df / (df + t * t), j)))) / 2
      ELSE (1 - 2 / pi() * (atan(t / sqrt(df)) + t / sqrt(df + t * t) * coalesce(list_sum(list_transform(range((df - 1) // 2), lambda j:
          exp(2 * lgamma(j + 1) + 2 * j * ln(2) - lgamma(2 * j + 2)) * pow(sqrt(df / (df + t * t)), 2 * j + 1))), 0))) / 2 END AS p
      FROM {where}_t)"""


_TTEST = f"""WITH {_test('untuned_test_auc', 'u')}, {_test('tuned_test_auc', 't')}
  SELECT data, method, round(u.t, 6) AS untuned_test_auc_t, round(u.p, 6) AS untuned_test_auc_p,
    round(t.t, 6) AS tuned_test_auc_t, round(t.p, 6) AS tuned_test_auc_p FROM u_p u JOIN t_p t USING (data, method)"""
_MEAN_STD = f"""SELECT data, method, {', '.join(f'round(avg({m}), 9) AS {m}_mean, round(stddev_samp({m}), 9) AS {m}_std' for m in METRICS)}
  FROM {EXPERIMENTS} e GROUP BY ALL"""
_GROUP = "data, experiment"
ORACLES = {
    "join_left_multi": f"""SELECT e.data, e.experiment, e.method, e.untuned_test_auc, b.method AS best_method,
      b.untuned_test_auc AS best_test_auc FROM {EXPERIMENTS} e LEFT JOIN {_best('untuned_val_auc')} b
      ON b.data = e.data AND b.experiment = e.experiment""",
    "join_left_report": f"SELECT * FROM ({_MEAN_STD}) m LEFT JOIN ({_TTEST}) t USING (data, method)",
    "agg_mean_std": _MEAN_STD,
    "agg_mean": f"SELECT {_GROUP}, round(avg(tuned_test_auc - untuned_test_auc), 9) AS diff FROM {EXPERIMENTS} e GROUP BY ALL",
    "agg_sum": """SELECT data, round(sum(c / n), 9) AS weight FROM (SELECT l_returnflag AS data, count(*)::DOUBLE AS c,
      sum(count(*)) OVER (PARTITION BY l_returnflag)::DOUBLE AS n FROM lineitem GROUP BY l_returnflag, l_linenumber) GROUP BY data""",
    "agg_class_share": f"""SELECT l_linenumber, {', '.join(
        f"count(*) FILTER (l_linestatus = '{s}' AND label = {c})::DOUBLE / count(*) FILTER (l_linestatus = 'O') AS {n}_class{c}"
        for s, n in (('F', 'untuned'), ('O', 'tuned')) for c in (0, 1))} FROM {LABELLED} l GROUP BY ALL""",
    "agg_class_desc": f"""SELECT l_linenumber, l_linestatus, (count(*) - sum(label))::DOUBLE / count(*) AS target_0,
      sum(label)::DOUBLE / count(*) AS target_1 FROM {LABELLED} l GROUP BY ALL""",
    "agg_value_counts": f"""SELECT l_returnflag, n, {half_even_sql('share', 2)} AS percent FROM (SELECT l_returnflag, count(*) AS n,
      count(*)::DOUBLE / (SELECT count(*) FROM lineitem) * 100.0::DOUBLE AS share FROM lineitem GROUP BY ALL)""",
    "agg_count_mean": f"SELECT l_linestatus, count(label) AS count, sum(label)::DOUBLE / count(label) AS mean FROM {LABELLED} l GROUP BY ALL",
    "agg_class_ratio": f"""SELECT count(*) FILTER (toxic = 0)::DOUBLE / count(*) AS class_0_ratio,
      count(*) FILTER (toxic = 1)::DOUBLE / count(*) AS class_1_ratio FROM {SKEWED} s""",
    "agg_distinct": "SELECT DISTINCT o_orderpriority FROM orders",
    "argmax_group": f"""SELECT {_GROUP}, 'untuned' AS variant, method, untuned_test_auc AS test_auc FROM {_best('untuned_val_auc')} u
      UNION ALL SELECT {_GROUP}, 'tuned', method, tuned_test_auc FROM {_best('tuned_val_auc')} t""",
    "argmax_override": f"""SELECT e.data, e.experiment, e.method, CASE WHEN e.method = '{MIXTURE}' AND b.method <> e.method
      THEN b.untuned_test_auc ELSE e.untuned_test_auc END AS untuned_test_auc FROM {EXPERIMENTS} e
      LEFT JOIN {_best('untuned_val_auc')} b ON b.data = e.data AND b.experiment = e.experiment""",
    "topk_group": f"""SELECT {_K}, l_returnflag, diff FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY diff, {_K}) AS rn
      FROM (SELECT {_K}, l_returnflag, l_tax - l_discount AS diff FROM lineitem)) WHERE rn <= 5""",
    "sort_multi": f"SELECT data, method, experiment, tuned_test_auc FROM {EXPERIMENTS} e ORDER BY data, method, experiment",
    "sort_custom": f"""SELECT o_orderkey, o_orderstatus, o_orderpriority, list_position({ORDER!r}, o_orderpriority) AS place FROM orders
      ORDER BY o_orderstatus, place, o_orderkey""",
    "limit_head": f"SELECT data, method, experiment, {', '.join(METRICS)} FROM {EXPERIMENTS} e ORDER BY data, method, experiment LIMIT 5",
    "union_all": f"SELECT {_K}, l_returnflag FROM lineitem UNION ALL SELECT {_K}, l_returnflag FROM lineitem",
    "union_loose": """SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment, NULL::VARCHAR AS s_name FROM customer
      UNION ALL SELECT s_nationkey, s_acctbal, NULL, s_name FROM supplier""",
    "unpivot_metrics": f"""SELECT data, method, experiment, 'val' AS set, untuned_val_auc AS untuned, tuned_val_auc AS tuned FROM {EXPERIMENTS} e
      UNION ALL SELECT data, method, experiment, 'test', untuned_test_auc, tuned_test_auc FROM {EXPERIMENTS} e""",
    "wide_to_long": " UNION ALL ".join(
        f"SELECT concat_ws('-', data, experiment, method) AS data_set, '{n}' AS method, {m} AS auc FROM {EXPERIMENTS} e"
        for m, n in zip(METRICS, ["A", "B", "C", "MIX"])),
    "alpha_long": " UNION ALL ".join(
        f"SELECT data, experiment, method AS run, '{n}' AS method, {m} AS alpha FROM {EXPERIMENTS} e" for m, n in zip(METRICS, "ABCD")),
    "alpha_percent": f"""SELECT data, experiment, method,
      {', '.join(f'{half_even_sql(f"100.0::DOUBLE * {m}", 2)} AS alpha_{i + 1}' for i, m in enumerate(METRICS))} FROM {EXPERIMENTS} e""",
    "ttest_greater": _TTEST,
    "avg_std_table": f"""SELECT data, method, round(avg(untuned_test_auc), 9) AS untuned_avg, round(stddev_samp(untuned_test_auc), 9) AS untuned_std,
      round(avg(tuned_test_auc), 9) AS tuned_avg, round(stddev_samp(tuned_test_auc), 9) AS tuned_std FROM {EXPERIMENTS} e GROUP BY ALL""",
    "history_series": f"""SELECT data, method, experiment, untuned_val_auc AS train_auc, tuned_val_auc AS val_auc FROM {EXPERIMENTS} e
      ORDER BY data, method, experiment""",
}
