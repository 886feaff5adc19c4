"""Collecting many experiment results: arg-max rows, means, t-tests, shares,
and the reshaping around them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.normal import student_upper
from tabweave.functions.rounding import half_even

# ---------------------------------------------------------------- rows per group


def topk_group(df: DataFrame, by: Sequence[str], value: str, k: int, ties: Sequence[str], largest: bool = False) -> DataFrame:
    """The k rows with the smallest (or largest) value per group; ``ties``
    decide among equals and must make the order total.

    Spark limits each group to k rows before the shuffle too, so a group with
    a third of all rows costs no more than any other.
    """
    direction = F.desc(value) if largest else F.asc(value)
    order = Window.partitionBy(*by).orderBy(direction, *ties)
    rows = df.where(F.col(value).isNotNull())
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def argmax_group(df: DataFrame, by: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """The whole row of the first maximum per group."""
    return topk_group(df, by, value, 1, ties, largest=True)


def argmax_override(df: DataFrame, by: Sequence[str], method: str, mixture: str, choose: str, replace: str,
                    ties: Sequence[str]) -> DataFrame:
    """Give the mixture's row the ``replace`` value of the group's winner by
    ``choose`` wherever another method won."""
    winners = argmax_group(df, by, choose, ties).select(
        *by, F.col(method).alias("_winner"), F.col(replace).alias("_value"))
    joined = df.join(winners, list(by), "left")
    swap = (F.col(method) == mixture) & (F.col(method) != F.col("_winner"))
    return joined.withColumn(replace, F.when(swap, F.col("_value")).otherwise(F.col(replace))).select(*df.columns)


def custom_position(column: str, order: Sequence[str]) -> Column:
    """Place in a fixed order; unlisted values come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1)).cast("int")


def sort_custom(df: DataFrame, before: Sequence[str], column: str, order: Sequence[str], after: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*before, custom_position(column, order), *after)


# ---------------------------------------------------------------- aggregates


def agg_mean_std(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``<metric>_mean`` and ``<metric>_std`` (sample) per group; null keys drop out."""
    keyed = df.dropna("any", subset=list(by))
    stats = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return keyed.groupBy(*by).agg(*stats)


def agg_class_share(untuned: DataFrame, tuned: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """Shares of class 0 and 1, untuned and tuned side by side.

    Both are divided by the number of tuned rows.
    """
    both = untuned.select(*by, F.lit(0).alias("_t"), F.col(label).alias("_y")).unionByName(
        tuned.select(*by, F.lit(1).alias("_t"), F.col(label).alias("_y")))
    n = F.count_if(F.col("_t") == 1)
    shares = [(F.count_if((F.col("_t") == t) & (F.col("_y") == c)) / F.nullif(n, F.lit(0))).alias(f"{name}_class{c}")
              for t, name in ((0, "untuned"), (1, "tuned")) for c in (0, 1)]
    return both.groupBy(*by).agg(*shares)


def agg_class_desc(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """``(N - sum)/N`` and ``sum/N`` of a 0/1 label per group."""
    n, ones = F.count(F.lit(1)), F.sum(F.col(label).cast("long"))
    return df.groupBy(*by).agg(((n - ones) / n).alias("target_0"), (ones / n).alias("target_1"))


def agg_value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage (2 digits) per value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(column)).scalar()
    return counts.select(column, "n", half_even(F.col("n") / total * 100.0, 2).alias("percent"))


def agg_count_mean(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(value).alias("count"), F.avg(value).alias("mean"))


def agg_class_ratio(df: DataFrame, label: str) -> DataFrame:
    y, n = F.col(label), F.count(F.lit(1))
    return df.agg((F.count_if(y == 0) / n).alias("class_0_ratio"), (F.count_if(y == 1) / n).alias("class_1_ratio"))


def avg_std_table(df: DataFrame, by: Sequence[str], tuned: str, metric: str) -> DataFrame:
    """Mean and std of a metric, with the tuned flag turned into columns."""
    wide = df.withColumn("_t", F.when(F.col(tuned), "tuned").otherwise("untuned")).groupBy(*by).pivot(
        "_t", ["untuned", "tuned"]).agg(F.avg(metric).alias("avg"), F.stddev_samp(metric).alias("std"))
    return wide.select(*by, *[f"{t}_{s}" for t in ("untuned", "tuned") for s in ("avg", "std")])


def ttest_greater(df: DataFrame, by: Sequence[str], method: str, mixture: str, metrics: Sequence[str]) -> DataFrame:
    """Is the mixture's mean greater? Equal-variance two-sample t-test of the
    mixture against every other method: ``<metric>_t`` and ``<metric>_p``.

    One aggregate gives all moments; the rest works on a row per group. Zero
    variance in both samples gives null, and so does a data set without the mixture.
    """
    stats = df.groupBy(*by, method).agg(*[
        f(m).alias(f"{m}_{n}") for m in metrics
        for n, f in (("n", F.count), ("avg", F.avg), ("var", F.var_samp))])
    own = stats.where(F.col(method) == mixture).select(*by, *[F.col(f"{m}_{n}").alias(f"_{m}_{n}") for m in metrics for n in ("n", "avg", "var")])
    pairs = stats.where(F.col(method) != mixture).join(own, list(by), "left")
    out = pairs.select(*by, method, *[_t_value(m).alias(f"{m}_t") for m in metrics],
                       *[(F.col(f"{m}_n") + F.col(f"_{m}_n") - 2).cast("long").alias(f"_{m}_df") for m in metrics])
    tests = [c for m in metrics for c in (
        F.col(f"{m}_t"),
        F.when(F.col(f"{m}_t").isNotNull(), student_upper(F.col(f"{m}_t"), F.col(f"_{m}_df"))).alias(f"{m}_p"))]
    return out.select(*by, method, *tests)


def _t_value(metric: str) -> Column:
    n1, a1, v1 = (F.col(f"_{metric}_{s}") for s in ("n", "avg", "var"))
    n2, a2, v2 = (F.col(f"{metric}_{s}") for s in ("n", "avg", "var"))
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - 2, F.lit(0))
    spread = F.sqrt(pooled * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return (a1 - a2) / F.nullif(spread, F.lit(0.0))


# ---------------------------------------------------------------- reshaping


def unpivot_metrics(df: DataFrame, by: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    """Key/value result rows -> ``(.., set, untuned, tuned)``.

    Keys look like ``tuned_val_roc``; a conditional aggregate per key, then
    the two sets become rows.
    """
    pick = lambda name: F.max(F.when(F.col(key) == name, F.col(value)))
    wide = df.groupBy(*by).agg(*[pick(f"{t}_{s}_roc").alias(f"{t}_{s}") for t in ("untuned", "tuned") for s in ("val", "test")])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("set"), F.col(f"untuned_{s}").alias("untuned"),
                                        F.col(f"tuned_{s}").alias("tuned")) for s in ("val", "test")]))
    return wide.select(*by, rows.alias("_r")).select(*by, "_r.*")


def wide_to_long(df: DataFrame, data: str, metric: str, methods: Mapping[str, str], mixture: str | None = None) -> DataFrame:
    """Columns ``clf_auc_<metric>_<source>`` -> rows ``(data_set, method, auc)``.

    ``methods`` maps the column endings to method names; ``<metric>_roc`` is
    the mixture's column.
    """
    columns = {f"clf_auc_{metric}_{end}": name for end, name in methods.items()}
    if mixture:
        columns[f"{metric}_roc"] = mixture
    long = df.select(F.col(data).alias("data_set"), *[F.col(c).cast("double").alias(n) for c, n in columns.items()])
    return long.unpivot(["data_set"], list(columns.values()), "method", "auc")


def alpha_long(df: DataFrame, by: Sequence[str], methods: Sequence[str], value: str = "alpha") -> DataFrame:
    """Columns alpha_1, alpha_2, ... -> one row per method."""
    wide = df.select(*by, *[F.col(f"alpha_{i + 1}").cast("double").alias(m) for i, m in enumerate(methods)])
    return wide.unpivot(list(by), list(methods), "method", value)


def alpha_percent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: half_even(100.0 * F.col(c), 2) for c in columns})


def history_series(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Train and validation AUC by trial, in order."""
    return df.select(*order, "train_auc", "val_auc").orderBy(*order)
