"""Synthetic rows from copulas. Their draws are checked statistically in the
tests; no SQL stands beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import generate
from tabweave.operators.sample import class_sizes
from tabweave.plans.inputs import NUMERIC, labelled, skewed
from tabweave.session import spread


def gen_copula(spark: SparkSession, folder: str) -> DataFrame:
    """As many synthetic rows as there are real ones."""
    rows = spread(labelled(spark, folder))
    return generate.gen_copula(rows, rows.count(), NUMERIC, ["l_linestatus", "label"])


def gen_conditional(spark: SparkSession, folder: str) -> DataFrame:
    """Class counts fixed to the shares of the real table."""
    rows = skewed(spark, folder)
    n, share = rows.agg(F.count(F.lit(1)), F.avg("toxic")).first()
    return generate.gen_conditional(rows, "toxic", class_sizes(n, share), ["n_chars", "n_words", "n_lines"], [])


QUERIES = {f.__name__: f for f in (gen_copula, gen_conditional)}
ORACLES: dict[str, str] = {}
