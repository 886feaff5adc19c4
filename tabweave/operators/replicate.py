"""How much a score varies from draw to draw of one fitted model.

One model is fitted, all draws are made in one go (a row's draw follows from
its number), and the scorers of all draws are fitted and applied as one batch on
counts by draw and bin. Nothing is done once per draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.generate import draw_copula, fit_copula
from tabweave.operators.score import per_source_score

REPLICATE = "replicate"


def replicate_scores(draws: DataFrame, real: DataFrame, label: str, bins: dict[str, Column], split: str = "split") -> DataFrame:
    """``(replicate, split, auc, mean, std)``: the AUC of each draw on each split
    of the real rows, and mean and standard deviation over the draws.

    ``draws`` has a ``replicate`` column. A draw with one class of labels gives
    every row the scores of that class, and has an AUC all the same.
    """
    scored = per_source_score(draws, real, label, bins, [REPLICATE], split)
    over = Window.partitionBy(split)  # a row per draw
    return scored.withColumn("mean", F.avg("auc").over(over)).withColumn("std", F.stddev_samp("auc").over(over))


def draw_many(train: DataFrame, n: int, times: int, numeric: Sequence[str], categorical: Sequence[str], seed: object = 5, **fit: object) -> DataFrame:
    """``times`` draws of ``n`` rows from one copula fitted on ``train``, with a ``replicate`` column from 1 on."""
    model = fit_copula(train, numeric, categorical, **fit)
    rows = draw_copula(train.sparkSession, model, n * times, seed)
    return rows.withColumn(REPLICATE, F.floor(F.col("row_id") / n).cast("int") + 1)


def replicate_model(train: DataFrame, real: DataFrame, n: int, label: str, bins: dict[str, Column], numeric: Sequence[str],
                    categorical: Sequence[str], times: int = 50, split: str = "split", seed: object = 5) -> DataFrame:
    """``replicate_scores`` of ``times`` draws from one copula; ``label`` is one of the categorical columns."""
    return replicate_scores(draw_many(train, n, times, numeric, categorical, seed), real, label, bins, split)
