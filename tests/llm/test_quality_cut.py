"""The chi-square quantile of the quality rules, and what it leaves alone."""

import pytest

from tabweave.llm import quality, registry


@pytest.mark.parametrize("size, want", [(1, 3.8415), (2, 5.9915), (3, 7.8147), (4, 9.4877), (5, 11.0705), (7, 14.0671)])
def test_cut_has_all_degrees(size, want):
    assert abs(quality.chi_square_cut(size, 0.05) - want) < 1e-3
    assert quality.chi_square_cut(size) < quality.chi_square_cut(size + 1)


def test_cut_of_the_statistics_in_use():
    assert quality.chi_square_cut(len(quality.GRID)) == 239.84884075028145


def test_every_document_is_judged_and_no_good_one_is_cut(spark, folder):
    made = registry.QUERIES["op4_quality_rules"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert made.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert made.where("kept IS NULL OR distance IS NULL").count() == 0
    cut = made.where("NOT base_failed AND NOT kept")
    assert cut.count() > 0 and cut.join(labels.where("quality = 1"), "doc_id").count() == 0
