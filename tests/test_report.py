import numpy as np
from pyspark.sql import functions as F

from tabweave.functions.rounding import half_even
from tabweave.operators import clean, report


def test_t_from_published_moments(spark):
    """Ten values per group with the given mean and standard deviation."""
    def sample(mean, std):
        v = np.arange(10, dtype=float)
        return (mean + std * (v - v.mean()) / v.std(ddof=1)).tolist()

    rows = [("d", "mix", v) for v in sample(0.8667, 0.0104)] + [("d", "other", v) for v in sample(0.7721, 0.0402)]
    rows += [("flat", m, 0.5) for m in ("mix", "other") for _ in range(10)]
    rows += [("bare", "other", 0.5), ("bare", "other", 0.6)]  # without the mixture
    got = {r["data"]: r for r in report.ttest_greater(spark.createDataFrame(rows, "data string, method string, auc double"),
                                                       ["data"], "method", "mix", ["auc"]).collect()}
    assert round(got["d"]["auc_t"], 2) == 7.20 and got["d"]["auc_p"] < 1e-5
    assert got["bare"]["auc_t"] is None and got["bare"]["auc_p"] is None
    assert got["flat"]["auc_t"] is None and got["flat"]["auc_p"] is None


def test_override_and_ties(spark):
    rows = [("d", 1, "a", 0.9, 0.1), ("d", 1, "b", 0.9, 0.2), ("d", 1, "mix", 0.8, 0.3),
            ("d", 2, "a", 0.5, 0.4), ("d", 2, "mix", 0.8, 0.5)]
    df = spark.createDataFrame(rows, "data string, experiment int, method string, val double, test double")
    out = report.argmax_override(df, ["data", "experiment"], "method", "mix", "val", "test", ["method"])
    assert {(r["experiment"], r["method"]): r["test"] for r in out.collect()} == {
        (1, "a"): 0.1, (1, "b"): 0.2, (1, "mix"): 0.1, (2, "a"): 0.4, (2, "mix"): 0.5}


def test_topk_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = report.topk_group(df, ["g"], "id", 2, ["id"])
    assert sorted(r["id"] for r in top.collect()) == [0, 1, 2, 3, 4, 5]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]


def test_rounding_is_python_rounding(spark):
    rng = np.random.default_rng(11)
    values = [0.58625, 0.5, 2.5, -2.5, 0.00005, -0.00015, 1e17, -3.14159265, 0.0] + [k / 16000 for k in range(4000)]
    values += [float(v) for v in rng.normal(scale=100, size=2000)] + [k / 8 for k in range(-40, 40)]
    df = spark.createDataFrame([(v, ) for v in values], "v double")
    for digits in (0, 2, 4):
        got = df.select("v", half_even(F.col("v"), digits).alias("r")).collect()
        assert [(r["v"], r["r"]) for r in got if r["r"] != round(r["v"], digits)] == []
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(half_even(F.col("v"), 2).alias("r")).collect()
    assert odd[0]["r"] is None and np.isnan(odd[1]["r"])


def test_rounding_leaves_other_columns(spark):
    df = spark.createDataFrame([(2.5, "x", 1)], "a double, b string, c int")
    assert tuple(clean.round_all(df, 0).first()) == (2.0, "x", 1)


def test_cleaning_of_missing_values(spark):
    df = spark.createDataFrame([("?", 1.0), (" ? ", 2.0), ("a?", float("nan")), (None, 4.0), ("b", 5.0)], "c string, v double")
    out = clean.clean_dropna(clean.nan_to_null(clean.clean_sentinel(df)))
    assert [tuple(r) for r in out.collect()] == [("b", 5.0)]


def test_labels_round_trip(spark):
    df = spark.createDataFrame([(" <=50K",), (">50K",), ("other",), (None,)], "y string")
    coded = clean.label_recode(df, "y", {"<=50K": 0, ">50K": 1})
    assert [r["y"] for r in coded.collect()] == [0, 1, None, None]
    assert tuple(clean.unknown_labels(df, "y", {"<=50K": 0, ">50K": 1}).first()) == (1, 4)
    assert [r["y"] for r in clean.label_decode(coded, "y", {0: " <=50K", 1: " >50K"}).collect()] == [" <=50K", " >50K", None, None]
