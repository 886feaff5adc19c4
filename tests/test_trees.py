"""Trees on counts by bins: the cuts, the counts, and what a learner is given."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabweave.functions import cuts
from tabweave.operators import score
from tabweave.session import store


def test_cuts_are_near_quantiles_and_keep_few_values_apart(spark):
    rng = np.random.default_rng(5)
    n = 4000
    skew = np.where(rng.random(n) < 0.4, 7.0, rng.lognormal(sigma=3, size=n) * rng.choice([-1.0, 1.0], n))
    data = {"wide": rng.normal(size=n), "skew": skew, "clock": 1.6e9 + rng.random(n) * 1e-3, "rare": (rng.random(n) < 0.995).astype(float),
            "zero": rng.choice([-0.0, 0.0, 5.0, float("inf")], n), "hole": np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 40, n)),
            "none": np.full(n, np.nan)}
    rows = [tuple(map(float, r)) for r in zip(*data.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data))
    found = cuts.value_cuts(df, list(data), 63)
    assert found["rare"] == [1.0] and found["zero"] == [5.0, float("inf")] and found["hole"] == list(range(1, 40)) and found["none"] == []
    for c in ("wide", "clock"):
        held = np.bincount(np.searchsorted(found[c], data[c], "right"), minlength=63)
        assert len(found[c]) == 62 and held.max() <= 1.5 * n / 63, (c, held)
    assert 7.0 in found["skew"] and len(found["skew"]) > 30
    at = np.searchsorted(found["skew"], skew, "right")
    assert set(skew[at == found["skew"].index(7.0) + 1]) == {7.0}
    # neither order nor parts of the input matter
    assert cuts.value_cuts(df.repartition(5, "wide"), list(data), 63) == found
    # beyond one task's tables
    assert cuts.value_cuts(df.where("false"), ["wide"], 63) == {"wide": []}


@pytest.mark.parametrize("rows_at_once", [100, 1 << 18])
def test_bin_counts_are_exact(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(cuts, "_ROWS", rows_at_once)
    rng = np.random.default_rng(6)
    wide = {f"x{i}": list(np.linspace(-2, 2, 61)) for i in range(13)}  # too many for one whole number
    values = np.where(rng.random((1500, 13)) < 0.1, np.nan, rng.normal(size=(1500, 13)).round(1))
    values[700:1400] = values[:700]  # copies
    kind = rng.choice(["a", "b"], 1500)
    kind[700:1400] = kind[:700]
    rows = [(str(k) if k == "a" else None, *map(float, v)) for k, v in zip(kind, values)]
    df = spark.createDataFrame(rows, "kind string, " + ", ".join(f"{c} double" for c in wide))
    want: dict = {}
    for k, *v in rows:
        key = (k, *[62 if np.isnan(x) else int(np.searchsorted(wide[c], x, "right")) for c, x in zip(wide, v)])
        want[key] = want.get(key, 0) + 1
    made = {tuple(r)[:-1]: r["_n"] for r in cuts.bin_counts(df, wide, ["kind"]).collect()}
    assert made == want
    nested = df.withColumn("kind", F.struct("kind"))
    assert sorted(r["_n"] for r in cuts.bin_counts(nested, wide, ["kind"]).collect()) == sorted(want.values())


def test_buckets_combine(spark):
    values = np.sort(np.array([-3.0, -1.0, -1.0, 0.0, 2.0, 2.0, float("inf")]))
    code, n, low, high = cuts._buckets(values, None)
    assert np.all(np.diff(code) > 0) and n.sum() == 7 and list(low) == sorted(set(values)) and list(high) == list(low)
    assert cuts._floats(pa.chunked_array([[1, None]])).tolist()[0] == 1.0


def test_learners_see_counts(spark, monkeypatch):
    """6,000 rows of different values make few rows for rounds and scoring; none is lost."""
    rng = np.random.default_rng(5)
    x, flag, hole = rng.normal(size=6000), rng.random(6000) < 0.995, rng.random(6000) < 0.1
    split = np.where(rng.random(6000) < 0.7, "train", "val")
    rows = [(float(v), float(f), None if h else 1.0, int(v + h + 3 * (not f) > 0.5), str(s)) for v, f, h, s in zip(x, flag, hole, split)]
    df = spark.createDataFrame(rows, "x double, flag double, hole double, y int, split string")
    laid, kept = [], score.training_layout
    monkeypatch.setattr(score, "training_layout", lambda prepared: laid.append(kept(prepared)) or laid[-1])
    got = {r["split"]: r for r in score.score_trainval(df, "y", rounds=5, depth=4).collect()}
    train = int((split == "train").sum())
    assert got["train"]["rows"] == train and got["val"]["rows"] == 6000 - train and got["val"]["auc"] > 0.99
    assert laid[0].agg(F.sum("_n")).first()[0] == train and laid[0].count() <= 2 * 63 * 2 * 2
    alone = score.tstr_score(df.where("split = 'train'").drop("split"), df.where("split = 'val'"), "y", by=["split"], rounds=5, depth=4).first()
    assert alone["auc"] == got["val"]["auc"]
    flat = score.score_trainval(df.withColumn("y", F.when(F.col("split") == "train", 1).otherwise(F.col("y"))), "y")
    assert {r["split"]: r["auc"] for r in flat.collect()} == {"train": 0.5, "val": 0.5}


def test_stored_rows_come_back(spark):
    df = spark.createDataFrame([(1, 0.1, "a", None), (2, -0.0, None, True)], "k long, x double, s string, b boolean")
    assert store(df).collect() == df.collect() and store(df).schema == df.schema
    odd = df.select("k", F.lit(None).alias("void"), F.array("k").alias("list"), F.col("x").alias("K"))
    assert store(odd).count() == 2


def test_bucket_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    n = 5001
    data = {"a": rng.normal(size=n), "wide": np.exp(rng.normal(size=n) * 40), "0|hot": np.where(rng.random(n) < 0.34, 0.5, rng.normal(size=n)),
            "clock": 1.6e9 + rng.random(n) * 1e-3, "one": np.full(n, 3.0), "cents": rng.integers(9e4, 1e7, n) / 100}
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*data.values())], ", ".join(f"`{c}` double" for c in data))
    probs = list(np.linspace(0, 1, 101))
    for parts in (1, 5):
        got = cuts.bucket_quantiles(df.repartition(parts), list(data), probs)
        for c, v in data.items():
            assert np.allclose(got[c], np.quantile(v, probs), rtol=1e-15, atol=1e-12 * (c == "a")), c
    holes = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (float("-inf"), None), (2.0, None)], "x double, y double")
    assert cuts.bucket_quantiles(holes, ["x", "y"], [0.5]) == {"x": [1.5]}
