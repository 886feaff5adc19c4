import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.operators import replicate, score
from tabweave.session import freeze


def _brute(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("limit", [0, 1000])
def test_auc_is_exact(spark, limit):
    rng = np.random.default_rng(7)
    rows = [(g, float(s), int(y)) for g, s, y in zip("ab" * 200, rng.integers(0, 30, 400), rng.integers(0, 2, 400))]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r["g"]: r["auc"] for r in score.auc(df, "s", "y", ["g"], one_task_rows=limit).collect()}
    for g in "ab":
        assert abs(got[g] - _brute([(s, y) for h, s, y in rows if h == g])) < 1e-12
    flipped = {r["g"]: r["auc"] for r in score.auc(df.withColumn("s", -F.col("s")), "s", "y", ["g"], one_task_rows=limit).collect()}
    assert all(abs(got[g] + flipped[g] - 1) < 1e-12 for g in "ab")


def test_weighted_and_single_class(spark):
    rows = [(0.1, 0, 3), (0.5, 1, 2), (0.5, 0, 1), (0.9, 1, 4)]
    df = spark.createDataFrame(rows, "s double, y int, n int")
    flat = [(s, y) for s, y, n in rows for _ in range(n)]
    assert abs(score.auc(df, "s", "y", weight="n").first()["auc"] - _brute(flat)) < 1e-12
    ones = df.where("y = 1")
    assert score.auc(ones, "s", "y").first()["auc"] is None
    assert score.auc(ones, "s", "y", one_class=0.5).first()["auc"] == 0.5


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(8)
    rows = [(float(x), "u" if x + e > 0 else "v", int(x > 0), "train" if i % 2 else "test")
            for i, (x, e) in enumerate(zip(rng.normal(size=600), rng.normal(scale=0.5, size=600)))]
    return spark.createDataFrame(rows, "x double, c string, y int, split string").cache()


def test_trees_learn(spark, separable):
    train, test = separable.where("split = 'train'").drop("split"), separable.where("split = 'test'").drop("split")
    assert score.tstr_score(train, test, "y", rounds=3, depth=3).first()["auc"] > 0.97
    both = {r["split"]: (r["rows"], r["auc"]) for r in score.tree_score(train, test, "y", depth=3).collect()}
    assert both["train"][0] == both["test"][0] == 300 and both["test"][1] > 0.95
    unseen = test.withColumn("c", F.lit("new"))
    assert score.tstr_score(train, unseen, "y", rounds=2, depth=2).first()["auc"] > 0.5
    with pytest.raises(ValueError):
        score.tstr_score(train, test, "y", model="forest")


def test_single_class_training_scores_half(spark, separable):
    ones = separable.where("y = 1").drop("split")
    assert score.tstr_score(ones, separable.drop("split"), "y").first()["auc"] == 0.5


def test_sources_are_ranked(spark, separable):
    bins = {"x": F.floor(F.col("x") * 2), "c": F.col("c")}
    good = separable.where("split = 'train'").withColumn("source", F.lit("good"))
    bad = good.withColumn("y", 1 - F.col("y")).withColumn("source", F.lit("bad"))
    got = {r["source"]: r["auc"] for r in score.per_source_score(good.unionByName(bad), separable.where("split = 'test'"), "y", bins).collect()}
    assert got["good"] > 0.9 and got["bad"] < 0.1


def test_replicates_of_one_model(spark):
    """Every draw is scored as if it stood alone, whether weights are columns or arrays."""
    rng = np.random.default_rng(4)
    rows = [(int(y), float(x), c, s) for y, x, c, s in zip(
        rng.integers(0, 2, 900), rng.normal(size=900), rng.choice(["a", "b"], 900), rng.choice(["val", "test"], 900))]
    real = spark.createDataFrame([(y, x + y, c, s) for y, x, c, s in rows], "label int, x double, c string, split string")
    bins = {"x": F.floor(F.col("x") * 2).cast("int"), "c": F.col("c")}
    draws = freeze(replicate.draw_many(real.drop("split"), 120, 20, ["x"], ["c", "label"]))
    assert {r["replicate"]: r["count"] for r in draws.groupBy("replicate").count().collect()} == dict.fromkeys(range(1, 21), 120)
    got = {(r["replicate"], r["split"]): r for r in replicate.replicate_scores(draws, real, "label", bins).collect()}
    assert len(got) == 40
    few = {(r["replicate"], r["split"]): r["auc"] for r in
           replicate.replicate_scores(draws.where("replicate <= 3"), real, "label", bins).collect()}
    assert all(abs(got[k]["auc"] - auc) < 1e-12 for k, auc in few.items())
    for split in ("val", "test"):
        values = [got[k, split]["auc"] for k in range(1, 21)]
        assert abs(got[1, split]["mean"] - np.mean(values)) < 1e-9 and abs(got[1, split]["std"] - np.std(values, ddof=1)) < 1e-9
        assert np.mean(values) > 0.6


def test_trees_do_not_depend_on_the_layout(spark):
    """Rows in any order and number of parts, a third of them copies, hundreds of categories."""
    rng = np.random.default_rng(8)
    level = rng.normal(size=300)
    kind = np.where(rng.random(3000) < 0.34, 0, rng.integers(0, 300, 3000))
    rows = [(f"c{k}" if k % 50 else None, 0.0 if k == 0 else float(x), int(level[k] + x > 0)) for k, x in zip(kind, rng.normal(size=3000))]
    df = spark.createDataFrame(rows, "c string, x double, y int")
    got = {score.score_trainval(df.withColumn("split", F.lit("train")).repartition(n, how), "y", rounds=4, depth=3).first()["auc"]
           for n, how in ((1, "x"), (7, "x"), (3, "c"))}
    assert len(got) == 1 and got.pop() > 0.9
    laid = score.training_layout(score._features(df, "y", [])(df))
    assert laid.agg(F.sum("_n")).first()[0] == 3000 and laid.count() < 2100
