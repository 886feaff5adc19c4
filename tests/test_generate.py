import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.operators import generate


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    z = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 4000)
    kind = np.where(z[:, 0] > 0.5, "high", "low")
    data = [(float(np.exp(a)), int(np.floor(10 * b)), k, 3.0, int(b > 1)) for (a, b), k in zip(z, kind)]
    return spark.createDataFrame(data, "x double, n int, kind string, flat double, y int")


def test_draws_match_the_training_rows(spark, rows):
    real = rows.toPandas()
    made = generate.gen_copula(rows, 4000, ["x", "n", "flat"], ["kind", "y"]).toPandas()
    assert len(made) == 4000 and made["row_id"].is_unique and made["n"].dtype == np.int32
    for c in ("x", "n"):
        want, got = real[c].quantile([0.05, 0.25, 0.5, 0.75, 0.95]), made[c].quantile([0.05, 0.25, 0.5, 0.75, 0.95])
        assert np.allclose(want, got, atol=0.12 * (want.iloc[-1] - want.iloc[0]))
    assert set(made["flat"]) == {3.0}
    assert abs((made["kind"] == "high").mean() - (real["kind"] == "high").mean()) < 0.03
    assert abs(made["y"].mean() - real["y"].mean()) < 0.03
    rank = lambda df: df[["x", "n"]].rank().corr().iloc[0, 1]
    assert abs(rank(made) - rank(real)) < 0.06


def test_draws_do_not_depend_on_partitions(spark, rows):
    model = generate.fit_copula(rows, ["x", "n"], ["kind"])
    a = generate.draw_copula(spark, model, 200).orderBy("row_id").collect()
    b = generate.draw_copula(spark, model, 200).repartition(3).orderBy("row_id").collect()
    assert a == b
    assert a != generate.draw_copula(spark, model, 200, seed=6).orderBy("row_id").collect()


def test_conditional_counts(spark, rows):
    made = generate.gen_conditional(rows, "y", {1: 30, 0: 70}, ["x"], ["kind"]).toPandas()
    assert (made["y"] == 1).sum() == 30 and len(made) == 100 and made["row_id"].is_unique
    assert made.loc[made["y"] == 1, "x"].median() > made.loc[made["y"] == 0, "x"].median()


def test_fit_does_not_depend_on_partitions(spark, rows):
    fits = [generate.fit_copula(rows.repartition(n, "x"), ["x", "n", "flat"], ["kind", "y"]) for n in (1, 8)]
    assert fits[0].grids == fits[1].grids and np.array_equal(fits[0].correlation, fits[1].correlation)
    real = rows.toPandas()
    assert np.allclose(fits[0].grids["x"], real["x"].quantile(np.linspace(0, 1, 101)))
    draws = [generate.draw_copula(spark, f, 300).orderBy("row_id").collect() for f in fits]
    assert draws[0] == draws[1]


def test_every_row_has_a_null(spark, rows):
    """Marginals and correlations come from what is present, and the share of nulls is drawn along."""
    third = F.pmod(F.xxhash64("x", "n"), F.lit(3))
    holes = rows.select(F.when(third != 0, F.col("x")).alias("x"), F.when(third != 1, F.col("n")).alias("n"),
                        F.when(third != 2, F.col("kind")).alias("kind"), F.lit(None).cast("double").alias("gone"))
    model = generate.fit_copula(holes, ["x", "n", "gone"], ["kind"])
    full = generate.fit_copula(rows, ["x", "n"], [])
    assert abs(model.correlation[0, 1] - full.correlation[0, 1]) < 0.03
    made = generate.draw_copula(spark, model, 3000).toPandas()
    assert made["gone"].isna().all()
    assert all(abs(made[c].isna().mean() - 1 / 3) < 0.04 for c in ("x", "n", "kind"))
    both = made.dropna(subset=["x", "n"])
    assert abs(both[["x", "n"]].rank().corr().iloc[0, 1] - rows.toPandas()[["x", "n"]].rank().corr().iloc[0, 1]) < 0.08


def test_many_categories(spark):
    """Each category in its share, one of them a third of all, whatever the number of categories."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("common")).otherwise(F.concat(F.lit("c"), F.col("id"))).alias("c"))
    made = generate.draw_copula(spark, generate.fit_copula(df, [], ["c"]), 9000)
    assert made.where("c IS NULL").count() == 0
    counts = made.groupBy("c").count()
    assert abs(counts.where("c = 'common'").first()["count"] - 3000) < 150 and counts.count() > 3000


def test_classes_are_fitted_at_once(spark, rows):
    """Three classes, fitted in the same jobs, equal to three fits."""
    three = rows.withColumn("k", F.when(F.col("x") < 0.5, "a").when(F.col("x") < 2, "b").otherwise("c"))
    models = generate.fit_classes(three, F.col("k"), ["a", "b", "c", "none"], ["x", "n"], ["kind"])
    for k in "abc":
        alone = generate.fit_copula(three.where(F.col("k") == k), ["x", "n"], ["kind"])
        assert models[k].grids == alone.grids and np.array_equal(models[k].correlation, alone.correlation)
    made = generate.gen_conditional(three, "k", {"a": 40, "b": 50, "c": 60}, ["x", "n"], ["kind"]).toPandas()
    assert made["k"].value_counts().to_dict() == {"a": 40, "b": 50, "c": 60} and made["row_id"].is_unique
    assert made.loc[made["k"] == "a", "x"].max() < 0.5 <= made.loc[made["k"] == "b", "x"].min()


def test_thinned_grid(spark, rows):
    model = generate.fit_copula(rows, ["x"], [], grid=101)
    assert np.allclose(generate.thinned(model, 11).grids["x"], generate.fit_copula(rows, ["x"], [], grid=11).grids["x"], rtol=1e-9)
    with pytest.raises(ValueError):
        generate.thinned(model, 8)


def test_family_is_drawn_once(spark, rows):
    """Models that differ in their grids alone: each as if drawn alone, from one range of hashed rows."""
    model = generate.fit_copula(rows, ["x", "n"], ["kind"])
    family = [model, generate.thinned(model, 11), generate.thinned(model, 3)]
    made = generate.draw_family(spark, family, 500)
    for i, m in enumerate(family):
        alone = generate.draw_copula(spark, m, 500).orderBy("row_id").collect()
        assert made.where(generate.MEMBER + f" = {i}").drop(generate.MEMBER).orderBy("row_id").collect() == alone
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("md5(") == 1


def test_scores_are_summed_exactly(spark):
    """Correlations of places given as they are, with holes, in any number of parts."""
    rng = np.random.default_rng(3)
    u = rng.random((3000, 3))
    data = [(int(a > 0.5), float(a), None if c > 0.9 else float((a + b) / 2), float(c)) for a, b, c in u]
    df = spark.createDataFrame(data, "_g int, a double, b double, c double")
    one, many = generate.correlate(df.repartition(1), {}), generate.correlate(df.repartition(7), {})
    assert set(one) == {0, 1} and all(np.array_equal(one[g], many[g]) for g in one)
    ppf = lambda p: generate.normal_ppf_array(np.array(p))
    both = [(a, b) for g, a, b, c in data if g and b is not None]
    assert abs(one[1][0, 1] - np.corrcoef(ppf([a for a, _ in both]), ppf([b for _, b in both]))[0, 1]) < 1e-5
