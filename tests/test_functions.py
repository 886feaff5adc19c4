import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.functions import ordered
from tabweave.functions.hashing import normal_pair, row_hash
from tabweave.functions.normal import normal_cdf, normal_ppf, student_upper


def test_normal_functions(spark):
    zs = [-6.0, -2.5, -1.0, -0.1, 0.0, 0.3, 1.7, 4.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect()
    for z, p in rows:
        assert abs(p - statistics.NormalDist().cdf(z)) < 1e-7
    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_ppf(F.col("p")).alias("z")).collect()
    for p, z in rows:
        assert abs(z - statistics.NormalDist().inv_cdf(p)) < 1e-6


def _upper(t, df):
    """P(T > t) by integrating the density from 0."""
    grid = np.linspace(0.0, abs(t), 200_001)
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    y = np.exp(log_c - (df + 1) / 2 * np.log1p(grid * grid / df))
    half = float(np.sum((y[1:] + y[:-1]) / 2) * (grid[1] - grid[0]))
    return 0.5 - half if t >= 0 else 0.5 + half


def test_student(spark):
    cases = [(t, df) for t in (-3.0, -0.5, 0.0, 0.7, 2.7365142, 5.0) for df in (1, 2, 3, 4, 5, 18, 99, 999, 1000, 1001, 5000, 50_000)]
    rows = spark.createDataFrame(cases, "t double, df long").select("t", "df", student_upper(F.col("t"), F.col("df")).alias("p"))
    for t, df, p in rows.collect():
        assert abs(p - _upper(t, df)) < 1e-6, (t, df, p)


def test_student_far_out(spark):
    """Closed forms for one and two degrees of freedom, and the normal limit, far into the tail."""
    import math
    for t in (0.1, 1.0, 10.0, 1000.0):
        row = spark.range(1).select(*[student_upper(F.lit(t), F.lit(df)).alias(f"p{df}") for df in (1, 2)]).first()
        assert abs(row.p1 / (math.atan2(1.0, t) / math.pi) - 1) < 1e-8
        assert abs(row.p2 / (1 / ((t * t + 2) * (1 + t / math.sqrt(t * t + 2)))) - 1) < 1e-8
    row = spark.range(1).select(student_upper(F.lit(6.0), F.lit(10**9)).alias("p")).first()
    assert abs(row.p / (math.erfc(6 / math.sqrt(2)) / 2) - 1) < 1e-5


def test_student_golden(spark):
    rows = spark.createDataFrame([(2.7365142, 0.0068), (-0.2272316, 0.5886), (0.0, 0.5)], "t double, p double")
    for p, got in rows.select("p", student_upper(F.col("t"), F.lit(18).cast("long"))).collect():
        assert round(got, 4) == p


def test_hash_is_partition_independent(spark):
    df = spark.range(1000)
    a = df.repartition(1).select("id", row_hash(["id"], 5).alias("h")).collect()
    b = df.repartition(7).select("id", row_hash(["id"], 5).alias("h")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_normals_look_normal(spark):
    h = spark.range(20_000).select(row_hash(["id"], 1).alias("h"))
    a, b = normal_pair(F.col("h"), 0)
    c, d = normal_pair(F.col("h"), 1)
    got = h.select(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")).toPandas()
    assert np.allclose(got.mean(), 0, atol=0.03) and np.allclose(got.std(), 1, atol=0.03)
    assert np.allclose(np.corrcoef(got.T), np.eye(4), atol=0.03)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("current", [False, True])
def test_running_by_ranges_equals_one_window(spark, descending, current):
    rng = np.random.default_rng(1)
    # a third of all rows in one group
    rows = [(int(g) if g > 3 else 0, i, int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 10, 3000), rng.integers(0, 99, 3000)))]
    df = spark.createDataFrame(rows, "g int, o int, v long").repartition(5)
    outputs = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")}
    run = lambda n: sorted(map(tuple, ordered.running(
        df, ["g"], ["o"], outputs, include_current=current, descending=descending, one_task_rows=n).collect()), key=str)
    assert run(0) == run(10_000)


def test_exact_quantiles(spark):
    """Continuous, tied and heavy-tailed columns, a third of one value, and missing values."""
    rng = np.random.default_rng(2)
    n = 5001
    wide = np.exp(rng.normal(size=n) * 40)
    hot = np.where(rng.random(n) < 0.34, 0.5, rng.normal(size=n))
    data = {"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "wide": wide, "hot": hot, "one": np.full(n, 3.0)}
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*data.values())], ", ".join(f"{c} double" for c in data))
    probs = (0.0, 0.1, 0.25, 0.3333, 0.5, 0.9, 0.9999, 1.0)
    for knots in (2, 16, 256):
        for parts in (1, 8):
            got = {r["column"]: r["q"] for r in ordered.exact_quantiles(df.repartition(parts), list(data), probs, knots).collect()}
            for c, v in data.items():
                assert np.allclose(got[c], np.quantile(v, probs), rtol=1e-12), (c, knots)
    holes = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (float("inf"), None), (2.0, None)], "x double, y double")
    got = ordered.exact_quantiles(holes, ["x", "y"], [0.5]).collect()
    assert [(r["column"], r["rows"], r["q"]) for r in got] == [("x", 2, [1.5])]
    assert ordered.exact_quantiles(holes.limit(0), ["x"], [0.5]).count() == 0


def test_quantiles_shuffle_counts_only(spark):
    """What a pass sends is a row per knot, however many values there are."""
    df = spark.range(200_000).select((F.col("id") * 0.37).alias("_v0"))
    coded = ordered._coded(df, {0: [10.0 * k for k in range(100)]}, {0: [(float("-inf"), float("inf"), 0, [5])]})
    plan = coded.groupBy("at", "code").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan
