from collections import Counter

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tabweave.operators import neighbors
from tabweave.operators.neighbors import knn
from tabweave.operators.resample import rebalance, smote, smote_rows


def _brute(points, k):
    out = {}
    for i, p in points.items():
        d = sorted((sum((x - y) ** 2 for x, y in zip(p, q)), j) for j, q in points.items() if j != i)
        out[i] = [(round(a, 9), j) for a, j in d[:k]]
    return out


def _got(df, key="id"):
    return {r[key]: [(round(n["distance2"], 9), n["neighbour"]) for n in r["neighbours"]] for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"block_rows": 16}, {"block_rows": 5, "max_pivots": 3}])
@pytest.mark.parametrize("kind", ["spread", "clustered", "grid", "copies"])
def test_knn_is_exact(spark, kind, limits):
    rng = np.random.default_rng(3)
    if kind == "spread":
        values = rng.normal(size=(150, 3))
    elif kind == "clustered":
        values = np.concatenate([rng.normal(c, 0.01, size=(50, 3)) for c in (0, 5, 100)])
    elif kind == "grid":
        values = rng.integers(0, 4, size=(120, 3)).astype(float)  # many ties and copies
    else:
        values = np.concatenate([np.zeros((50, 3)), rng.normal(size=(100, 3))])  # a third are copies
    points = {i: tuple(map(float, v)) for i, v in enumerate(values)}
    df = spark.createDataFrame([(i, *v) for i, v in points.items()], "id long, a double, b double, c double")
    assert _got(knn(df, "id", ["a", "b", "c"], 5, **limits)) == _brute(points, 5)


def test_knn_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, v array<double>")
    assert _got(knn(df, "id", "v", 5)) == {1: [(1.0, 2)], 2: [(1.0, 1)]}


def test_smote_rows_lie_between(spark):
    rng = np.random.default_rng(4)
    points = {i: tuple(map(float, v)) for i, v in enumerate(rng.normal(size=(40, 2)))}
    df = spark.createDataFrame([(i, *v) for i, v in points.items()], "id long, a double, b double")
    rows = smote_rows(df, ["a", "b"], "id", 500).collect()
    near = {i: {j for _, j in n} for i, n in _brute(points, 5).items()}
    assert len(rows) == 500 and len({r["base"] for r in rows}) > 35
    for r in rows:
        assert r["neighbour"] in near[r["base"]]
        p, q = np.array(points[r["base"]]), np.array(points[r["neighbour"]])
        gap = (np.array([r["a"], r["b"]]) - p) / (q - p)
        assert abs(gap[0] - gap[1]) < 1e-6 and -1e-9 <= gap[0] <= 1
    with pytest.raises(ValueError):
        smote_rows(df.limit(5), ["a", "b"], "id", 10)


def test_class_ratios(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(v), int(i < 20)) for i, v in enumerate(rng.normal(size=420))]
    df = spark.createDataFrame(rows, "id long, a double, y int")
    assert Counter(r["y"] for r in smote(df, "y", ["a"], "id").collect()) == {0: 400, 1: 400}
    assert Counter(r["y"] for r in rebalance(df, "y", ["a"], "id", 0.1, 0.5).collect()) == {1: 40, 0: 80}


def _pairs(df, columns, block_rows):
    """Pairs of a row and a row of a block it is compared with, as the search plans them."""
    rows = df.select(F.col("id").alias("_id"), F.array(*columns).alias("_v"))
    picked = [r["_v"] for r in rows.orderBy("_id").limit(rows.count() // block_rows).collect()]
    pivots = neighbors.Pivots.of(np.array(picked))
    settled, cells = neighbors._own_blocks(rows, pivots, 6, block_rows)
    sizes = settled.groupBy(F.col("_cell").alias("_to")).count()
    sent = neighbors._sent(settled, cells, pivots, 6, None).groupBy("_to").agg(F.count("*").alias("asking"))
    return sent.join(sizes, "_to").agg(F.sum(F.col("asking") * F.col("count"))).first()[0]


def test_pairs_stay_far_below_all_with_outliers(spark):
    rng = np.random.default_rng(6)
    ratios = {}
    for n in (4000, 16000):
        values = rng.normal(size=(n, 3))
        values[-3:] *= 1e4  # far from all others
        rng.shuffle(values)
        df = spark.createDataFrame(pd.DataFrame(values, columns=["a", "b", "c"]).assign(id=np.arange(n)))
        ratios[n] = _pairs(df, ["a", "b", "c"], 64) / n ** 2
    assert ratios[4000] < 0.15 and ratios[16000] < ratios[4000] / 2


def test_rows_without_a_place(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, None]), (3, [float("nan"), 0.0]), (4, [1.0, 1.0]), (5, None), (6, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert _got(knn(df, "id", "v", 5)) == {1: [(1.0, 4)], 4: [(1.0, 1)], 2: [], 3: [], 5: [], 6: []}
    assert knn(df.limit(0), "id", "v", 5).collect() == []


def test_probes_and_recall(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 32))
    values = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id long, v array<double>")
    exact = knn(df, "id", "v", 5, block_rows=100)
    assert neighbors.recall(df, "id", "v", exact, 5, queries=200) == 1.0
    few = neighbors.recall(df, "id", "v", knn(df, "id", "v", 5, block_rows=100, probes=1), 5, queries=200)
    more = neighbors.recall(df, "id", "v", knn(df, "id", "v", 5, block_rows=100, probes=8), 5, queries=200)
    assert few < more and more >= 0.9


@pytest.mark.parametrize("dense", [0.0, 1.0])
@pytest.mark.parametrize("kind", ["spread", "grid", "far", "tiny"])
def test_large_blocks_and_cells_are_exact(spark, kind, dense):
    rng = np.random.default_rng(8)
    values = rng.integers(0, 3, size=(200, 5)).astype(float) if kind == "grid" else rng.normal(size=(200, 5))
    if kind == "far":
        values[:100] += 1e9  # squares that single precision cannot tell apart
        values[-2:] *= 1e30
    if kind == "tiny":
        values[:150] *= 1e-25
    points = {i: tuple(map(float, v)) for i, v in enumerate(values)}
    df = spark.createDataFrame([(i, list(v)) for i, v in points.items()], "id long, v array<double>")
    got = {r["id"]: [n["neighbour"] for n in r["neighbours"]] for r in knn(df, "id", "v", 5, block_rows=20, dense=dense).collect()}
    wanted = {}
    for i, p in points.items():
        d = sorted((float(neighbors.squared_distances(np.array([p]), np.array([q]))[0, 0]), j) for j, q in points.items() if j != i)
        wanted[i] = [j for _, j in d[:5]]
    assert got == wanted


def test_few_distances_are_computed_in_many_dimensions(monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 64))
    reach = np.sqrt(np.partition(neighbors.squared_distances(v, v[:1500]), 6, axis=1)[:, 6])
    order = np.concatenate([np.argsort(reach[:1500]), 1500 + np.argsort(reach[1500:])])  # as blocks are
    v, reach = v[order], reach[order]
    d = neighbors.squared_distances(v, v)
    left, right = (neighbors._Best(np.arange(s.start, s.stop), reach[s], 6) for s in (slice(0, 1500), slice(1500, 3000)))
    measured = []
    monkeypatch.setattr(neighbors, "_add", lambda row, *rest, plain=neighbors._add: (measured.append(len(row)), plain(row, *rest)))
    neighbors._compare(v[:1500], v[1500:], left, right)
    assert sum(measured) < 0.02 * 1500 ** 2
    row, near, gap = right.cut()
    for r in range(0, 1500, 100):
        order = np.lexsort((np.arange(1500), d[1500 + r, :1500]))[:6]
        assert list(near[row == r]) == [k for k in order if d[1500 + r, k] <= right.limit[r]]
        assert (gap[row == r] == d[1500 + r, near[row == r]]).all()
