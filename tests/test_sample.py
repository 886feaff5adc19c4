import hashlib
from collections import Counter

import pyarrow as pa
import pytest

from tabweave.functions.hashing import md5_prefixes
from tabweave.operators import sample


@pytest.mark.parametrize("rows, rest, want", [
    (45_222, 1 - 0.666, [31_655, 9_035, 4_532]), (50_000, 1 - 0.666, [35_000, 9_990, 5_010]),
    (50_000, 1 - 0.6666666, [35_000, 9_999, 5_001])])
def test_split_sizes(rows, rest, want):
    assert sample.split_sizes(rows, [0.3, rest]) == want


def test_class_sizes_add_up():
    assert sample.class_sizes(10_000, 0.0018) == {1: 18, 0: 9_982}
    assert all(sum(sample.class_sizes(n, 0.5).values()) == n for n in range(20))


def test_split_is_exact_disjoint_and_repeatable(spark):
    df = spark.range(1000)
    a = sample.split3(df.repartition(1), ["id"])
    b = sample.split3(df.repartition(9), ["id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert Counter(r["split"] for r in a.collect()) == {"train": 700, "val": 199, "test": 101}
    assert len({r["id"] for r in a.collect()}) == 1000
    other = sample.split3(df, ["id"], seed=6)
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, other.collect()))


def _copies(spark):
    """1,000 rows, of which 400 and 300 are copies of two rows."""
    rows = [(1, "x")] * 400 + [(2, "y")] * 300 + [(i, "z") for i in range(3, 303)]
    return spark.createDataFrame(rows, "a int, b string").repartition(4)


def test_splitting_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(sample, "_BLOCK", 7)
    df = _copies(spark)
    parts = sample.split3(df)
    assert Counter(r["split"] for r in parts.collect()) == {"train": 700, "val": 199, "test": 101}
    assert Counter((r["a"], r["b"]) for r in parts.collect()) == Counter(map(tuple, df.collect()))
    for n in (1, 350, 399, 400, 401, 700, 999, 1000):
        got = Counter(map(tuple, sample.sample_n(df, n).collect()))
        assert sum(got.values()) == n and not got - Counter(map(tuple, df.collect()))


def test_rank_of_copies(spark, monkeypatch):
    monkeypatch.setattr(sample, "_BLOCK", 7)
    ranked = sample.global_rank(_copies(spark)).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 1001))
    places = sorted(r["rank"] for r in ranked if r["a"] == 1)
    assert places == list(range(places[0], places[0] + 400))


def test_cut_outside_its_window_is_found(spark):
    """Rows that were picked by the same hash before are no longer uniform."""
    df = sample.sample_n(spark.range(5000), 500, ["id"])
    again = sample.sample_n(df, 50, ["id"])
    assert {r[0] for r in again.collect()} == {r[0] for r in sample.sample_n(spark.range(5000), 50, ["id"]).collect()}


def test_sample_errors_and_cap(spark):
    df = spark.range(10)
    with pytest.raises(ValueError):
        sample.sample_n(df, 11, ["id"])
    assert sample.sample_n(df, 0, ["id"]).count() == 0
    assert sample.sample_cap(df, 10, ["id"]).count() == 10
    assert sample.sample_cap(df, 4, ["id"]).count() == 4


def test_condition_and_undersample(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(500)], "id int, y int")
    got = Counter(r["y"] for r in sample.sample_condition(df, "y", {1: 20, 0: 80}, ["id"]).collect())
    assert got == {0: 80, 1: 20}
    with pytest.raises(ValueError):
        sample.sample_condition(df, "y", {1: 51}, ["id"])
    assert Counter(r["y"] for r in sample.undersample(df, "y", 0.5, ["id"]).collect()) == {0: 100, 1: 50}
    copies = spark.createDataFrame([(1, 1)] * 30 + [(2, 0)] * 70, "a int, y int")
    assert Counter(map(tuple, sample.sample_condition(copies, "y", {1: 10, 0: 33}).collect())) == {(1, 1): 10, (2, 0): 33}


def test_replicates_are_exact_and_differ(spark):
    out = sample.replicate(spark.range(200), 50, 8, ["id"]).collect()
    draws = [frozenset(r["id"] for r in out if r["replicate"] == k) for k in range(1, 9)]
    assert all(len(d) == 50 for d in draws) and len(set(draws)) == 8


def test_draw_is_a_filter_on_the_scan(spark, folder):
    """No row is shuffled for a sample: the plan is a scan and a filter."""
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    plan = sample.sample_n(customers, 50, ["c_custkey"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_prefixes_are_those_of_md5():
    texts = ["", "a", "ä-1", *["x" * k for k in (20, 50, 55, 56, 63, 64, 65, 130)]] * 20
    endings = [f"-{r}-5" for r in (1, 9, 10, 100)]
    made = md5_prefixes(pa.array(["cut off", *texts])[1:], endings)
    assert made.tolist() == [[int(hashlib.md5((t + e).encode()).hexdigest()[:8], 16) for e in endings] for t in texts]


@pytest.mark.parametrize("copies", [1, 40])
@pytest.mark.parametrize("n", [0, 1, 130, 400])
def test_replicates_follow_the_hash(spark, copies, n):
    rows = [(i // copies, "x" * (i // copies % 70)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    wanted = Counter()
    for k in range(1, 13):
        order = sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}-{r[1]}-{k}-5".encode()).hexdigest())
        wanted.update((*r, k) for r in order[:n])
    assert Counter(tuple(r) for r in sample.replicate(df, n, 12).collect()) == wanted
