import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.operators import mixture, search


def test_warm_start_golden(spark):
    rows = [("a", 0.9999248497), ("b", 0.5), ("c", 0.5), ("d", 0.5)]
    got = {r["source"]: r["alpha"] for r in mixture.mix_warmstart(spark.createDataFrame(rows, "source string, auc double")).collect()}
    assert abs(got["a"] - 0.9940467) < 1e-6 and all(abs(got[s] - 0.0019844) < 1e-6 for s in "bcd")


def test_normalise_and_augment(spark):
    cands = search.candidate_table(spark, [[1, 1, 2, 0], [0.2, 0.2, 0.2, 0.2]], ["a", "b", "c", "d"])
    got = {(r["cand"], r["source"]): r["alpha"] for r in mixture.mix_augment(cands, 0.2).collect()}
    assert got[(1, "real")] == 0.2 and abs(got[(1, "c")] - 0.4) < 1e-12 and got[(1, "d")] == 0.0
    assert all(abs(sum(v for (c, _), v in got.items() if c == k) - 1) < 1e-12 for k in (1, 2))
    with pytest.raises(ValueError):
        mixture.mix_normalise(cands, 1.5)


def _sources(spark):
    rows = [(f"s{k}", i, float(i * k)) for k in range(1, 5) for i in range(200)]
    return spark.createDataFrame(rows, "source string, id int, v double").repartition(6)


def test_sizes_and_draws(spark):
    weights = [[0.3333, 0.3333, 0.3334, 0.0], [0.25, 0.25, 0.25, 0.25], [1, 0, 0, 0]]
    names = ["s1", "s2", "s3", "s4"]
    src = _sources(spark)
    sizes = mixture.mix_size(mixture.mix_normalise(search.candidate_table(spark, weights, names)), mixture.source_counts(src), 200)
    by_cand = {c: {r["source"]: r["size"] for r in sizes.collect() if r["cand"] == c} for c in (1, 2, 3)}
    assert by_cand == {1: {"s1": 66, "s2": 66, "s3": 68, "s4": 0}, 2: dict.fromkeys(names, 50), 3: {"s1": 200, "s2": 0, "s3": 0, "s4": 0}}
    for independent in (False, True):
        drawn = mixture.mix_draw(src, sizes, ["id"], independent=independent).collect()
        assert Counter(r["cand"] for r in drawn) == {1: 200, 2: 200, 3: 200}
        assert Counter((r["cand"], r["source"]) for r in drawn) == {(c, s): n for c, d in by_cand.items() for s, n in d.items() if n}
        assert len({(r["cand"], r["source"], r["id"]) for r in drawn}) == 600


def _filled(alpha, rows, total):
    """Sizes by raising the water level in small steps: the real-valued targets."""
    size, left, open_ = dict.fromkeys(rows, 0.0), float(total), {s for s in rows if alpha[s] > 0}
    while left > 1e-9 and open_:
        weight = sum(alpha[s] for s in open_)
        level = min(left / weight, *((rows[s] - size[s]) / alpha[s] for s in open_), float("inf"))
        for s in open_:
            size[s] += alpha[s] * level
        left -= weight * level
        open_ = {s for s in open_ if rows[s] - size[s] > 1e-9}
    return size


@pytest.mark.parametrize("alpha,rows,total", [
    ((0.7, 0.1, 0.1, 0.1), (100, 1000, 5000, 300), 4370), ((0.7, 0.1, 0.1, 0.1), (100, 1000, 5000, 300), 200), ((0.7, 0.1, 0.1, 0.1), (100, 1000, 5000, 300), 6400),
    ((0.25, 0.25, 0.25, 0.25), (3, 3, 3, 3), 10), ((1.0, 0.0, 0.0, 0.0), (5, 5, 5, 5), 17), ((0.5, 0.3, 0.2, 0.0), (10, 100, 20, 7), 77)])
def test_capacities(spark, alpha, rows, total):
    """No source gives more than it has, and what one lacks the others share by weight."""
    names = [f"s{k}" for k in range(4)]
    table = spark.createDataFrame([(1, k, s, a) for k, (s, a) in enumerate(zip(names, alpha))], "cand int, ordinal int, source string, alpha double")
    counts = spark.createDataFrame(list(zip(names, rows)), "source string, rows long")
    got = {r["source"]: r["size"] for r in mixture.mix_size(table, counts, total).collect()}
    assert sum(got.values()) == total and all(0 <= got[s] <= n for s, n in zip(names, rows))
    want = _filled(dict(zip(names, alpha)), dict(zip(names, rows)), total)
    if sum(want.values()) > total - 1e-6:  # weights alone can fill it
        assert all(abs(got[s] - want[s]) < 4 for s in names)


def test_sizes_of_equal_pools(spark):
    """With pools as large as the mixture: whole numbers of alpha * total, the remainder to the largest weight."""
    pick = random.Random(3)
    rows, want = [], {}
    for cand in range(40):
        raw = [pick.random() for _ in range(5)]
        alpha = [x / sum(raw) for x in raw]
        size = [int(a * 10_000) for a in alpha]
        size[alpha.index(max(alpha))] += 10_000 - sum(size)
        rows += [(cand, k, f"s{k}", a) for k, a in enumerate(alpha)]
        want |= {(cand, f"s{k}"): n for k, n in enumerate(size)}
    counts = spark.createDataFrame([(f"s{k}", 10_000) for k in range(5)], "source string, rows long")
    got = mixture.mix_size(spark.createDataFrame(rows, "cand int, ordinal int, source string, alpha double"), counts, 10_000)
    assert {(r["cand"], r["source"]): r["size"] for r in got.collect()} == want
    with pytest.raises(Exception, match="fewer rows"):
        mixture.mix_size(spark.createDataFrame(rows[:5], "cand int, ordinal int, source string, alpha double"), counts, 50_001).collect()


def test_draws_from_copies(spark):
    src = spark.createDataFrame([("s1", 1)] * 60 + [("s2", i) for i in range(60)], "source string, id int").repartition(3)
    sizes = mixture.mix_size(search.candidate_table(spark, [[0.75, 0.25], [0.5, 0.5]], ["s1", "s2"]), mixture.source_counts(src), 60)
    drawn = Counter((r["cand"], r["source"]) for r in mixture.mix_draw(src, sizes, ["id"]).collect())
    assert drawn == {(1, "s1"): 45, (1, "s2"): 15, (2, "s1"): 30, (2, "s2"): 30}
    with pytest.raises(ValueError):
        search.score_candidates(src.withColumn("y", F.lit(1)), src.withColumn("y", F.lit(1)).withColumn("split", F.lit("val")),
                                "y", {"id": F.col("id")}, sizes, ["id"]).collect()


def test_corner(spark):
    scores = spark.createDataFrame([("a", 1, 0.7, 0.6), ("b", 2, 0.7, 0.4)], "source string, ordinal int, auc double, alpha double")
    probe = lambda v: spark.createDataFrame([(v,)], "probe double")
    alphas = lambda v: {r["source"]: r["alpha"] for r in mixture.mix_corner(scores, probe(v)).collect()}
    assert alphas(0.71) == {"a": 0.6, "b": 0.4}
    assert alphas(0.70) == {"a": 1.0, "b": 0.0}


def test_history_flags_match_the_sequential_rule(spark):
    rng = np.random.default_rng(9)
    series = {s: [float(v) for v in rng.uniform(0.5, 1.0, 40)] for s in range(4)}
    series[4] = [0.5 + 0.49 * (1 - 0.9 ** t) for t in range(40)]
    rows = [(s, t, v) for s, vs in series.items() for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "s int, t int, score double").repartition(3)
    for patience, percent in ((10, 0.0), (3, 0.0), (1, 5.0)):
        for limit in (0, 1000):
            out = search.early_stop(df, "score", ["t"], ["s"], patience, percent, one_task_rows=limit).collect()
            for s, vs in series.items():
                stops = sorted(r["trial"] for r in out if r["s"] == s and r["stopped"])
                assert (stops[0] if stops else None) == search.no_progress(vs, patience, percent)
    best = search.best_so_far(df, "score", ["t"], ["s"], one_task_rows=0).collect()
    assert all(r["best"] == max(series[r["s"]][: r["t"] + 1]) for r in best)
    with pytest.raises(ValueError):
        search.early_stop(df, "score", ["t"], ["s"], 5, 5.0)


def test_search_prefers_the_informative_source(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=1200)
    noise = rng.integers(0, 2, 1200)
    rows = [("good" if i % 2 else "noise", i, float(v), int(v > 0) if i % 2 else int(noise[i])) for i, v in enumerate(x)]
    src = spark.createDataFrame(rows, "source string, id int, x double, y int")
    real = spark.createDataFrame([(float(v), int(v > 0), "val") for v in rng.normal(size=400)], "x double, y int, split string")
    found = search.mix_search(src, real, "y", {"x": F.floor(F.col("x") * 3)}, ["id"], batch=4, max_trials=8)
    history = found.history.orderBy("trial").collect()
    assert len(history) == found.stopped_at <= 8
    assert found.best["val_auc"] == max(r["val_auc"] for r in history) > 0.95
    assert abs(sum(found.weights.values()) - 1) < 1e-9 and found.weights["good"] > 0.3
    again = search.rescore(found, src, real, "y", ["id"], top=2, rounds=2, depth=2).collect()
    assert len(again) == 2 and all(r["auc"] > 0.9 and r["split"] == "val" for r in again)


def test_augmented_search_keeps_the_real_share(spark):
    rows = [(s, i, float(i % 7), int(i % 7 > 3)) for s in ("a", "b", "real") for i in range(200)]
    src = spark.createDataFrame(rows, "source string, id int, x double, y int")
    real = src.where("source = 'real'").select("x", "y").withColumn("split", F.lit("val"))
    found = search.mix_search(src, real, "y", {"x": F.col("x").cast("int")}, ["id"], augmented=0.25, batch=4, max_trials=4)
    assert found.weights["real"] == 0.25 and abs(sum(found.weights.values()) - 1) < 1e-9
    assert {r["alpha_3"] for r in found.history.collect()} == {0.25}


def test_hp_search_stops(spark):
    got = search.hp_search([{"grid": g} for g in range(20)], lambda s: 0.9 if s["grid"] == 1 else 0.5, spark, patience=3)
    rows = got.orderBy("trial").collect()
    assert [r["val_auc"] for r in rows] == [0.5, 0.9, 0.5, 0.5, 0.5]
    assert [r["trial"] for r in rows if r["tuned"]] == [2] and rows[0]["untuned"]


def test_drawn_weights(spark):
    names = ["a", "b", "c"]
    raw = search.drawn_weights(spark, names, 5, 40, 9)
    got = {(r["cand"], r["source"]): r["alpha"] for r in raw.collect()}
    assert set(got) == {(c, s) for c in range(5, 45) for s in names} and len(set(got.values())) > 100
    assert all(v == int(v) and 1 <= v <= search.GRAIN for v in got.values())
    # a candidate's weights follow from its number alone
    assert got[44, "b"] == search.drawn_weights(spark, names, 44, 1, 9).where("source = 'b'").first()["alpha"]
    near = search.drawn_weights(spark, names, 1, 50, 9, center=[0.9, 0.1, 0.0], reach=0.05).collect()
    middle = dict(zip(names, (0.9, 0.1, 0.0)))
    assert all(abs(r["alpha"] / search.GRAIN - middle[r["source"]]) <= 0.0501 for r in near)


def _searched(spark, good_alone):
    """Three sources, the last one noise: either the first alone knows the
    label, or the first two each know half of it."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(2400):
        x, z, noise, k = int(rng.integers(0, 8)), int(rng.integers(0, 8)), int(rng.integers(0, 2)), i % 3
        y = noise if k == 2 or (good_alone and k) else int(x + z > 7) if good_alone else int(x > 3) if k else int(z > 3)
        rows.append((f"s{k + 1}", i, x, z, y))
    src = spark.createDataFrame(rows, "source string, id int, x int, z int, y int")
    a, b = rng.integers(0, 8, 600), rng.integers(0, 8, 600)
    real = spark.createDataFrame([(int(p), int(q), int(p + q > 7), "test" if i % 2 else "val") for i, (p, q) in enumerate(zip(a, b))],
                                 "x int, z int, y int, split string")
    return src, real


@pytest.mark.parametrize("good_alone", [False, True])
def test_search_starts_warm_or_at_the_corner(spark, good_alone):
    bins = {"x": F.col("x"), "z": F.col("z")}
    src, real = _searched(spark, good_alone)
    found = search.mix_search(src, real, "y", bins, ["id"], batch=2, max_trials=2, size=800)
    assert {"train_auc", "val_auc", "test_auc"} <= set(found.history.columns)
    first = found.history.where("trial = 1").first()
    val = real.where("split = 'val'")
    lone = {r["source"]: r["auc"] for r in search.per_source_score(src, val, "y", bins).collect()}
    start = {r["source"]: r["alpha"] for r in mixture.mix_warmstart(
        spark.createDataFrame(list(lone.items()), "source string, auc double")).collect()}
    warm = search.candidate_table(spark, [[start[s] for s in sorted(start)]], sorted(start))
    sizes = mixture.mix_size(mixture.mix_normalise(warm), mixture.source_counts(src), 800)
    probe = {r["split"]: r["auc"] for r in search.score_candidates(src, val, "y", bins, sizes, ["id"]).collect()}["val"]
    if probe > max(lone.values()):
        assert abs(first["val_auc"] - probe) < 0.01 and first["alpha_1"] < 1
    else:
        assert first[f"alpha_{max(lone, key=lone.get)[1]}"] == 1.0
    assert (probe > max(lone.values())) or good_alone  # the halves add up


def test_promoted_trials_decide(spark):
    bins = {"x": F.col("x"), "z": F.col("z")}
    src, real = _searched(spark, good_alone=True)
    found = search.mix_search(src, real, "y", bins, ["id"], batch=4, max_trials=8, size=800, promote=2, rounds=3, depth=3)
    said = {(r["trial"], r["split"]): r["auc"] for r in found.promoted.collect()}
    assert len(said) == 4 and {s for _, s in said} == {"val", "test"}
    assert found.best["tree_val_auc"] == max(v for (_, s), v in said.items() if s == "val")
    assert found.best["tree_test_auc"] == said[found.best["trial"], "test"]
    kept = found.history.where(F.col("trial") == found.best["trial"]).first()
    assert [found.weights[s] for s in ("s1", "s2")] == [kept["alpha_1"], kept["alpha_2"]]


def test_copula_search(spark):
    """One batch gives what each setting gives alone; the label's shape within classes needs the per-class fit."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 3000)
    x = np.where(y == 1, rng.choice([-2.0, 2.0], 3000), 0.0) + rng.normal(size=3000) * 0.4
    df = spark.createDataFrame([(float(v), int(k), "train" if i % 3 else "val") for i, (v, k) in enumerate(zip(x, y))], "x double, y int, split string")
    train = df.where("split = 'train'")
    bins = {"x": F.floor(F.col("x") * 2)}
    settings = [{"grid": 21, "by_class": False}, {"grid": 21, "by_class": True}, {"grid": 3, "by_class": True}]
    got = search.copula_search(train, df, "y", bins, ["x"], [], settings=settings, patience=3).orderBy("trial").collect()
    assert [r["trial"] for r in got if r["tuned"]] == [2] and got[0]["untuned"] and len(got) == 3
    assert got[1]["val_auc"] > 0.95 > got[0]["val_auc"] + 0.2
    alone = search.copula_search(train, df, "y", bins, ["x"], [], settings=settings[1:2]).first()
    assert alone["val_auc"] == got[1]["val_auc"]
    assert len(search.copula_settings()) == 16 and search.copula_settings()[0] == {"grid": 101, "by_class": False}
    # nothing after trial 2 gets better, so patience 1 stops at the third
    assert len(search.copula_search(train, df, "y", bins, ["x"], [], settings=settings * 3, patience=2).collect()) == 4


def test_early_stop_lays_the_order_out_once(spark, monkeypatch):
    from tabweave.functions import ordered
    written = []
    monkeypatch.setattr(ordered, "freeze", lambda df: written.append(1) or df.checkpoint())
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(0 if i % 3 else i % 7, i, float(v)) for i, v in enumerate(rng.random(600))], "s int, t int, score double")
    for patience, percent in ((10, 0.0), (1, 5.0)):
        small = search.early_stop(df, "score", ["t"], ["s"], patience, percent).collect()
        written.clear()
        large = search.early_stop(df, "score", ["t"], ["s"], patience, percent, one_task_rows=0).collect()
        assert len(written) == 2 and sorted(map(tuple, small)) == sorted(map(tuple, large))
