"""Places of the hash order, counted on arrays."""

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tabweave.functions import cuts
from tabweave.functions.hashing import prefix_array
from tabweave.operators import mixture, sample, search
from tabweave.operators.score import binned


def test_prefixes_of_hashes():
    texts = [hashlib.md5(str(i).encode()).hexdigest() for i in range(50)]
    assert prefix_array(pa.array(texts)).tolist() == [int(t[:8], 16) for t in texts]
    assert prefix_array(pa.array(texts).slice(7, 9)).tolist() == [int(t[:8], 16) for t in texts[7:16]]


def test_runs_count_every_row(spark, monkeypatch):
    monkeypatch.setattr(cuts, "_ROWS", 50)
    rows = [("abc"[i % 3], hashlib.md5(str(i if i % 4 else 0).encode()).hexdigest()) for i in range(900)]
    # the group c has no window, an end of 2**32 is beyond all hashes
    windows = {"b": [(2**30, 2**31)], "a": [(0, 2**28), (2**31, 2**32)]}
    want = Counter()
    for g, h in rows:
        if g in windows:
            slot = sum(edge <= int(h[:8], 16) for window in windows[g] for edge in window)
            want[g, slot, h if slot % 2 else None] += 1
    df = spark.createDataFrame(rows, f"_g string, {sample.HASH} string").repartition(4)
    assert {(r["_g"], r["_slot"], r["_h"]): r["n"] for r in sample._runs(df, windows).collect()} == want


def test_hashed_sources_score_alike(spark):
    rows = [("ab"[i % 2], i, i * 7 % 13, int(i % 13 > 5)) for i in range(600)]
    src = spark.createDataFrame(rows, "source string, id int, x int, y int")
    sizes = mixture.mix_size(search.candidate_table(spark, [[0.5, 0.5], [0.9, 0.1]], ["a", "b"]), mixture.source_counts(src), 200)
    bins = {"x": F.col("x")}
    real = binned(src.withColumn("split", F.lit("val")), "y", bins, ["split"])
    score = lambda s, key: {(r["cand"], r["split"]): r["auc"] for r in search.score_batch(s, real, "y", bins, sizes, key).collect()}
    got = score(src, ["id"])
    assert len(got) == 4 and score(sample.with_hash(src, ["id", "source"], 5).drop("id"), None) == got
