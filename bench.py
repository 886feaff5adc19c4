"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query
is run to its last row (a ``noop`` write), so nothing is pruned away; jobs that
an operator runs while it builds its result count as well. One small query
warms the session up first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabweave.plans import QUERIES  # noqa: E402
from tabweave.session import build_session  # noqa: E402

HEADLINE = [
    "clean_dropna",     # prepare
    "split3",
    "robust_scale",
    "te_fit",           # encode
    "te_apply",
    "te_decode",
    "gen_copula",       # generate
    "smote",
    "auc",              # score
    "score_trainval",
    "real_baseline",
    "mix_draw",         # mix
    "mix_score",
    "mix_search",
    "hp_search",
    "agg_mean_std",     # collect
    "argmax_group",
    "ttest_greater",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("tabweave-bench", f"local[{cpus}]")
    QUERIES["agg_count_mean"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
