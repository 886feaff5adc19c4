"""Running values over a total order, without putting the order in one task.

A window with no partition key sorts everything in a single task. Here the
table is frozen and counted: a proven-small one takes the plain window, a
large one is range-partitioned, each range is reduced to one number, the few
range numbers are accumulated, and every range finishes on its own. The two
ways give the same rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.session import freeze, has_at_most

# Largest table that one window task may sort.
ONE_TASK_ROWS = 1_000_000

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, str]],
    *,
    include_current: bool = True,
    descending: bool = False,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add running aggregates within ``by`` along ``order``.

    ``outputs`` maps a new column to ``(function, value column)`` with function
    ``sum``, ``max`` or ``min``. ``order`` must be unique within ``by``.
    """
    laid = layout(df, by, order, descending=descending, one_task_rows=one_task_rows)
    return carry(laid, by, order, outputs, include_current=include_current, descending=descending).select(*df.columns, *outputs)


RANGE = "_range"


def layout(df: DataFrame, by: Sequence[str], order: Sequence[str], *, descending: bool = False,
           one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``df`` as ``carry`` wants it: frozen, and past ``one_task_rows`` rows cut
    into ranges of the order, with a ``_range`` column. Any number of running
    values can be taken from one layout."""
    frozen = freeze(df)
    if has_at_most(frozen, one_task_rows):
        return frozen
    # The range number is only meaningful for this one physical layout, so it
    # is frozen together with the rows before anything reads it twice. Groups
    # that share an order value are told apart by ``by``, so a value that a
    # third of all rows have (the first trial of everybody) is split as well.
    return freeze(frozen.repartitionByRange(*_keys(order, descending), *by).withColumn(RANGE, F.spark_partition_id()))


def _keys(order: Sequence[str], descending: bool) -> list:
    return [F.desc(c) if descending else F.asc(c) for c in order]


def carry(laid: DataFrame, by: Sequence[str], order: Sequence[str], outputs: dict[str, tuple[str, str]], *,
          include_current: bool = True, descending: bool = False, backward: bool = False) -> DataFrame:
    """Add running aggregates to a table from ``layout`` (or to what was added
    to one); nothing is written. ``backward`` runs against the order of the layout."""
    last = 0 if include_current else -1
    keys = _keys(order, descending != backward)
    if RANGE not in laid.columns:
        window = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, last)
        for name, (kind, value) in outputs.items():
            out = _COMBINE[kind][0](value).over(window)
            laid = laid.withColumn(name, F.coalesce(out, F.lit(0)) if kind == "sum" else out)
        return laid

    totals = laid.groupBy(*by, RANGE).agg(
        *[_COMBINE[kind][0](value).alias(f"_total_{name}") for name, (kind, value) in outputs.items()]
    )
    # at most one row per range and group
    earlier = Window.partitionBy(*by).orderBy(F.desc(RANGE) if backward else F.asc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by, RANGE,
        *[_COMBINE[kind][0](f"_total_{name}").over(earlier).alias(f"_before_{name}")
          for name, (kind, _) in outputs.items()],
    )
    inside = Window.partitionBy(*by, RANGE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, last)
    columns = laid.columns
    for name, (kind, value) in outputs.items():
        laid = laid.withColumn(f"_in_{name}", _COMBINE[kind][0](value).over(inside))
    joined = laid.join(totals, [*by, RANGE])
    for name, (kind, _) in outputs.items():
        joined = joined.withColumn(name, _COMBINE[kind][1](F.col(f"_before_{name}"), F.col(f"_in_{name}")))
    return joined.select(*columns, *outputs)


def long_values(df: DataFrame, columns: Sequence[str], cast: str = "double") -> DataFrame:
    """Unpivot ``columns`` into ``(column, value)`` rows, one scan for all."""
    return df.select(*[F.col(c).cast(cast).alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], knots: int = 256,
                    accuracy: int = 10_000) -> DataFrame:
    """Linear-interpolated quantiles, one row per column with an array ``q``;
    null, NaN and infinite values count as missing.

    The order statistics are found by narrowing: a sketch proposes knots, the rows
    at and between knots are counted, and only the gaps that hold a wanted
    place are sketched and counted again. The counts decide, so the sketch may
    err; each pass combines on the map side and sends a number per knot. No
    value is shuffled, whatever the distribution. ``df`` is read about six times.
    """
    spark, names = df.sparkSession, list(columns)
    number = lambda c: F.col(c).cast("double")
    rows = df.select(*[F.when(F.abs(number(c)) < float("inf"), number(c)).alias(f"_v{i}") for i, c in enumerate(names)])
    levels = F.lit([k / knots for k in range(knots + 1)])
    sketch = lambda v: F.percentile_approx(v, levels, F.lit(accuracy))
    first = rows.agg(*[f(f"_v{i}") for i in range(len(names)) for f in (F.count, sketch)]).first()
    totals = [first[2 * i] for i in range(len(names))]
    places = [[(n - 1) * float(p) for p in probs] if n else [] for n in totals]
    found: list[dict[int, float]] = [{} for _ in names]
    # per column the gaps (low, high, rows up to low, wanted places in between)
    inf = float("inf")
    gaps = {i: [(-inf, inf, 0, sorted({f(x) for x in at for f in (math.floor, math.ceil)}))] for i, at in enumerate(places) if at}
    marks = {i: sorted(set(first[2 * i + 1])) for i in gaps}
    while gaps:
        coded = _coded(rows, marks, gaps)
        counts = {(r["at"], r["code"]): r["n"] for r in coded.groupBy("at", "code").agg(F.count(F.lit(1)).alias("n")).collect()}
        for i in list(gaps):
            gaps[i] = [g for gap in gaps[i] for g in _narrow(gap, marks[i], lambda code: counts.get((i, code), 0), found[i])]
            if gaps[i]:
                marks[i] = sorted({m for low, high, _, _ in gaps[i] for m in (low, high)} - {-inf, inf})
            else:
                del gaps[i], marks[i]
        if gaps:
            inside = _coded(rows, marks, gaps).groupBy("at", "code").agg(
                F.count(F.lit(1)).alias("n"), sketch("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
            more: dict[int, set[float]] = {i: set() for i in gaps}
            at_code = {(i, _code(marks[i], g[0])): g for i in gaps for g in gaps[i]}
            for r in inside:
                # the ends of what a gap holds and the knots next to the wanted places
                _, _, run, wanted = at_code[r["at"], r["code"]]
                near = [int((p - run) * knots / r["n"]) + d for p in wanted for d in (-1, 0, 1, 2)]
                more[r["at"]] |= {r["lo"], r["hi"], *[r["s"][k] for k in near if 0 <= k <= knots]}
            marks = {i: sorted({*marks[i], *more[i]}) for i in gaps}
    out = []
    for c, n, at, have in zip(names, totals, places, found):
        if n:
            ends = [(have[math.floor(x)], have[math.ceil(x)], x - math.floor(x)) for x in at]
            out.append((c, n, [lo + share * (hi - lo) for lo, hi, share in ends]))
    return spark.createDataFrame(out, "column string, rows long, q array<double>")


def _coded(rows: DataFrame, marks: dict[int, list[float]], gaps: dict[int, list]) -> DataFrame:
    """``(at, code, value)`` of the values inside the gaps: code ``2k + 1`` at the
    k-th mark of column ``at``, ``2k`` between the marks k - 1 and k."""
    # without marks yet all values are in one gap
    splits = [[float("-inf"), *(marks[i] or [0.0]), float("inf")] for i in marks]
    search = Bucketizer(splitsArray=splits, inputCols=[f"_v{i}" for i in marks], outputCols=[f"_b{i}" for i in marks], handleInvalid="keep")
    items = []
    for i, listed in zip(marks, splits):
        slot, value = F.col(f"_b{i}").cast("int"), F.col(f"_v{i}")
        # 2 * slot, less one where the value is the mark below
        below = F.get(F.array(*[F.lit(x) for x in listed[1:-1]]), slot - 1)
        code = 2 * slot - F.coalesce(below == value, F.lit(False)).cast("int")
        inside = [any(low <= a and b <= high for low, high, _, _ in gaps[i]) for a, b in zip(listed, listed[1:])]
        ends = [low for low, _, _, _ in gaps[i]]
        wanted = F.get(F.array(*[F.lit(x) for x in inside]), slot) & ~F.coalesce(
            (below == value) & F.get(F.array(*[F.lit(x in ends) for x in listed[1:-1]]), slot - 1), F.lit(False))
        items.append(F.when(value.isNotNull() & wanted, F.struct(F.lit(i).alias("at"), code.alias("code"), value.alias("value"))))
    return search.transform(rows).select(F.explode(F.array_compact(F.array(*items))).alias("x")).select("x.*")


def _code(marks: list[float], low: float) -> int:
    """The code of the values between the mark ``low`` and the next one."""
    return 2 * bisect_right(marks, low)


def _narrow(gap: tuple, marks: list[float], count: Callable[[int], int], found: dict[int, float]) -> list[tuple]:
    """Settle the places of a gap that lie at a mark; the smaller gaps of the others."""
    low, high, run, places = gap
    start = marks.index(low) + 1 if low in marks else 0
    end = marks.index(high) if high in marks else len(marks)
    out = []
    for k in range(start, end + 1):
        n = count(2 * k)
        inside = [p for p in places if run <= p < run + n]
        if inside:
            out.append((marks[k - 1] if k > start else low, marks[k] if k < end else high, run, inside))
        run += n
        if k < end:
            n = count(2 * k + 1)
            found.update({p: marks[k] for p in places if run <= p < run + n})
            run += n
    return out
