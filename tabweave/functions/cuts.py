"""Bins of numeric columns: where they begin, and rows counted by them.

Both work on Arrow batches and combine in the task, so what is sent is a number
per bucket or per combination of bins, not per row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Buckets of the first pass share sign, exponent and ten bits of the mantissa.
_SHIFT = 42
# Parts of a bucket that is looked at again.
_PARTS = 1024
# A bucket of several values is looked at again where it holds more than one in so many of a bin's share.
_FINER = 2
# Rows of a task worked on together.
_ROWS = 1 << 18
# Bin numbers of several columns share a whole number up to here.
_WORD = 1 << 62

Bucket = tuple[float, float, int]


def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``_ROWS`` rows."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= _ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    """The values, NaN for null; -0.0 is 0.0."""
    return column.to_numpy().astype(np.float64, copy=False) + 0.0


def _places(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _buckets(values: np.ndarray, opened: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Bucket, number, smallest and largest of its values, of sorted values.

    ``opened`` has the first and the last place of each range to look at; without
    it all values are bucketed by their leading bits.
    """
    place = _places(values)
    if opened is None:
        code = place >> _SHIFT
    else:
        starts, ends = opened
        at = np.searchsorted(starts, place, "right") - 1
        inside = (at >= 0) & (place <= ends[at])
        at, place, values = at[inside], place[inside], values[inside]
        code = at * _PARTS + (place - starts[at]) // ((ends - starts)[at] // _PARTS + 1)
    first = np.flatnonzero(np.diff(code, prepend=code[:1] - 1))
    past = np.append(first[1:], len(code))[:len(first)]
    return code[first], past - first, values[first], values[past - 1]


def _opened(buckets: Sequence[Bucket], most: int) -> np.ndarray | None:
    """The ranges of several values that are too much for one bucket; all of
    them while there are no more buckets than bins."""
    least = sum(n for _, _, n in buckets) / (_FINER * most) if len(buckets) > most else 0
    ranges = [(low, high) for low, high, n in buckets if low < high and n > least]
    return _places(np.array(ranges)).T.copy() if ranges else None


def _cuts(buckets: Sequence[Bucket], most: int) -> list[float]:
    """Where bins begin: at every bucket, or nearest to the places that share the rows out evenly."""
    if len(buckets) <= most:
        return [low for low, _, _ in buckets[1:]]
    upto = np.cumsum([n for _, _, n in buckets])
    edges = upto[:-1]  # rows below the second bucket and those after it
    wanted = upto[-1] * np.arange(1, most) / most
    above = np.clip(np.searchsorted(edges, wanted), 1, len(edges) - 1)
    nearest = np.where(wanted - edges[above - 1] <= edges[above] - wanted, above - 1, above)
    return [buckets[k + 1][0] for k in np.unique(nearest)]


def _split(df: DataFrame, columns: Sequence[str], opener: Callable[[int, list[Bucket]], np.ndarray | None]) -> list[list[Bucket]]:
    """The values of each column in buckets ``(smallest, largest, number)``, in order.

    The first pass takes buckets of the leading bits. ``opener`` names the buckets
    of a column that are split further, by a pass of their own that reads the
    columns concerned. Null and NaN are in no bucket.
    """
    buckets: list[list[Bucket]] = [[] for _ in columns]
    opened: dict[int, np.ndarray | None] = dict.fromkeys(range(len(columns)))
    schema = "at int, code long, n long, low double, high double"
    while opened:
        looked = dict(opened)

        def work(batches: Iterable[pa.RecordBatch], looked: dict = looked) -> Iterator[pa.RecordBatch]:
            for table in tables(batches):
                for k, (at, ranges) in enumerate(looked.items()):
                    values = _floats(table.column(k))
                    found = _buckets(np.sort(values[~np.isnan(values)]), ranges)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found[0]), at, np.int32)), *map(pa.array, found)], names=["at", "code", "n", "low", "high"])

        counted = df.select(*[F.col(f"`{columns[i]}`").cast("double").alias(f"_v{i}") for i in opened]).mapInArrow(work, schema)
        for i, ranges in opened.items():  # what is split goes
            gone = set() if ranges is None else set(ranges[0].tolist())
            buckets[i] = [b for b in buckets[i] if int(_places(np.array([b[0]]))[0]) not in gone]
        for r in counted.groupBy("at", "code").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
            buckets[r["at"]].append((r["low"], r["high"], r["n"]))
        for i in opened:
            buckets[i].sort()
        opened = {i: ranges for i in opened if (ranges := opener(i, buckets[i])) is not None}
    return buckets


def value_cuts(df: DataFrame, columns: Sequence[str], most: int) -> dict[str, list[float]]:
    """Where the second and further bins of each column begin, at most ``most``
    bins; null and NaN have no say.

    Every value has a bin where there are no more than ``most``, else bins hold about as
    many rows each. All rows are counted by buckets of their leading bits; what
    holds several values and too many rows is split further, so clustered and
    skewed values get bins as well. Counts decide, so neither cores nor the
    layout of the input change a cut. After the first pass a column sends at
    most ``_FINER * most * _PARTS`` buckets to the driver.
    """
    found = _split(df, list(columns), lambda i, buckets: _opened(buckets, most))
    return {c: _cuts(buckets, most) for c, buckets in zip(columns, found)}


def bucket_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """``exact_quantiles`` of the columns that have a finite value, by buckets: for
    many places at once. Only buckets that hold a wanted place are split."""
    finite = df.select(*[F.when(F.abs(F.col(f"`{c}`").cast("double")) < float("inf"), F.col(f"`{c}`").cast("double")).alias(c) for c in columns])
    settled: dict[int, dict[int, float]] = {}

    def settle(i: int, buckets: list[Bucket]) -> np.ndarray | None:
        upto = np.cumsum([0, *[n for _, _, n in buckets]])
        at = [(int(upto[-1]) - 1) * float(p) for p in probs] if buckets else []
        ranges = []
        settled[i] = {}
        for place in sorted({f(x) for x in at for f in (math.floor, math.ceil)}):
            k = int(np.searchsorted(upto, place, "right")) - 1
            low, high, n = buckets[k]
            if low == high or place == upto[k]:
                settled[i][place] = low
            elif place == upto[k] + n - 1:
                settled[i][place] = high
            else:
                ranges.append((low, high))
        return _places(np.array(sorted(set(ranges)))).T.copy() if ranges else None

    out = {}
    for i, (c, buckets) in enumerate(zip(columns, _split(finite, list(columns), settle))):
        total = sum(n for _, _, n in buckets)
        at = [(total - 1) * float(p) for p in probs] if total else []
        ends = [(settled[i][math.floor(x)], settled[i][math.ceil(x)], x - math.floor(x)) for x in at]
        if ends:
            out[c] = [low + share * (high - low) for low, high, share in ends]
    return out


def bin_counts(df: DataFrame, cuts: Mapping[str, Sequence[float]], keep: Sequence[str] = ()) -> DataFrame:
    """Rows by ``keep`` and bins: ``keep``, a bin number ``_b0``, ``_b1``, ... per
    column of ``cuts``, and ``_n`` rows. Null and NaN have the bin after the last."""
    sizes = [len(c) + 2 for c in cuts.values()]
    words: list[list[int]] = []  # columns that share a whole number
    room = 0
    for i, size in enumerate(sizes):
        if not words or room * size > _WORD:
            words.append([])
            room = 1
        words[-1].append(i)
        room *= size
    names = [f"_w{k}" for k in range(len(words))]
    edges = [np.array(c, np.float64) for c in cuts.values()]
    fields = [df.schema[c] for c in keep]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            coded = []
            for members in words:
                word = np.zeros(table.num_rows, np.int64)
                for i in members:
                    values = _floats(table.column(len(keep) + i))
                    number = np.searchsorted(edges[i], values, "right")
                    number[np.isnan(values)] = len(edges[i]) + 1
                    word = word * sizes[i] + number
                coded.append(word)
            rows = pa.table([*table.columns[:len(keep)], *coded], names=[*keep, *names])
            if any(pa.types.is_nested(f.type) for f in rows.schema):  # Arrow has no groups of these
                rows = rows.append_column("_n", pa.array(np.ones(len(rows), np.int64)))
            else:
                rows = rows.group_by(rows.column_names, use_threads=False).aggregate([([], "count_all")])
            yield from rows.rename_columns([*keep, *names, "_n"]).to_batches()

    longs = [StructField(n, LongType()) for n in (*names, "_n")]
    coded = df.select(*keep, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cuts)]).mapInArrow(work, StructType([*fields, *longs]))
    counted = coded.groupBy(*keep, *names).agg(F.sum("_n").alias("_n"))
    numbers = {}
    for name, members in zip(names, words):
        below = 1  # the sizes of the columns after this one
        for i in reversed(members):
            numbers[i] = F.expr(f"CAST({name} DIV {below}L % {sizes[i]}L AS int) AS _b{i}")
            below *= sizes[i]
    return counted.select(*keep, *[numbers[i] for i in range(len(sizes))], "_n")
