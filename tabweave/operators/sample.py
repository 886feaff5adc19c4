"""Exact-size sampling and splitting by hash order.

A row's place in the random order is its hash. Taking the first n rows then
means finding the n-th smallest hash and filtering on it: one small aggregate
over the hash, and a plain filter over the rows. No row is shuffled or sorted. Rows with the same hash are copies of one another and
interchangeable; a cut that falls inside such a group takes the exact number
of copies by counting them, never by gathering them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.cuts import tables
from tabweave.functions.hashing import key_text, md5_prefixes, prefix_array, row_hash
from tabweave.session import freeze, scratch_path

HASH = "_hash"
# hex digits of a hash prefix: 65,536 prefixes at most
_DIGITS = 4
# copies one task writes when a counted group of copies is spelled out
_BLOCK = 100_000


@dataclass(frozen=True)
class Cut:
    """Where ``position`` falls: ``take`` of the ``copies`` rows at ``hash`` are in."""

    group: object
    position: int
    hash: str
    before: int
    copies: int

    @property
    def take(self) -> int:
        return self.position - self.before

    @property
    def splits_copies(self) -> bool:
        return self.take < self.copies


def with_hash(df: DataFrame, key: Sequence[str] | None, seed: object) -> DataFrame:
    """``key`` names columns that identify a row; by default the whole row does."""
    return df.withColumn(HASH, row_hash(list(key or df.columns), seed))


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _windows(places: Sequence[int], rows: int) -> list[tuple[int, int]]:
    """Where in 32-bit hash space the places must lie, as disjoint ranges.

    Hashes are uniform, so place p of N is within 5 standard deviations of
    p/N but once in a million times. That case, and groups of copies that move
    a place out of its window, are noticed and handled.
    """
    ranges: list[tuple[int, int]] = []
    for p in sorted(places):
        q = p / rows
        slack = 5.0 * math.sqrt(q * (1.0 - q) / rows) + 4.0 / rows
        low, high = max(0, math.floor((q - slack) * 2**32)), min(2**32, math.ceil((q + slack) * 2**32) + 1)
        if ranges and low <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(high, ranges[-1][1]))
        else:
            ranges.append((low, high))
    return ranges


def step(column: Column, bounds: Sequence[str], first: int = 0) -> Column:
    """``first`` plus the number of (sorted) bounds that are <= the column."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(column < F.lit(bounds[half]), step(column, bounds[:half], first)).otherwise(
        step(column, bounds[half + 1:], first + half + 1))


def find_cuts(
    hashed: DataFrame, positions: Mapping[object, Sequence[int]], group: str | None = None,
    sizes: Mapping[object, int] | None = None,
) -> list[Cut]:
    """The hash at each 1-based position of the hash order, within each group.

    ``positions`` maps a group value (``None`` without a group column) to the
    wanted places, ``sizes`` to the rows of the group where they are known.
    One row per place reaches the driver.
    """
    wanted = {_text(g) if group else "": sorted({int(p) for p in places if p > 0}) for g, places in positions.items()}
    wanted = {g: places for g, places in wanted.items() if places}
    if not wanted:
        return []
    names = {_text(g) if group else "": g for g in positions}
    label = F.col(group).cast("string") if group else F.lit("")
    rows = hashed.select(label.alias("_g"), HASH)
    if group:
        rows = rows.where(F.col("_g").isin(*sorted(wanted)))
    if sizes is None:
        counted = {r[0]: r[1] for r in rows.groupBy("_g").count().collect()}
    else:
        counted = {_text(g) if group else "": n for g, n in sizes.items()}

    # One pass: count what lies between the windows, list (by full hash, so
    # copies collapse) what lies inside. About sqrt(N) hashes are listed.
    found = _place(rows, wanted, {g: _windows(places, counted[g]) for g, places in wanted.items()})
    lost = {g: [p for p in places if (g, p) not in found] for g, places in wanted.items()}
    lost = {g: places for g, places in lost.items() if places}
    if lost:
        # copies moved a place out of its window: count by prefix to see where to
        found |= _place(rows, lost, _prefix_windows(rows, lost))
    return [Cut(names[g], p, *found[(g, p)]) for g, places in wanted.items() for p in places]


def _runs(rows: DataFrame, windows: Mapping[str, Sequence[tuple[int, int]]]) -> DataFrame:
    """``(_g, _slot, _h, n)``: rows by group and slot, a slot per window (odd) and per
    stretch between two; the rows of a window by their hash as well.

    Slots are found by binary search on arrays, however many windows and groups there are.
    """
    names = sorted(windows)
    listed = pa.array(names, pa.string())
    edges = [[edge for window in windows[g] for edge in window] for g in names]
    flat = np.array([(k << 33) + edge for k, ends in enumerate(edges) for edge in ends], np.int64)
    first = np.cumsum([0, *[len(ends) + 1 for ends in edges]])  # slots before each group
    columns = ["_g", "_slot", "_h", "n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            table = table.filter(pc.is_in(table.column(0), value_set=listed))
            if not table.num_rows:
                continue
            group, hashed = (table.column(i).combine_chunks() for i in range(2))
            at = pc.index_in(group, value_set=listed).to_numpy(zero_copy_only=False).astype(np.int64)
            number = np.searchsorted(flat, (at << 33) + prefix_array(hashed), "right") + at
            slot = number - first[at]
            inside = slot % 2 == 1
            between, n = np.unique(number[~inside], return_counts=True)
            owner = np.searchsorted(first, between, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [listed.take(pa.array(owner)), pa.array((between - first[owner]).astype(np.int32)), pa.nulls(len(n), pa.string()),
                 pa.array(n.astype(np.int64))], names=columns)
            kept = pa.table([group, pa.array(slot.astype(np.int32)), hashed], names=columns[:3]).filter(pa.array(inside))
            yield from kept.group_by(columns[:3], use_threads=False).aggregate([([], "count_all")]).rename_columns(columns).to_batches()

    found = rows.select("_g", HASH).mapInArrow(work, "_g string, _slot int, _h string, n long")
    return found.groupBy("_g", "_slot", "_h").agg(F.sum("n").alias("n"))


def _place(rows: DataFrame, wanted: Mapping[str, Sequence[int]],
           windows: Mapping[str, Sequence[tuple[int, int]]]) -> dict[tuple[str, int], tuple[str, int, int]]:
    """(group, place) -> (hash, rows before it, rows at it), for places inside the windows."""
    runs = freeze(_runs(rows, windows))
    # running counts window by window; the windows themselves are two per place
    inside = Window.partitionBy("_g", "_slot").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_g").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = runs.groupBy("_g", "_slot").agg(F.sum("n").alias("_t")).select(
        "_g", "_slot", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    runs = runs.withColumn("_in", F.sum("n").over(inside)).join(F.broadcast(slots), ["_g", "_slot"]).withColumn(
        "upto", F.col("_before") + F.col("_in"))
    want = rows.sparkSession.createDataFrame([(g, p) for g, places in wanted.items() for p in places], "_g string, place long")
    hits = runs.join(F.broadcast(want), "_g").where(  # a row per wanted place, listed by the caller
        (F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("n")) & F.col("_h").isNotNull())
    return {(r["_g"], r["place"]): (r["_h"], r["upto"] - r["n"], r["n"]) for r in hits.collect()}


def _prefix_windows(rows: DataFrame, wanted: Mapping[str, Sequence[int]]) -> dict[str, list[tuple[int, int]]]:
    """The hash prefix each place falls in, from a count by prefix."""
    upto = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = rows.groupBy("_g", F.substring(HASH, 1, _DIGITS).alias("_p")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    want = rows.sparkSession.createDataFrame([(g, p) for g, places in wanted.items() for p in places], "_g string, place long")
    hits = prefixes.join(F.broadcast(want), "_g").where(
        (F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("n"))).select("_g", "_p").distinct()
    width = 16 ** (8 - _DIGITS)
    out: dict[str, list[tuple[int, int]]] = {}
    for g, p in sorted((r["_g"], int(r["_p"], 16)) for r in hits.collect()):
        ranges = out.setdefault(g, [])
        if ranges and ranges[-1][1] == p * width:
            ranges[-1] = (ranges[-1][0], (p + 1) * width)
        else:
            ranges.append((p * width, (p + 1) * width))
    return out


def numbered_copies(df: DataFrame, order: str = HASH) -> DataFrame:
    """The same rows with ``_copy`` = 1, 2, ... among rows of equal ``order``.

    Copies are counted (combined map-side), then written out again in blocks
    spread over tasks, so a huge group of copies never sits in one place.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    # rows of one hash that still differ are ordered by their content
    before = Window.partitionBy(order).orderBy(*[c for c in df.columns if c != order] or [order])
    counted = counted.withColumn("_from", F.coalesce(
        F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / _BLOCK))))
    blocks = blocks.repartition(order, "_block")
    start = F.col("_block") * _BLOCK
    return blocks.withColumn("_i", F.explode(F.sequence(
        start + 1, F.least(start + _BLOCK, F.col("_n"))))).select(
            *df.columns, (F.col("_from") + F.col("_i")).alias("_copy"))


def _assign(hashed: DataFrame, names: Sequence[str], cuts: Sequence[Cut], ends: Sequence[int], into: str) -> DataFrame:
    """Name the part of each row; ``ends[i]`` is the last place of part i."""
    at = {c.position: c for c in cuts}
    part = F.lit(names[-1])
    for name, end in reversed(list(zip(names, ends))):
        # an empty part has no cut
        inside = F.col(HASH) <= at[end].hash if end in at else F.lit(False)
        part = F.when(inside, F.lit(name)).otherwise(part)
    torn = {c.hash: c.before for c in cuts if c.splits_copies}
    whole = hashed if not torn else hashed.where(~F.col(HASH).isin(*torn))
    out = whole.withColumn(into, part)
    if torn:
        edge = numbered_copies(hashed.where(F.col(HASH).isin(*torn)))
        place: Column = F.lit(None).cast("long")
        for text, before in torn.items():
            place = F.when(F.col(HASH) == text, F.lit(before) + F.col("_copy")).otherwise(place)
        named = F.lit(names[-1])
        for name, end in reversed(list(zip(names, ends))):
            named = F.when(place <= end, F.lit(name)).otherwise(named)
        out = out.unionByName(edge.withColumn(into, named).drop("_copy"))
    return out


def split_sizes(rows: int, fractions: Sequence[float]) -> list[int]:
    """Sizes of successive two-way splits: each takes ``ceil(f * rest)`` off the
    end of what is left, so the first part is what remains after the first."""
    sizes = []
    rest = rows
    for f in fractions:
        second = math.ceil(f * rest)
        sizes.append(rest - second)
        rest = second
    return [*sizes, rest]


def split_by(df: DataFrame, names: Sequence[str], fractions: Sequence[float], key: Sequence[str] | None = None,
             seed: object = 5, into: str = "split") -> DataFrame:
    """Name each row's part; sizes are exact, parts disjoint and complete."""
    rows = df.count()
    sizes = split_sizes(rows, fractions)
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes) - 1)]
    hashed = with_hash(df, key, seed)
    return _assign(hashed, names, find_cuts(hashed, {None: ends}, sizes={None: rows}), ends, into).drop(HASH)


def split3(df: DataFrame, key: Sequence[str] | None = None, seed: object = 5,
           test_size: float = 0.3, test_of_rest: float = 1 - 0.6666666) -> DataFrame:
    """70% train, 20% val, 10% test."""
    return split_by(df, ["train", "val", "test"], [test_size, test_of_rest], key, seed)


def split2(df: DataFrame, key: Sequence[str] | None = None, seed: object = 5, test_size: float = 0.2) -> DataFrame:
    return split_by(df, ["train", "test"], [test_size], key, seed)


def sample_n(df: DataFrame, n: int, key: Sequence[str] | None = None, seed: object = 5) -> DataFrame:
    """Exactly ``n`` rows without replacement; more than there are is an error."""
    rows = df.count()
    if n > rows or n < 0:
        raise ValueError(f"cannot draw {n} of {rows} rows without replacement")
    if n == 0:
        return df.limit(0)
    hashed = with_hash(df, key, seed)
    marked = _assign(hashed, ["in", "out"], find_cuts(hashed, {None: [n]}, sizes={None: rows}), [n], "_part")
    return marked.where("_part = 'in'").drop(HASH, "_part")


def sample_cap(df: DataFrame, n: int = 50_000, key: Sequence[str] | None = None, seed: object = 5) -> DataFrame:
    """At most ``n`` rows: a no-op on a table that is small enough."""
    return df if df.count() <= n else sample_n(df, n, key, seed)


def sample_condition(df: DataFrame, label: str, sizes: Mapping[object, int],
                     key: Sequence[str] | None = None, seed: object = 5) -> DataFrame:
    """``sizes[v]`` rows of each label value v, without replacement."""
    counts = {r[0]: r[1] for r in df.where(F.col(label).isin(*sizes)).groupBy(label).count().collect()}
    for value, n in sizes.items():
        if n > counts.get(value, 0):
            raise ValueError(f"cannot draw {n} rows with {label}={value}: there are {counts.get(value, 0)}")
    hashed = with_hash(df, key, seed)
    cuts = find_cuts(hashed, {v: [n] for v, n in sizes.items()}, label, counts)
    torn = [c for c in cuts if c.splits_copies]
    keep = F.lit(False)
    for c in cuts:
        edge = F.col(HASH) < c.hash if c.splits_copies else F.col(HASH) <= c.hash
        keep = keep | ((F.col(label) == F.lit(c.group)) & edge)
    out = hashed.where(keep)
    for c in torn:
        copies = numbered_copies(hashed.where((F.col(label) == F.lit(c.group)) & (F.col(HASH) == c.hash)))
        out = out.unionByName(copies.where(F.col("_copy") <= c.take).drop("_copy"))
    return out.drop(HASH)


def class_sizes(n: int, share: float) -> dict[int, int]:
    """Class counts that always add up to ``n`` (half-to-even rounding)."""
    ones = round(n * share)
    return {1: ones, 0: n - ones}


def undersample(df: DataFrame, label: str, ratio: float = 0.5, key: Sequence[str] | None = None,
                seed: object = 5) -> DataFrame:
    """Drop majority rows until minority/majority = ``ratio``."""
    few, many = minority(df, label)
    keep = int(few[1] / ratio)
    if keep > many[1]:
        raise ValueError(f"ratio {ratio} asks for {keep} majority rows, there are {many[1]}")
    rest = df.where(F.col(label) != F.lit(many[0]))
    return rest.unionByName(sample_n(df.where(F.col(label) == F.lit(many[0])), keep, key, seed))


def minority(df: DataFrame, label: str) -> tuple[tuple[object, int], tuple[object, int]]:
    """((value, rows) of the smaller class, the same of the larger one)."""
    counts = sorted(((r[0], r[1]) for r in df.groupBy(label).count().limit(3).collect()),
                    key=lambda c: (c[1], -int(c[0])))
    if len(counts) != 2:
        raise ValueError(f"{label} must have exactly two values")
    return counts[0], counts[1]


def global_rank(df: DataFrame, key: Sequence[str] | None = None, seed: object = 5, into: str = "rank") -> DataFrame:
    """The 1-based place of every row in the hash order.

    Hash prefixes spread the rows evenly, each prefix is ranked on its own,
    and the (at most 65,536) prefix counts are accumulated separately. With no
    key, copies are counted first, so equal rows do not pile up in a prefix.
    """
    hashed = with_hash(df, key, seed)
    if key is None:
        hashed = hashed.groupBy(*hashed.columns).agg(F.count(F.lit(1)).alias("_n"))
    else:
        hashed = hashed.withColumn("_n", F.lit(1).cast("long"))
    pre = hashed.withColumn("_p", F.substring(HASH, 1, _DIGITS))
    totals = pre.groupBy("_p").agg(F.sum("_n").alias("_t")).withColumn("_before", F.coalesce(
        F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_p").orderBy(HASH, *(key or [])).rowsBetween(Window.unboundedPreceding, 0)
    placed = pre.withColumn("_upto", F.sum("_n").over(inside)).join(
        F.broadcast(totals.select("_p", "_before")), "_p")
    placed = placed.withColumn("_last", F.col("_before") + F.col("_upto"))
    if key is not None:
        return placed.select(*df.columns, F.col("_last").alias(into))
    blocks = placed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / _BLOCK))))
    blocks = blocks.repartition(HASH, "_block")
    start = F.col("_block") * _BLOCK
    spelled = blocks.withColumn("_i", F.explode(F.sequence(start + 1, F.least(start + _BLOCK, F.col("_n")))))
    return spelled.select(*df.columns, (F.col("_last") - F.col("_n") + F.col("_i")).alias(into))


# hashes of a batch held at a time
_MARKED = 1 << 22


def replicate(df: DataFrame, n: int, times: int = 50, key: Sequence[str] | None = None, seed: object = 5) -> DataFrame:
    """``times`` independent draws of ``n`` rows, with a ``replicate`` column.

    A row has a hash per draw, all of which share the stretch where the cut
    must lie. One pass takes all hashes and writes, beside each row, the draws
    that it is in for certain and those where its hash lies in the stretch; only
    the latter, about sqrt(N) a draw, are hashed in full to find the cuts.
    """
    rows = df.count()
    if n > rows:
        raise ValueError(f"cannot draw {n} of {rows} rows without replacement")
    key, every = list(key or df.columns), range(1, times + 1)
    if n == 0 or times == 0:
        return df.limit(0).withColumn("replicate", F.lit(0))
    spark = df.sparkSession
    path = scratch_path(spark, "draws")
    (low, high), = _windows([n], rows)
    marked = df.withColumn("_marks", _marker(times, seed, low, high)(key_text(key)))
    marked.write.parquet(path)
    marks = spark.read.schema(marked.schema).parquet(path).select(*df.columns, F.explode("_marks").alias("_m"))
    sure = marks.where("_m > 0").select(*df.columns, F.col("_m").alias("replicate"))
    near = marks.where("_m < 0").select(*df.columns, (-F.col("_m")).alias("replicate"))
    near = near.withColumn(HASH, row_hash([*key, "replicate"], seed))

    before = dict(sure.groupBy("replicate").count().collect())
    first = spark.createDataFrame([(r, before.get(r, 0)) for r in every], "replicate int, _before long")
    inside = Window.partitionBy("replicate").orderBy(HASH).rowsBetween(Window.unboundedPreceding, 0)
    upto = near.groupBy("replicate", HASH).agg(F.count(F.lit(1)).alias("n")).withColumn("_in", F.sum("n").over(inside)).join(
        F.broadcast(first), "replicate").withColumn("_upto", F.col("_before") + F.col("_in"))  # a row per replicate
    hits = upto.where((F.col("_upto") >= n) & (F.col("_upto") - F.col("n") < n)).collect()
    cuts = [Cut(r["replicate"], n, r[HASH], r["_upto"] - r["n"], r["n"]) for r in hits]
    if len(cuts) == times:
        return sure.unionByName(_up_to(near, cuts, df.columns))
    # copies moved a place out of its stretch: all places are counted
    many = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(times))))
    hashed = many.withColumn(HASH, row_hash([*key, "replicate"], seed))
    return _up_to(hashed, find_cuts(hashed, {r: [n] for r in every}, "replicate", {r: rows for r in every}), df.columns)


def _marker(times: int, seed: object, low: int, high: int) -> Callable[[Column], Column]:
    """The replicates whose hash of a key text and their number lies below ``low``,
    and those below ``high``, as negative numbers."""
    endings = [f"-{r}-{seed}" for r in range(1, times + 1)]

    def mark(texts: pa.Array) -> pa.Array:
        values, counts = [], [np.zeros(1, np.int32)]
        step = max(1, _MARKED // times)
        for i in range(0, len(texts), step):
            made = md5_prefixes(texts.slice(i, step), endings)
            row, draw = np.nonzero(made < high) if high < 2**32 else np.nonzero(made >= 0)
            values.append(np.where(made[row, draw] < low, draw + 1, -draw - 1).astype(np.int32))
            counts.append(np.bincount(row, minlength=len(made)).astype(np.int32))
        ends = np.cumsum(np.concatenate(counts), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))

    return F.arrow_udf(mark, "array<int>")


def _up_to(hashed: DataFrame, cuts: Sequence[Cut], columns: Sequence[str]) -> DataFrame:
    """The rows up to the cut of their replicate."""
    spark = hashed.sparkSession
    limits = F.broadcast(spark.createDataFrame(  # one row per replicate
        [(c.group, c.hash, c.take, c.copies) for c in cuts], "replicate int, _cut string, _take long, _copies long"))
    joined = hashed.join(limits, "replicate")
    torn = [c for c in cuts if c.splits_copies]
    whole = joined.where((F.col(HASH) < F.col("_cut")) | ((F.col(HASH) == F.col("_cut")) & (F.col("_take") == F.col("_copies"))))
    out = whole.select(*columns, "replicate")
    if torn:
        edge = joined.where((F.col(HASH) == F.col("_cut")) & (F.col("_take") < F.col("_copies")))
        out = out.unionByName(numbered_copies(edge).where(F.col("_copy") <= F.col("_take")).select(*columns, "replicate"))
    return out
