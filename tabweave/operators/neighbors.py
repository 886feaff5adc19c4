"""k nearest neighbours of every row, exact unless the caller asks otherwise.

A share of the rows become pivots, as many as keep a cell near ``BLOCK_ROWS``
rows, within ``PIVOT_BYTES``; they stand in two levels, so a row is placed by
about twice the square root of their number of distances. A cell larger than a
block is cut into blocks by hash, so no task holds a whole cell.

Every row is first compared with its own block. The distance of its worst
neighbour so far is its reach: by the triangle inequality, and by the planes
halfway between pivots, only cells within the reach can hold a nearer row, and
the row is sent to those alone. An outlier
therefore looks far for itself, and nobody else does for its sake. Each block
passes on only what lies within the reach. Equal vectors are compared once and
expanded afterwards.

In many dimensions the bounds rule out little, and exact search approaches all
pairs of blocks. Where some rows show that each would be sent to more than
``DENSE`` of all, large blocks are compared instead, every pair of blocks once
for both sides: a matrix product in single precision, with a bound on its
error, tells which pairs may be near enough, and only their distances are
computed. ``probes`` sends a row to that many of the nearest cells at most;
``recall`` measures what this finds against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.hashing import row_hash, uniform
from tabweave.session import freeze, small_side

# rows of one side that a task compares at a time
BLOCK_ROWS = 2048
# pivots travel to every task, so their size is bounded; past it cells grow and are cut into more blocks
PIVOT_BYTES = 16 << 20
# entries of a distance matrix that a task holds at a time
MATRIX = 1 << 20
# share of all rows, in blocks, from which comparing everything in large blocks costs less than sending rows to cells
DENSE = 0.03
# rows that tell this share
PLAN_ROWS = 1000
# vectors of a large block
GRID_BYTES = 16 << 20
# rows and columns of a matrix product
TILE = (128, 2048)
# slack for rounding in the pruning bounds (never in the distances themselves)
_SLACK = 1e-9


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, feature by feature in a fixed order, so a
    pair has the same distance in whichever block it is computed."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j][:, None] - b[:, j][None, :]
        out += gap * gap
    return out


def _rows(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64").reshape(len(column), -1)


def _vector(features: Sequence[str] | str) -> Column:
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


@dataclass
class Pivots:
    """Pivots in groups around a square root of their number."""

    tops: np.ndarray    # group, feature
    points: np.ndarray  # cell, feature; cells of a group stand together
    first: np.ndarray   # first cell of each group, and the number of cells

    @staticmethod
    def of(points: np.ndarray) -> Pivots:
        tops = points[:math.isqrt(len(points) - 1) + 1]
        step = max(1, MATRIX // len(tops))
        group = np.concatenate([squared_distances(points[i:i + step], tops).argmin(axis=1)
                                for i in range(0, len(points), step)])
        order = np.argsort(group, kind="stable")
        return Pivots(tops, points[order], np.searchsorted(group[order], np.arange(len(tops) + 1)))

    def cells(self, group: int) -> slice:
        return slice(self.first[group], self.first[group + 1])

    def place(self, v: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, distance to its pivot, and the distance within which ``want`` pivots of the group lie."""
        group = squared_distances(v, self.tops).argmin(axis=1)
        cell, near, bound = np.zeros(len(v), int), np.zeros(len(v)), np.full(len(v), np.inf)
        for g in np.unique(group):
            row = np.flatnonzero(group == g)
            d = np.sqrt(squared_distances(v[row], self.points[self.cells(g)]))
            place = d.argmin(axis=1)
            cell[row], near[row] = self.first[g] + place, d[np.arange(len(row)), place]
            if d.shape[1] >= want:
                bound[row] = np.partition(d, want - 1, axis=1)[:, want - 1]
        return cell, near, bound


def knn(
    df: DataFrame,
    key: str,
    features: Sequence[str] | str,
    k: int = 5,
    *,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int | None = None,
    probes: int | None = None,
    dense: float = DENSE,
    seed: object = 5,
) -> DataFrame:
    """``(key, neighbours)``: the k nearest other rows as an array of
    ``(distance2, neighbour)`` structs, by distance then key.

    ``features`` is a list of numeric columns or one array column; ``key`` is
    a unique integer column. A row with a null, NaN or infinite coordinate is
    nobody's neighbour and has none. ``probes`` bounds the cells that a row is
    sent to beyond its own block; without it the result is exact. ``dense`` is
    the share of all rows from which large blocks are compared.
    """
    every = freeze(df.select(F.col(key).cast("long").alias("_key"), _vector(features).alias("_v")))
    points = every.where(F.forall("_v", lambda x: F.abs(x) < F.lit(math.inf)))

    # Equal vectors: one representative, and the k+1 smallest keys of each.
    # The rank filter is applied on the map side too (WindowGroupLimit).
    want = k + 1
    order = Window.partitionBy("_v").orderBy("_key")
    members = points.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= want).groupBy("_v").agg(
        F.array_sort(F.collect_list("_key")).alias("_keys"))
    distinct = freeze(members.withColumn("_id", F.element_at("_keys", 1)))
    near = _knn_distinct(distinct.select("_id", "_v"), want, block_rows, max_pivots, probes, dense, seed)

    # Per distinct vector: its k+1 best concrete neighbours. A vector has at
    # most k+1 near vectors with k+1 keys each, so the arrays stay bounded.
    keys = distinct.select(F.col("_id").alias("_near"), "_keys")
    candidates = near.join(keys, "_near").groupBy("_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(
        F.transform("_keys", lambda n: F.struct(F.col("_d").alias("distance2"), n.alias("neighbour")))
    ))), 1, want).alias("_best"))
    by_vector = distinct.select("_id", "_v").join(candidates, "_id").select("_v", "_best")
    # a heavily repeated vector makes a hot key here; AQE splits its partition
    others = F.slice(F.filter("_best", lambda n: n["neighbour"] != F.col("_key")), 1, k)
    none = F.array().cast("array<struct<distance2:double,neighbour:bigint>>")
    return every.join(by_vector, "_v", "left").select(
        F.col("_key").alias(key), F.coalesce(others, none).alias("neighbours"))


def _knn_distinct(rows: DataFrame, want: int, block_rows: int, max_pivots: int | None, probes: int | None,
                  dense: float, seed: object) -> DataFrame:
    """``(_id, _near, _d)``: the ``want`` nearest rows, itself included."""
    u = uniform(row_hash(["_id"], seed))
    total, lowest, width = rows.agg(F.count(F.lit(1)), F.min(u), F.max(F.size("_v"))).first()
    if not total:
        return rows.select("_id", F.col("_id").alias("_near"), F.lit(0.0).alias("_d"))
    most = max_pivots or max(1, PIVOT_BYTES // (8 * max(width, 1)))
    share = min(most, -(-total // block_rows)) / total
    # about ``most`` rows at the most, the one with the smallest hash at the least
    picked = rows.where(u <= F.lit(max(share, lowest))).select(u.alias("u"), "_id", "_v").collect()
    picked = np.array([r["_v"] for r in sorted(picked, key=lambda r: (r["u"], r["_id"]))], dtype="float64")
    pivots = Pivots.of(picked.reshape(len(picked), -1))

    settled, cells = _own_blocks(rows, pivots, want, block_rows)
    own = _spelled(settled)
    if total <= block_rows and len(pivots.points) == 1:
        return own
    if not probes and _share_sent(settled, cells, pivots, want, total) > dense:
        found = _all_pairs(settled, want, total, width, block_rows)
    else:
        found = own.unionByName(_beyond(settled, _sent(settled, cells, pivots, want, probes), cells, want, block_rows))
    best = Window.partitionBy("_id").orderBy("_d", "_near")
    return found.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= want).drop("_rn")


def _spelled(settled: DataFrame) -> DataFrame:
    return settled.select("_id", F.explode(F.arrays_zip("_near", "_d")).alias("n")).select("_id", "n.*")


def _own_blocks(rows: DataFrame, pivots: Pivots, want: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their nearest in their own block and their reach; and a row per cell."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, near, bound = pivots.place(_rows(batch["_v"]), want)
                yield batch.assign(_cell=cell.astype("int32"), _dp=near, _bound=bound)

    placed = freeze(rows.mapInPandas(place, "_id long, _v array<double>, _cell int, _dp double, _bound double"))
    cells = freeze(placed.groupBy("_cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_blocks"),
        F.min("_dp").alias("_low"), F.max("_dp").alias("_high")))
    block = F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")
    blocked = placed.join(small_side(cells.select("_cell", "_blocks")), "_cell").select(
        "_id", "_v", "_cell", "_bound", block.alias("_block"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id", kind="stable")
        v, ids = _rows(rows["_v"]), rows["_id"].to_numpy()
        near, gaps, reach = [], [], rows["_bound"].to_numpy().copy()
        step = max(1, MATRIX // len(v))
        for i in range(0, len(v), step):
            d = squared_distances(v[i:i + step], v)
            best = np.argsort(d, axis=1, kind="stable")[:, :want]  # ties go to the smaller id
            d = np.take_along_axis(d, best, axis=1)
            near += list(ids[best])
            gaps += list(d)
            if len(v) >= want:
                reach[i:i + step] = np.minimum(reach[i:i + step], np.sqrt(d[:, -1]))
        return rows[["_id", "_v", "_cell", "_block"]].assign(_reach=reach, _near=near, _d=gaps)

    return freeze(blocked.groupBy("_cell", "_block").applyInPandas(
        compare, "_id long, _v array<double>, _cell int, _block int, _reach double, _near array<long>, _d array<double>")), cells


def _sent(settled: DataFrame, cells: DataFrame, pivots: Pivots, want: int, probes: int | None) -> DataFrame:
    """Rows once for every cell within their reach. The driver sees a row per pivot."""
    low, high = np.full(len(pivots.points), np.inf), np.full(len(pivots.points), -np.inf)
    for r in cells.select("_cell", "_low", "_high").toLocalIterator():
        low[r["_cell"]], high[r["_cell"]] = r["_low"], r["_high"]
    groups = len(pivots.tops)
    wide = np.full(groups, -np.inf)  # radius of a whole group
    for g in range(groups):
        part = pivots.cells(g)
        if part.start < part.stop:
            d = np.sqrt(squared_distances(pivots.tops[g:g + 1], pivots.points[part]))[0]
            wide[g] = (d + high[part]).max()

    def within(d: np.ndarray, inner: np.ndarray | float, outer: np.ndarray | float, reach: np.ndarray) -> np.ndarray:
        far = reach[:, None] * (1 + _SLACK) + _SLACK * (1 + d)
        return (d - outer <= far) & (inner - d <= far)

    def nearer_side(d: np.ndarray, own: np.ndarray, among: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether the reach crosses the plane between a pivot and the row's ``own``
        of these pivots: rows placed at a pivot lie on its side."""
        gap = np.sqrt(squared_distances(among[own], among))
        mine = d[np.arange(len(d)), own][:, None]
        return (d - mine) * (d + mine) <= 2 * gap * (reach[:, None] * (1 + _SLACK) + _SLACK * (1 + d))

    def nearest(v: np.ndarray) -> np.ndarray:
        """The distance to the last pivot that a row is sent to."""
        step = max(1, MATRIX // len(pivots.points))
        return np.sqrt(np.concatenate([np.partition(squared_distances(v[i:i + step], pivots.points), probes - 1, axis=1)[:, probes - 1]
                                       for i in range(0, len(v), step)]))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v, reach = _rows(batch["_v"]), np.minimum(batch["_reach"].to_numpy(), 1e300)  # zero times it is zero
            last = nearest(v) if probes and probes < len(pivots.points) else np.full(len(v), np.inf)
            to_top = np.sqrt(squared_distances(v, pivots.tops))
            open_ = within(to_top, 0.0, wide[None, :], reach) & nearer_side(to_top, to_top.argmin(axis=1), pivots.tops, reach)
            for g in range(groups):
                part = pivots.cells(g)
                rows = np.flatnonzero(open_[:, g])
                step = max(1, MATRIX // 16 // max(1, part.stop - part.start))
                for i in range(0, len(rows), step):
                    some = rows[i:i + step]
                    d = np.sqrt(squared_distances(v[some], pivots.points[part]))
                    near = within(d, low[part], high[part], reach[some]) & (d <= last[some, None])
                    near &= nearer_side(d, d.argmin(axis=1), pivots.points[part], reach[some])
                    row, cell = np.nonzero(near)
                    if len(row):
                        yield batch.iloc[some[row]].assign(_to=(part.start + cell).astype("int32"))

    return settled.select("_id", "_v", "_cell", "_block", "_reach").mapInPandas(
        send, "_id long, _v array<double>, _cell int, _block int, _reach double, _to int")


def _beyond(settled: DataFrame, sent: DataFrame, cells: DataFrame, want: int, block_rows: int) -> DataFrame:
    """``(_id, _near, _d)`` from the blocks that rows are sent to. Counting what
    arrives first gives every cell its number of parts on that side as well."""
    arriving = sent.groupBy(F.col("_to").alias("_cell")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_parts"))
    plan = small_side(freeze(cells.select("_cell", "_blocks").join(arriving, "_cell")))
    asking = sent.join(plan.select(F.col("_cell").alias("_to"), "_blocks", "_parts"), "_to").select(
        "_id", "_v", "_reach", "_cell", "_block", "_to", F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_parts")).cast("int").alias("_part"),
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_in"))
    asking = asking.where((F.col("_to") != F.col("_cell")) | (F.col("_in") != F.col("_block")))  # compared before
    asked = settled.join(plan, "_cell").select(
        "_id", "_v", F.col("_cell").alias("_to"), F.col("_block").alias("_in"),
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"_id": [], "_near": [], "_d": []})]
        if len(left) and len(right):
            right = right.sort_values("_id", kind="stable")
            ids, others = right["_id"].to_numpy(), _rows(right["_v"])
            step = max(1, MATRIX // len(others))
            for i in range(0, len(left), step):
                some = left.iloc[i:i + step]
                d = squared_distances(_rows(some["_v"]), others)
                best = np.argsort(d, axis=1, kind="stable")[:, :want]
                d = np.take_along_axis(d, best, axis=1)
                row, place = np.nonzero(np.sqrt(d) <= some["_reach"].to_numpy()[:, None] * (1 + _SLACK) + _SLACK)
                out.append(pd.DataFrame({"_id": some["_id"].to_numpy()[row], "_near": ids[best[row, place]], "_d": d[row, place]}))
        return pd.concat(out) if len(out) > 1 else out[0]

    key = ["_to", "_in", "_part"]
    return asking.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(compare, "_id long, _near long, _d double")


def _share_sent(settled: DataFrame, cells: DataFrame, pivots: Pivots, want: int, total: int) -> float:
    """The share of all blocks that a row is sent to, by about ``PLAN_ROWS`` rows."""
    some = settled.where(F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(max(1, total // PLAN_ROWS))) == 0)
    sizes = small_side(cells.select(F.col("_cell").alias("_to"), "_blocks"))
    blocks = _sent(some, cells, pivots, want, None).join(sizes, "_to").agg(F.sum("_blocks")).first()[0] or 0
    return blocks / (max(1, some.count()) * cells.agg(F.sum("_blocks")).first()[0])


class _Best:
    """The nearest found so far of the rows of a block: by distance, then id."""

    def __init__(self, ids: np.ndarray, reach: np.ndarray, want: int):
        self.ids, self.want = ids, want
        self.limit = (reach * (1 + _SLACK) + _SLACK) ** 2  # squared distance of whatever is still of use
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.held, self.most = 0, max(MATRIX, 4 * want * len(ids))

    def add(self, row: np.ndarray, near: np.ndarray, d: np.ndarray) -> None:
        use = d <= self.limit[row]
        self.found.append((row[use], near[use], d[use]))
        self.held += int(use.sum())
        if self.held > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, near, d = (np.concatenate(part) for part in zip(*self.found))
        order = np.lexsort((near, d, row))
        row, near, d = row[order], near[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.want - 1
        self.limit[row[last]] = np.minimum(self.limit[row[last]], d[last])
        use = place < self.want
        self.found = [(row[use], near[use], d[use])]
        self.held = int(use.sum())
        return self.found[0]

    def table(self) -> pa.Table:
        row, near, d = self.cut()
        return pa.table({"_id": self.ids[row], "_near": near, "_d": d})


def _compare(a: np.ndarray, b: np.ndarray, left: _Best, right: _Best | None) -> None:
    """All pairs of the rows of two blocks, for the left and, if given, the right side.

    Within unit length of their centre, single precision is off by less than
    ``err`` times both squared lengths, and ``1e-30`` where it underflows.
    """
    centre = b.mean(axis=0)
    scale = max(np.abs(a - centre).max(), np.abs(b - centre).max()) or 1.0
    a1, b1 = (a - centre) / scale, (b - centre) / scale
    err = (a.shape[1] + 32) * 2.0**-23
    half_a, half_b = (1 - err) / 2 * (a1 * a1).sum(axis=1), (1 - err) / 2 * (b1 * b1).sum(axis=1)
    # a row's product with a column, less half the column's squared length
    rows = np.concatenate([a1, np.ones((len(a), 1))], axis=1).astype("float32")
    columns = np.ascontiguousarray(np.concatenate([b1, -half_b[:, None]], axis=1).astype("float32").T)
    high, wide = TILE
    few = max(1, MATRIX // a.shape[1])

    def half(limit: np.ndarray | float) -> np.ndarray:
        return (np.sqrt(limit) / scale) ** 2 * ((1 + 1e-5) / 2) + 1e-30

    def least(i: int, limit: np.ndarray | float) -> np.ndarray:
        return (half_a[i:i + high] - half(limit)).astype("float32")[:, None]

    def mixed(limit: np.ndarray) -> bool:
        return limit.max() > 1.1 * limit.min()

    for i in range(0, len(a), high):
        waiting, held = [], 0
        for j in range(0, len(b), wide):
            part = rows[i:i + high] @ columns[:, j:j + wide]
            if right is None:
                near = part >= least(i, left.limit[i:i + high])
            else:
                theirs = right.limit[j:j + wide]
                near = part >= least(i, np.maximum(left.limit[i:i + high], theirs.min() if mixed(theirs) else theirs.max()))
                if mixed(theirs):
                    near |= part + half(theirs).astype("float32") >= least(i, 0.0)
            place = np.flatnonzero(near)
            if 8 * len(place) > part.size:
                d = squared_distances(a[i:i + high], b[j:j + wide])
                _add(i + np.repeat(np.arange(len(d)), d.shape[1]), j + np.tile(np.arange(d.shape[1]), len(d)), d.ravel(), left, right)
                continue
            row, column = np.divmod(place, part.shape[1])
            waiting.append((i + row, j + column))
            held += len(place)
            if held > few:
                _measure(a, b, waiting, few, left, right)
                waiting, held = [], 0
        if held:
            _measure(a, b, waiting, few, left, right)


def _measure(a: np.ndarray, b: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], few: int, left: _Best, right: _Best | None) -> None:
    row, column = (np.concatenate(part) for part in zip(*pairs))
    for k in range(0, len(row), few):
        gap = a[row[k:k + few]] - b[column[k:k + few]]
        # running sums add feature by feature, as squared_distances does
        _add(row[k:k + few], column[k:k + few], np.cumsum(gap * gap, axis=1)[:, -1], left, right)


def _add(row: np.ndarray, column: np.ndarray, d: np.ndarray, left: _Best, right: _Best | None) -> None:
    if right is None:  # a block and itself
        left.add(row, left.ids[column], d)
    else:
        left.add(row, right.ids[column], d)
        right.add(column, left.ids[row], d)


def _block(rows: pa.Table, want: int) -> tuple[np.ndarray, _Best]:
    # by reach, so that a tile has rows of about one reach
    rows = rows.sort_by([("_reach", "ascending"), ("_id", "ascending")])
    v = rows["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    return v, _Best(rows["_id"].to_numpy(), rows["_reach"].to_numpy(), want)


def _all_pairs(settled: DataFrame, want: int, total: int, width: int, block_rows: int) -> DataFrame:
    """``(_id, _near, _d)`` from all pairs of large blocks. Each block is compared
    with itself first, which leaves a row a reach that few other rows lie within."""
    most = max(block_rows, GRID_BYTES // (8 * max(width, 1)))
    tasks = 6 * settled.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-total // most), min(-(-total // block_rows), math.isqrt(tasks) + 1))

    def itself(rows: pa.Table) -> pa.Table:
        v, best = _block(rows, want)
        _compare(v, v, best, None)
        row, near, d = best.cut()
        first = np.searchsorted(row, np.arange(len(v) + 1))
        reach = np.full(len(v), np.inf)
        full = np.diff(first) >= want
        reach[full] = np.sqrt(d[first[1:][full] - 1])
        return pa.table({"_id": best.ids, "_v": pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), v.ravel()),
                         "_block": pa.array(np.full(len(v), rows["_block"][0].as_py()), pa.int32()),
                         "_reach": np.minimum(reach, np.sqrt(best.limit)),
                         "_near": pa.ListArray.from_arrays(pa.array(first, pa.int32()), near),
                         "_d": pa.ListArray.from_arrays(pa.array(first, pa.int32()), d)})

    block = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(blocks)).cast("int")
    dealt = settled.select("_id", "_v", "_reach", block.alias("_block"))
    placed = freeze(dealt.groupBy("_block").applyInArrow(
        itself, "_id long, _v array<double>, _block int, _reach double, _near array<long>, _d array<double>"))
    if blocks == 1:
        return _spelled(placed)

    def across(rows: pa.Table) -> pa.Table:
        mine = np.equal(rows["_block"].to_numpy(), rows["_low"].to_numpy())
        if mine.all() or not mine.any():
            return pa.table({"_id": pa.array([], pa.int64()), "_near": pa.array([], pa.int64()), "_d": pa.array([], pa.float64())})
        (a, left), (b, right) = _block(rows.filter(pa.array(mine)), want), _block(rows.filter(pa.array(~mine)), want)
        _compare(a, b, left, right)
        return pa.concat_tables(best.table() for best in (left, right))

    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = placed.select("_id", "_v", "_reach", "_block", other.alias("_other")).where("_block <> _other").select(
        "_id", "_v", "_reach", "_block", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"))
    return _spelled(placed).unionByName(pairs.groupBy("_low", "_high").applyInArrow(across, "_id long, _near long, _d double"))


def recall(df: DataFrame, key: str, features: Sequence[str] | str, found: DataFrame, k: int = 5, *,
           queries: int = 1000, seed: object = 5) -> float:
    """Share of the true neighbours of ``queries`` rows, the first by a hash of
    their key, that ``found`` (a result of ``knn``) has; by distance, so ties count.

    The queries go to every task, which passes on the k smallest distances of each.
    """
    points = df.select(F.col(key).cast("long").alias("_key"), _vector(features).alias("_v")).where(
        F.forall("_v", lambda x: F.abs(x) < F.lit(math.inf)))
    asked = points.orderBy(row_hash(["_key"], seed), "_key").limit(queries).collect()
    if not asked:
        return 1.0
    ids, v = np.array([r["_key"] for r in asked]), np.array([r["_v"] for r in asked], dtype="float64")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full((len(ids), k), np.inf)
        for batch in batches:
            step = max(1, MATRIX // len(ids))
            for i in range(0, len(batch), step):
                some = batch.iloc[i:i + step]
                d = squared_distances(v, _rows(some["_v"]))
                d[ids[:, None] == some["_key"].to_numpy()[None, :]] = np.inf
                best = np.sort(np.concatenate([best, d], axis=1), axis=1)[:, :k]
        row, place = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"_key": ids[row], "_d": best[row, place]})

    true = points.mapInPandas(search, "_key long, _d double").groupBy("_key").agg(
        F.slice(F.array_sort(F.collect_list("_d")), 1, k).alias("_true"))
    seen = true.join(found.withColumnRenamed(key, "_key"), "_key", "left")
    hit = F.size(F.filter(F.coalesce("neighbours", F.array().cast("array<struct<distance2:double,neighbour:bigint>>")),
                          lambda n: n["distance2"] <= F.element_at("_true", -1)))
    hits, all_ = seen.agg(F.sum(hit), F.sum(F.size("_true"))).first()
    return hits / all_ if all_ else 1.0
