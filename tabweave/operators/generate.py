"""Synthetic rows from a Gaussian copula with empirical marginals.

Fitting narrows down the quantile grids by counts, and takes one aggregate for the
category shares and one for the correlation of normal scores; only the grids
and the d x d matrix reach the driver. Drawing is a range of row numbers, their
hashes, and arithmetic on batches of them: every row depends on its number and the seed
alone, so any task can be rerun and any number of rows drawn in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.cuts import bucket_quantiles
from tabweave.functions.hashing import normal_array, row_hash, uniform_array
from tabweave.functions.normal import normal_cdf_array, normal_ppf_array
from tabweave.functions.ordered import running
from tabweave.session import freeze, small_side

RIDGE = 1e-6
# Normal scores are summed as whole numbers of this grain: exact in any order.
GRAIN = 1_000_000
# Places stay so far from 0 and 1.
EDGE = 1e-6
# The column that numbers the models of a family.
MEMBER = "_member"


@dataclass(frozen=True)
class CopulaModel:
    """A fitted copula. ``grids``, ``factor`` and ``missing`` (the share of
    nulls by column) are small and on the driver, ``shares`` (column, value,
    low, high) stays a table."""

    columns: tuple[str, ...]
    types: dict[str, str]
    grids: dict[str, list[float]]
    shares: DataFrame | None
    categorical: tuple[str, ...]
    factor: np.ndarray
    correlation: np.ndarray
    missing: dict[str, float]


def category_shares(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative share of each category in sorted order: ``[low, high)``."""
    long = df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(list(by), list(columns), "column", "value")
    group = [*by, "column"]
    counted = long.where(F.col("value").isNotNull()).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    upto = running(counted, group, ["value"], {"upto": ("sum", "n")})
    rows = upto.groupBy(*group).agg(F.max("upto").alias("rows"))  # one row per column and group
    return freeze(upto.join(F.broadcast(rows), group).select(
        *group, "value", ((F.col("upto") - F.col("n")) / F.col("rows")).alias("low"),
        (F.col("upto") / F.col("rows")).alias("high")))


def _grid_knots(grid: list[float]) -> tuple[list[float], list[float]]:
    """Distinct grid values and their place in (0, 1).

    A run of equal grid values is a point mass; the middle of the run stands
    for it.
    """
    knots, at = np.unique(np.array(grid), return_inverse=True)
    levels = np.linspace(0.0, 1.0, len(grid))
    return knots.tolist(), [float(levels[at == i].mean()) for i in range(len(knots))]


# Rows whose products of scores are summed in 64 bits: a score is below 5 * GRAIN.
SUM_ROWS = 100_000
PAIR_SUMS = ("n", "x", "y", "xy", "xx", "yy")


def _places(values: np.ndarray, grid: list[float]) -> np.ndarray:
    """The empirical CDF, linear between the knots of a grid."""
    knots, mid = _grid_knots(grid)
    if len(knots) == 1:
        return np.full(len(values), 0.5)
    slope = np.concatenate(([0.0], np.diff(mid) / np.diff(knots), [0.0]))
    at = np.searchsorted(knots, values, "right")
    return np.array([mid[0], *mid])[at] + (values - np.array([knots[0], *knots])[at]) * slope[at]


def correlate(rows: DataFrame, grids: dict[int, dict[int, list[float]]]) -> dict[int, np.ndarray]:
    """Correlation matrix of the normal scores of all columns but the first, the
    class, for each class.

    A column with a grid holds values, one without places in (0, 1). Every task
    sums whole numbers and passes on a row per pair and class, so the result
    does not depend on the order of the rows; a pair counts the rows where
    both are present. A matrix of such pairs need not be one of a distribution:
    negative eigenvalues are raised to nothing.
    """
    size = len(rows.columns) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in (b.slice(i, SUM_ROWS) for b in batches for i in range(0, b.num_rows, SUM_ROWS)):
            group = batch.column(0).to_numpy(zero_copy_only=False)
            whole = [pc.cast(batch.column(j + 1), pa.float64()).to_numpy(zero_copy_only=False) for j in range(size)]
            for g in np.unique(group).tolist():
                own = group == g
                u = np.column_stack([_places(c[own], grids[g][j]) if j in grids.get(g, ()) else c[own] for j, c in enumerate(whole)])
                there = ~np.isnan(u)
                z = normal_ppf_array(np.where(there, np.clip(u, EDGE, 1 - EDGE), 0.5)) * GRAIN
                z = np.where(there, np.sign(z) * np.floor(np.abs(z) + 0.5), 0.0).astype(np.int64)
                m = there.astype(np.int64)
                x, xx = z.T @ m, (z * z).T @ m
                parts = [p.astype(object) for p in (m.T @ m, x, x.T, z.T @ z, xx, xx.T)]
                sums[g] = [a + b for a, b in zip(sums[g], parts)] if g in sums else parts
        i, j = np.tril_indices(size, -1)
        for g, parts in sums.items():
            listed = [pa.array([Decimal(v) for v in p[i, j]], pa.decimal128(38, 0)) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *listed],
                                             names=["g", "i", "j", *PAIR_SUMS])

    shape = "g int, i int, j int, " + ", ".join(f"{s} decimal(38,0)" for s in PAIR_SUMS)
    pairs = rows.mapInArrow(work, shape).groupBy("g", "i", "j").agg(*[F.sum(s).alias(s) for s in PAIR_SUMS])
    out: dict[int, np.ndarray] = {}
    for row in pairs.collect():  # a row per pair of columns and class
        matrix = out.setdefault(row["g"], np.eye(size))
        n, x, y, xy, xx, yy = (int(row[s]) for s in PAIR_SUMS)
        # a constant column is correlated with nothing
        spread = (n * xx - x * x) * (n * yy - y * y)
        if n:
            matrix[row["i"], row["j"]] = matrix[row["j"], row["i"]] = (n * xy - x * y) / math.sqrt(spread) if spread > 0 else 0.0
    for g, matrix in out.items():
        values, vectors = np.linalg.eigh(matrix)
        if values.min() < 0:
            matrix = (vectors * np.clip(values, 0.0, None)) @ vectors.T
            scale = np.sqrt(np.diag(matrix))
            matrix = matrix / scale[:, None] / scale[None, :]
            np.fill_diagonal(matrix, 1.0)
            out[g] = matrix
    return out


def fit_copula(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], grid: int = 101) -> CopulaModel:
    """Fit on all rows: a column's marginal on the rows where it is present, a
    correlation on the rows where both columns are. The share of nulls of each column is kept."""
    return fit_classes(df, F.lit(0), [0], numeric, categorical, grid)[0]


def fit_classes(df: DataFrame, label: Column, values: Sequence[object], numeric: Sequence[str], categorical: Sequence[str],
                grid: int = 101) -> dict[object, CopulaModel]:
    """A copula for the rows of each value of ``label``, all fitted in the same
    jobs: grids, shares, null counts and correlations are tables keyed by class."""
    names = [*numeric, *categorical]
    group = F.lit(None).cast("int")
    for g, v in enumerate(values):
        group = F.when(label == F.lit(v), F.lit(g)).otherwise(group)
    whole = lambda c: F.col(c).cast("double")
    rows = df.select(group.alias("_g"), *[F.when(F.abs(whole(c)) < float("inf"), whole(c)).alias(c) for c in numeric], *categorical)
    rows = rows.where(F.col("_g").isNotNull())
    probs = [float(p) for p in np.linspace(0.0, 1.0, grid)]
    classes = range(len(values))
    grids: dict[int, dict[str, list[float]]] = {g: {} for g in classes}
    if numeric:
        wide = rows.select(*[F.when(F.col("_g") == g, F.col(c)).alias(f"{g}|{i}") for g in classes for i, c in enumerate(numeric)])
        for c, grid_values in bucket_quantiles(wide, wide.columns, probs).items():
            g, i = c.split("|")
            grids[int(g)][numeric[int(i)]] = grid_values
    shares = category_shares(rows, categorical, ["_g"]) if categorical else None
    counted = {r["_g"]: r for r in rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n{i}") for i, c in enumerate(names)]).collect()}

    scored = rows
    for i, c in enumerate(categorical):
        side = small_side(shares.where(F.col("column") == c).select(
            F.col("_g").alias("_h"), F.col("value").alias("_v"), ((F.col("low") + F.col("high")) / 2).alias(f"_u_{c}")))
        scored = scored.join(side, (scored[c].cast("string") == side["_v"]) & (scored["_g"] == side["_h"]), "left").drop("_v", "_h")
    column = {c: c if c in numeric else f"_u_{c}" for c in names}
    correlations = correlate(scored.select("_g", *[F.col(column[c]).alias(f"_z{i}") for i, c in enumerate(names)]),
                             {g: {names.index(c): grid for c, grid in grids[g].items()} for g in classes})
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in names}
    size, out = len(names), {}
    for g, v in enumerate(values):
        correlation = correlations.get(g, np.eye(size))
        factor = np.linalg.cholesky((correlation + RIDGE * np.eye(size)) / (1 + RIDGE))
        n = counted[g]["_rows"] if g in counted else 0
        missing = {c: 1.0 - counted[g][f"_n{i}"] / n if n else 1.0 for i, c in enumerate(names)}
        part = shares.where(F.col("_g") == g).drop("_g") if shares is not None else None
        out[v] = CopulaModel(tuple(names), types, grids[g], part, tuple(categorical), factor, correlation, missing)
    return out


def thinned(model: CopulaModel, grid: int) -> CopulaModel:
    """The same model on a coarser grid, whose steps are whole steps of its own."""
    grids = {}
    for c, listed in model.grids.items():
        step, rest = divmod(len(listed) - 1, grid - 1)
        if rest or not step:
            raise ValueError(f"a grid of {len(listed)} cannot be thinned to {grid}")
        grids[c] = listed[::step]
    return replace(model, grids=grids)


def _drawn_category(drawn: DataFrame, u: str, shares: DataFrame, column: str, kind: str) -> DataFrame:
    """The category whose range holds ``u``: an equi-join on ``u`` in as many
    buckets as there are categories, then the range. A common category has a
    row in every bucket it reaches, so no bucket is hot."""
    table = freeze(shares.select("value", "low", "high"))
    buckets = max(table.count(), 1)
    bucket = lambda c: F.least(F.floor(c * buckets), F.lit(buckets - 1)).cast("int")
    side = table.select(F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))).alias("_bucket"),
                        F.col("value").alias("_value"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    side = small_side(side, counted=2 * buckets)
    at = drawn.withColumn("_at", bucket(F.col(u)))
    # the last range ends at 1 and holds it
    inside = (F.col(u) >= F.col("_low")) & ((F.col(u) < F.col("_high")) | (F.col("_high") >= 1.0))
    found = at.join(side, (at["_at"] == side["_bucket"]) & inside, "left")
    return found.withColumn(column, F.col("_value").cast(kind)).drop("_at", "_bucket", "_value", "_low", "_high")


def _grid_values(u: np.ndarray, grid: list[float]) -> np.ndarray:
    """Inverse of the empirical CDF."""
    last, listed = len(grid) - 1, np.array(grid)
    place = u * last
    at = np.minimum(np.floor(place), last - 1).astype(np.int64)
    return listed[at] + (place - at) * (listed[at + 1] - listed[at])


def draw_copula(spark: SparkSession, model: CopulaModel, n: int, seed: object = 5, first_id: int = 0) -> DataFrame:
    """``n`` synthetic rows with a ``row_id``."""
    return draw_family(spark, [model], n, seed, first_id).drop(MEMBER)


def draw_family(spark: SparkSession, models: Sequence[CopulaModel], n: int, seed: object = 5, first_id: int = 0) -> DataFrame:
    """The draw of each of some models that differ in their grids alone, under a
    ``member`` number: hashes, normals and categories follow from the row and
    the common part of the models, so they are made once for all.

    Spark hashes the row numbers; the arithmetic from hash to value is done on
    batches of rows.
    """
    model, members = models[0], len(models)
    d, names = len(model.columns), model.columns
    blocks = (d + 3) // 4
    holes = [j for j, c in enumerate(names) if model.missing[c] > 0]
    hashes = [F.unhex(row_hash(["row_id"], f"{seed}-{block}")) for block in range(blocks)]
    hashes += [F.unhex(row_hash(["row_id"], f"{seed}-null-{j}")) for j in holes]
    ids = spark.range(first_id, first_id + n).withColumnRenamed("id", "row_id")
    grids = [[m.grids.get(c) for c in names] for m in models]
    missing, factor, texts = [model.missing[c] for c in names], model.factor, [c in model.categorical for c in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uniforms = [uniform_array(batch.column(1 + k)) for k in range(blocks + len(holes))]
            normals = np.concatenate([normal_array(u) for u in uniforms[:blocks]])
            there = {j: uniforms[blocks + k][0] >= missing[j] for k, j in enumerate(holes)}
            u = []
            for i in range(d):
                z = np.zeros(batch.num_rows)
                for j in range(i + 1):
                    if abs(factor[i, j]) > 0.0:
                        z = z + factor[i, j] * normals[j]
                u.append(normal_cdf_array(z))
            for k in range(members):
                values = [u[j] if texts[j] else None if grids[k][j] is None else _grid_values(u[j], grids[k][j]) for j in range(d)]
                listed = [pa.nulls(batch.num_rows, pa.float64()) if v is None else
                          pa.array(v, pa.float64(), mask=~there[j] if j in there else None) for j, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, k, np.int32)), *listed],
                                                 names=["row_id", MEMBER, *[f"_c{j}" for j in range(d)]])

    drawn = ids.select("row_id", *[h.alias(f"_h{k}") for k, h in enumerate(hashes)]).mapInArrow(
        work, f"row_id long, {MEMBER} int, " + ", ".join(f"_c{j} double" for j in range(d)))
    whole = {t.simpleString() for t in (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())}
    out = []
    for j, c in enumerate(names):
        kind, value = model.types[c], F.col(f"_c{j}")
        if texts[j]:
            drawn = _drawn_category(drawn, f"_c{j}", model.shares.where(F.col("column") == c), f"_d{j}", kind)
            value = F.col(f"_d{j}")
        elif kind in whole:
            value = F.round(value)
        out.append(value.cast(kind).alias(c))
    return drawn.select("row_id", MEMBER, *out)


def gen_copula(df: DataFrame, n: int, numeric: Sequence[str], categorical: Sequence[str], grid: int = 101,
               seed: object = 5) -> DataFrame:
    return draw_copula(df.sparkSession, fit_copula(df, numeric, categorical, grid), n, seed)


def gen_conditional(df: DataFrame, label: str, sizes: dict[int, int], numeric: Sequence[str],
                    categorical: Sequence[str], grid: int = 101, seed: object = 5) -> DataFrame:
    """Fixed class counts: a copula per class, all fitted at once."""
    asked = {v: n for v, n in sizes.items() if n}
    if not asked:
        raise ValueError("no rows asked for")
    models = fit_classes(df, F.col(label), list(asked), numeric, categorical, grid)
    return draw_classes(df.sparkSession, models, asked, label, df.schema[label].dataType, seed)


def draw_classes(spark: SparkSession, models: dict, sizes: dict, label: str, kind: T.DataType, seed: object = 5) -> DataFrame:
    """``sizes[v]`` rows of each class ``v``, numbered through."""
    return draw_class_families(spark, {v: [m] for v, m in models.items()}, sizes, label, kind, seed).drop(MEMBER)


def draw_class_families(spark: SparkSession, models: dict, sizes: dict, label: str, kind: T.DataType, seed: object = 5) -> DataFrame:
    """The same for models of each class that differ in their grids alone, under a ``member`` number."""
    out, first = None, 0
    for value, n in sizes.items():
        part = draw_family(spark, models[value], n, f"{seed}-{value}", first).withColumn(label, F.lit(value).cast(kind))
        out = part if out is None else out.unionByName(part)
        first += n
    return out
