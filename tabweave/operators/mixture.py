"""Blending sources by weight.

Candidates are long tables ``(cand, ordinal, source, alpha)``; they hold a row
per candidate and source and are the only thing that is ever broadcast here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.hashing import row_hash
from tabweave.operators.sample import HASH, Cut, find_cuts, numbered_copies, with_hash
from tabweave.session import freeze, small_side

REAL = "real"


def mix_normalise(candidates: DataFrame, augmented: float = 0.0, real: str = REAL) -> DataFrame:
    """Scale the weights of the synthetic sources to add up to ``1 - augmented``;
    the real source, if present, gets exactly ``augmented``."""
    if not 0 <= augmented <= 1:
        raise ValueError("the augmented share must lie in [0, 1]")
    synthetic = F.when(F.col("source") != real, F.col("alpha"))
    scale = F.sum(synthetic).over(Window.partitionBy("cand")) / F.lit(1.0 - augmented)
    return candidates.withColumn("alpha", F.when(F.col("source") == real, F.lit(float(augmented))).otherwise(
        F.lit(1.0) / F.nullif(scale, F.lit(0.0)) * F.col("alpha")))


def mix_augment(candidates: DataFrame, augmented: float, ordinal: int = 5, real: str = REAL) -> DataFrame:
    """Add the real rows as one more source with a fixed share to every candidate."""
    extra = candidates.select("cand").distinct().select(
        "cand", F.lit(ordinal).alias("ordinal"), F.lit(real).alias("source"), F.lit(float(augmented)).alias("alpha"))
    return mix_normalise(candidates.unionByName(extra), augmented, real)


def mix_size(candidates: DataFrame, source_rows: DataFrame, total: int | None = None) -> DataFrame:
    """Rows per source that add up to ``total``: ``size``, never more than the source has.

    A source is asked for ``alpha * total`` rows. What a source cannot give is
    shared by the others in proportion to their weights, again and again until
    none is asked for too much. Sizes are rounded down and the remainder goes
    to the largest weight (the first on a tie), then to the next with room.
    ``source_rows`` is ``(source, rows)``, a row per source. Without ``total``
    the mixture is as large as the largest source. A total beyond all rows is
    an error when the sizes are read.
    """
    every = Window.partitionBy("cand")
    sized = candidates.join(small_side(freeze(source_rows)), "source")
    goal = F.lit(total).cast("long") if total is not None else F.max("rows").over(every)
    sized = sized.withColumn("_goal", F.when(F.sum("rows").over(every) >= goal, goal).otherwise(
        F.raise_error(F.lit("the sources have fewer rows than the mixture asks for"))))
    # Sources in the order in which they run out as the mixture grows. One is
    # exhausted if its share of what those before it leave is beyond its rows.
    fill = Window.partitionBy("cand").orderBy(F.coalesce(F.col("rows") / F.nullif("alpha", F.lit(0.0)), F.lit(float("inf"))), "ordinal")
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("_goal") - F.coalesce(F.sum("rows").over(before), F.lit(0))
    sized = sized.withColumn("_left", left).withColumn("_weights", F.sum("alpha").over(onward))
    sized = sized.withColumn("_full", (F.col("alpha") > 0) & (F.col("rows") * F.col("_weights") < F.col("alpha") * F.col("_left")))
    open_rows, open_alpha = F.col("_goal") - F.sum(F.when(F.col("_full"), F.col("rows"))).over(every), F.sum(F.when(~F.col("_full"), F.col("alpha"))).over(every)
    share = F.when(F.col("_full"), F.col("rows")).when(
        F.max("_full").over(every), F.floor(F.col("alpha") * open_rows / F.nullif(open_alpha, F.lit(0.0)) + 1e-9)).otherwise(
        F.floor(F.col("alpha") * F.col("_goal")))
    sized = sized.withColumn("size", F.least(F.coalesce(share.cast("long"), F.lit(0)), F.col("rows")))
    top = Window.partitionBy("cand").orderBy(F.desc("alpha"), "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("_room", F.col("rows") - F.col("size")).withColumn("_rest", F.col("_goal") - F.sum("size").over(every))
    give = F.least("_room", F.greatest(F.col("_rest") - F.coalesce(F.sum("_room").over(top), F.lit(0)), F.lit(0)))
    return sized.withColumn("size", F.col("size") + give).drop("_goal", "_left", "_weights", "_full", "_room", "_rest")


def source_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def _sizes(sizes: DataFrame) -> list[tuple[object, str, int, int]]:
    rows = [(r["cand"], r["source"], int(r["size"]), int(r["rows"]))
            for r in sizes.select("cand", "source", "size", "rows").collect()]
    for cand, source, size, available in rows:
        if not 0 <= size <= available:
            raise ValueError(f"candidate {cand} wants {size} of {available} rows from {source}")
    return rows


def candidate_cuts(hashed: DataFrame, sizes: DataFrame) -> list[tuple[object, Cut]]:
    """For each candidate and source, the hash up to which rows belong to it."""
    wanted = _sizes(sizes)
    positions: dict[object, list[int]] = {}
    for _, source, size, _ in wanted:
        if size:
            positions.setdefault(source, []).append(size)
    at = {(c.group, c.position): c for c in find_cuts(hashed, positions, "source")}
    return [(cand, at[(source, size)]) for cand, source, size, _ in wanted if size]


def mix_draw(sources: DataFrame, sizes: DataFrame, key: Sequence[str], seed: object = 5,
             independent: bool = False) -> DataFrame:
    """The rows of every candidate mixture, with a ``cand`` column.

    ``sources`` has a ``source`` column; ``sizes`` comes from ``mix_size``.
    Rows are joined to the broadcast cut table on the source and a hash range,
    so no source row is shuffled. By default the draws of different candidates
    are nested (less noise between them); ``independent`` salts the order per
    candidate instead.
    """
    spark = sources.sparkSession
    kind = sizes.schema["cand"].dataType.simpleString()
    if independent:
        pairs = sizes.select("cand", F.col("source").alias("_s")).where(F.col("size") > 0)
        many = sources.join(F.broadcast(pairs), sources["source"] == F.col("_s")).drop("_s")
        hashed = many.withColumn(HASH, row_hash([*key, "source", "cand"], seed)).withColumn(
            "_pair", F.concat_ws("|", F.col("cand").cast("string"), "source"))
        wanted = [w for w in _sizes(sizes) if w[2]]
        cuts = find_cuts(hashed, {f"{c}|{s}": [n] for c, s, n, _ in wanted}, "_pair")
        listed = [(c.group, c.hash, c.take, c.copies) for c in cuts]
        limits = spark.createDataFrame(listed, "_pair string, _cut string, _take long, _copies long")
        joined = hashed.join(F.broadcast(limits), "_pair").drop("_pair")
    else:
        hashed = with_hash(sources, [*key, "source"], seed)
        listed = [(cand, c.group, c.hash, c.take, c.copies) for cand, c in candidate_cuts(hashed, sizes)]
        limits = spark.createDataFrame(listed, f"cand {kind}, _s string, _cut string, _take long, _copies long")
        joined = hashed.join(F.broadcast(limits), (hashed["source"] == F.col("_s")) & (hashed[HASH] <= F.col("_cut"))).drop("_s")
    columns = [*sources.columns, "cand"]
    whole = joined.where((F.col(HASH) < F.col("_cut")) | ((F.col(HASH) == F.col("_cut")) & (F.col("_take") == F.col("_copies"))))
    out = whole.select(*columns)
    if any(row[-2] < row[-1] for row in listed):
        edge = joined.where((F.col(HASH) == F.col("_cut")) & (F.col("_take") < F.col("_copies")))
        edge = edge.withColumn("_place", F.concat_ws("|", HASH, F.col("cand").cast("string")))
        out = out.unionByName(numbered_copies(edge, "_place").where(F.col("_copy") <= F.col("_take")).select(*columns))
    return out


def mix_warmstart(scores: DataFrame, augmented: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Starting weights from validation AUCs: ``(auc - min + 0.001)`` scaled to
    add up to ``1 - augmented``. ``scores`` has a row per source."""
    group = Window.partitionBy(*by)
    lifted = scores.withColumn("alpha", F.col("auc") - F.min("auc").over(group) + F.lit(1e-3))
    scale = F.sum("alpha").over(group) / F.lit(1.0 - augmented)
    return lifted.withColumn("alpha", F.lit(1.0) / scale * F.col("alpha"))


def mix_corner(scores: DataFrame, probe_auc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keep the warm start if its mixture beat the best single source, else put
    all weight on that source (the first on a tie).

    ``scores`` has ``source, ordinal, auc, alpha`` per group, ``probe_auc`` one
    row ``probe`` per group.
    """
    top = Window.partitionBy(*by).orderBy(F.desc("auc"), "ordinal")
    ranked = scores.withColumn("_top", F.row_number().over(top)).withColumn("_best", F.max("auc").over(Window.partitionBy(*by)))
    joined = ranked.join(probe_auc, list(by)) if by else ranked.withColumn("probe", probe_auc.select("probe").scalar())
    kept = F.col("probe") > F.col("_best")
    return joined.withColumn("alpha", F.when(kept, F.col("alpha")).otherwise((F.col("_top") == 1).cast("double"))).select(
        *by, "source", "ordinal", "auc", "alpha")
