"""Quality rules with robust multivariate outliers.

Every document gets a few counts. Those that fail the base rules go. For the
rest, transformed statistics make a vector (mean word length, symbol share,
share of repeated lines, share of words in repeated windows), and per language
and source a minimum covariance determinant estimate gives centre and scatter
of the bulk, scaled so that the median distance is that of a normal vector. A
document whose Mahalanobis distance, weighted by its size, is beyond a
chi-square quantile is rejected.

The estimate uses every document. Vectors are put on a fixed grid and counted
per group and grid cell, combined before the shuffle; a group's estimate then
works on weighted cells, whose number is bounded by the grid (``GRID``), so a
source with a third of all documents costs one small task. A cell keeps the
exact sums of its values and of their products, as whole numbers, so that
centre and scatter are those of the documents and partitioning changes nothing.
The width of a cell is added to the scatter, which keeps it regular when a
statistic is constant in the bulk.

Groups of fewer than ``LEAST`` documents take the estimate over all groups.

Defined results: a null or empty text has counts of 0 and fails the base rule;
null languages and sources are groups of their own; repeated rows are judged
alike; further columns are carried along by ``judge`` and never read; empty
tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import words as W
from tabweave.llm.frames import aside, keep, map_arrow, table
from tabweave.session import small_side

MIN_WORDS = 50
REPEAT_PER_CENT = 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FOUND = "_quality"

# Statistic: step of the grid and number of cells. Ends take what lies beyond.
GRID = {"word_length": (0.2, 80), "symbols": (0.02, 51), "dup_lines": (0.15, 7), "repeats": (0.15, 7)}
# A document is an outlier where a normal vector would be as far off with this
# probability. It is tiny because statistics of texts have long tails.
TAIL = 1e-50
UNIT = 1_000_000  # values are summed as whole millionths, so partitioning changes nothing
SUMS = tuple(f"sum_{name}" for name in GRID)
PRODUCTS = {f"product_{i}_{j}": (i, j) for i in range(len(GRID)) for j in range(i, len(GRID))}
SHARE = 0.75  # of the documents that the estimate has to cover
STARTS = 24
LEAST = 40
TYPICAL_WORDS = 400
PART_BYTES = 1 << 20  # texts counted together; the arrays of a part take some 50 times its bytes


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = W.text_buffer(column)
    words = W.Words(data, offsets)
    rows = len(offsets) - 1
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points start at other bytes
    symbols = np.zeros(256, np.bool_)
    symbols[list(SYMBOLS)] = True
    # lines, cut at line feeds and ends of texts
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, offsets[1:])))
    owner = np.repeat(np.arange(rows), 1 + np.diff(np.searchsorted(breaks, offsets)))
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    own = owner[filled]
    line, first = W.pair_codes(own, W.codes(W.span_texts(data, starts[filled], ends[filled]))[0])
    dup_lines = np.bincount(own, minlength=rows) - np.bincount(own[first], minlength=rows)
    # windows that occur twice or more in their text
    windows = W.starts_in_documents(words, WINDOW)
    word, _ = W.codes(W.span_texts(data, words.starts, words.ends))
    key = words.document()[windows]
    for k in range(WINDOW):
        key, _ = W.pair_codes(key, word[windows + k])
    repeated = W.cover(windows[np.bincount(key)[key] > 1], WINDOW, len(words))
    return {"n_words": words.counts, "word_chars": W.segment_sums(letters[words.ends] - letters[words.starts], words.first),
            "n_symbols": W.segment_sums(symbols[data], offsets), "n_dup_lines": dup_lines,
            "n_repeat_words": W.segment_sums(repeated, words.first)}


def count_parts(names: list[str]) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Work on a batch that gives the columns ``names`` with the counts, by parts of ``PART_BYTES``."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.text_parts(batch, limit=PART_BYTES):
            counts = count_texts(part.column("text"))
            struct = pa.StructArray.from_arrays([pa.array(counts[s], pa.int64()) for s in STATS], names=list(STATS))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), struct], names=[*names, FOUND])

    return work


def with_counts(docs: DataFrame, drop_text: bool = False) -> DataFrame:
    """``docs`` with a struct column of the counts of each text."""
    names = [c for c in docs.columns if c != FOUND and not (drop_text and c == "text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return map_arrow(docs.select(*dict.fromkeys([*names, "text"])), count_parts(names),
                     f"{fields}, `{FOUND}` struct<{','.join(s + ':long' for s in STATS)}>")


def base_failed() -> Column:
    found = F.col(FOUND)
    return (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > REPEAT_PER_CENT * found["n_words"])


def vector() -> dict[str, Column]:
    """The transformed statistics. A square root spreads small symbol shares
    out; word length is capped at the grid's end. Repeated lines are set against
    the words of four to a line."""
    found = F.col(FOUND)
    words = F.greatest(found["n_words"], F.lit(1)).cast("double")
    share = lambda x, y: F.least(x / F.greatest(y, F.lit(1)).cast("double"), F.lit(1.0))
    return {"word_length": F.least(found["word_chars"] / words, F.lit(16.0)),
            "symbols": F.sqrt(share(found["n_symbols"], found["word_chars"])),
            "dup_lines": share(found["n_dup_lines"], found["n_words"] / 4.0),
            "repeats": share(found["n_repeat_words"], found["n_words"])}


def size_weight() -> Column:
    """What a squared distance counts for: a mean over few words scatters more
    than the bulk does, one over many less. 1 at ``TYPICAL_WORDS`` words."""
    words = F.col(FOUND)["n_words"].cast("double")
    return 2 * words / (words + TYPICAL_WORDS)


def cover_least_scatter(points: np.ndarray, inner: np.ndarray, weight: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum covariance determinant over weighted cells: centre and scatter.

    ``points`` are the means of the cells, ``inner`` the scatter inside each.
    Starts are the coordinate-wise median and small sets picked by fixed
    numbers; concentration steps then take the nearest ``SHARE`` of the weight
    until the determinant stops falling.
    """
    cells, size = points, points.shape[1]
    floor = np.diag(widths**2 / 12)  # keeps the scatter regular where the bulk agrees in a statistic
    need = np.ceil(SHARE * weight.sum())

    def moments(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = part @ cells / part.sum()
        off = cells - centre
        return centre, ((off * part[:, None]).T @ off + np.einsum("c,cij->ij", part, inner)) / part.sum() + floor

    def distances(centre: np.ndarray, scatter: np.ndarray) -> np.ndarray:
        off = cells - centre
        return np.einsum("ij,ij->i", off @ np.linalg.inv(scatter), off)

    def nearest(distance: np.ndarray) -> np.ndarray:
        order = np.lexsort((np.arange(len(cells)), distance))
        total = np.cumsum(weight[order])
        part = np.zeros(len(cells))
        part[order] = np.clip(need - (total - weight[order]), 0, weight[order])
        return part

    def quantile(values: np.ndarray, share: float) -> float:
        order = np.argsort(values, kind="stable")
        return values[order][np.searchsorted(np.cumsum(weight[order]), share * weight.sum())]

    middle = np.array([quantile(cells[:, k], 0.5) for k in range(size)])
    spread = np.array([quantile(np.abs(cells[:, k] - middle[k]), 0.5) for k in range(size)]) * 1.4826
    starts = [(middle, np.diag(spread**2) + floor)]
    total = np.cumsum(weight)
    for k in range(STARTS):  # points drawn by weight, with fixed numbers
        picks = W.numbers(1000 + k, size + 1) / 2.0**64
        at = np.searchsorted(total, picks * total[-1], "right")
        part = np.bincount(np.minimum(at, len(cells) - 1), minlength=len(cells)).astype(float)
        starts.append(moments(part))
    best = None
    for centre, scatter in starts:
        last = np.inf
        for _ in range(50):
            centre, scatter = moments(nearest(distances(centre, scatter)))
            now = np.linalg.slogdet(scatter)[1]
            if now >= last - 1e-12:
                break
            last = now
        if best is None or last < best[0] - 1e-9:
            best = (last, centre, scatter)
    _, centre, scatter = best
    # scale so that the median distance is that of a normal vector (Wilson-Hilferty)
    median = size * (1 - 2 / (9 * size)) ** 3
    mean = distances(centre, scatter) + np.einsum("ij,cij->c", np.linalg.inv(scatter), inner)  # over the documents of a cell
    return centre, scatter * (quantile(mean, 0.5) / median or 1.0)


def fit_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(list(GRID))
    widths = np.array([w for w, _ in GRID.values()])
    weight = rows["n"].to_numpy(float)
    means = rows[list(SUMS)].to_numpy(float) / UNIT / weight[:, None]
    inner = np.empty((len(rows), len(GRID), len(GRID)))
    for name, (i, j) in PRODUCTS.items():
        inner[:, i, j] = inner[:, j, i] = rows[name].to_numpy(float) / UNIT**2 / weight - means[:, i] * means[:, j]
    centre, scatter = cover_least_scatter(means, inner, weight, widths)
    return pd.DataFrame({"lang": [rows["lang"].iat[0]], "source": [rows["source"].iat[0]],
                         "documents": [int(rows["n"].sum())], "centre": [centre.tolist()],
                         "inverse": [np.linalg.inv(scatter).reshape(-1).tolist()]})


def estimates(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of all groups of enough documents, and of all documents together."""
    values = vector()
    cells = [F.least(F.floor(column / GRID[name][0]), F.lit(GRID[name][1] - 1)).cast("int").alias(name)
             for name, column in values.items()]
    whole = [F.round(column * UNIT).cast("decimal(9,0)") for column in values.values()]
    good = counted.where(~base_failed()).select("lang", "source", *cells, *(c.alias(n) for c, n in zip(whole, SUMS, strict=True)))
    sums = [*(F.sum(n).alias(n) for n in SUMS),
            *(F.sum(F.col(SUMS[i]) * F.col(SUMS[j])).alias(n) for n, (i, j) in PRODUCTS.items())]
    counts = keep(good.groupBy("lang", "source", *GRID).agg(F.count(F.lit(1)).alias("n"), *sums), "quality_cells")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("documents")).where(F.col("documents") >= LEAST)
    own = counts.alias("c").join(sizes.alias("s"), F.col("c.lang").eqNullSafe(F.col("s.lang")) & F.col("c.source").eqNullSafe(F.col("s.source")), "left_semi")
    shape = "lang string, source string, documents long, centre array<double>, inverse array<double>"
    doubles = [F.col(n).cast("double").alias(n) for n in (*SUMS, *PRODUCTS)]
    groups = keep(own.select("lang", "source", *GRID, "n", *doubles).groupBy("lang", "source").applyInPandas(fit_group, shape), "quality_groups")
    pooled = (counts.groupBy(*GRID).agg(*(F.sum(n).alias(n) for n in ("n", *SUMS, *PRODUCTS)))
              .select(F.lit("").alias("lang"), F.lit("").alias("source"), *GRID, "n", *doubles)
              .groupBy("lang", "source").applyInPandas(fit_group, shape))
    return groups, keep(pooled, "quality_pooled")


def chi_square_cut(size: int, tail: float = TAIL) -> float:
    """Where the chi-square distribution of ``size`` degrees leaves ``tail`` above it."""
    half = size // 2
    if size % 2:
        above = lambda x: math.erfc(math.sqrt(x / 2)) + math.exp(-x / 2) * sum(
            (x / 2)**(k + 0.5) / math.gamma(k + 1.5) for k in range(half))
    else:
        above = lambda x: math.exp(-x / 2) * sum((x / 2)**k / math.factorial(k) for k in range(half))
    low, high = 0.0, 4.0
    while above(high) > tail:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > tail else (low, middle)
    return high


def judge(counted: DataFrame, groups: DataFrame, pooled: DataFrame, tail: float = TAIL) -> DataFrame:
    """``counted`` with _distance (squared) and _kept. The table of groups is
    broadcast only when counted small; else the join splits a hot group."""
    names = {"lang": "_q_lang", "source": "_q_source", "centre": "_q_centre", "inverse": "_q_inverse"}
    side = small_side(groups.select(*(F.col(a).alias(b) for a, b in names.items())))
    joined = counted.join(side, F.col("lang").eqNullSafe(F.col("_q_lang")) & F.col("source").eqNullSafe(F.col("_q_source")), "left")
    rest = pooled.select("centre", "inverse").first()  # one row, of fixed size
    size = len(GRID)
    if rest is None:  # nothing passed the base rules
        return counted.withColumn("_distance", F.lit(None).cast("double")).withColumn("_kept", ~base_failed())
    constant = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    centre = F.coalesce(F.col("_q_centre"), constant(rest["centre"]))
    inverse = F.coalesce(F.col("_q_inverse"), constant(rest["inverse"]))
    off = [column - centre[k] for k, column in enumerate(vector().values())]
    distance = sum((off[i] * off[j] * inverse[i * size + j] for i in range(size) for j in range(size)), F.lit(0.0))
    out = joined.withColumn("_distance", distance * size_weight()).drop(*names.values())
    return out.withColumn("_kept", ~base_failed() & (F.col("_distance") <= F.lit(chi_square_cut(size, tail))))


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. Two scans of the texts."""
    docs, back = aside(docs, (FOUND, "_distance", "_kept", "_q_lang", "_q_source", "_q_centre", "_q_inverse"))
    groups, pooled = estimates(with_counts(docs.select("lang", "source", "text"), drop_text=True))
    return judge(with_counts(docs), groups, pooled).where("_kept").select(*docs.columns).withColumnsRenamed(back)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    counted = keep(with_counts(docs, drop_text=True), "quality_counts")
    judged = judge(counted, *estimates(counted))
    return judged.select("doc_id", *(F.col(f"{FOUND}.{s}").alias(s) for s in STATS), base_failed().alias("base_failed"),
                         F.col("_kept").alias("kept"), F.col("_distance").alias("distance"))
