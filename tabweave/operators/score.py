"""ROC AUC and the classifiers that are trained on one table and scored on another."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.cuts import bin_counts, value_cuts
from tabweave.functions.ordered import running
from tabweave.operators.clean import numeric_columns, string_columns
from tabweave.operators.encode import ENCODED, EncoderTable, te_fit
from tabweave.session import freeze, sizes_by, small_side


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (), one_class: float | None = None,
        weight: str | None = None, **limits: int) -> DataFrame:
    """Exact ROC AUC per ``by`` group; tied scores count half.

    Rows are first counted by distinct score (combined map-side, so a score
    shared by a third of all rows is one row), then a running count of
    negatives is taken along the scores. ``weight`` is a column that says how
    many rows a row stands for. ``one_class`` is the value for a group that
    holds a single class (null by default).
    """
    y, n = F.col(label).cast("long"), F.col(weight) if weight else F.lit(1)
    counted = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum(y * n).alias("_pos"), F.sum((1 - y) * n).alias("_neg"))
    ranked = running(counted, list(by), ["_s"], {"_below": ("sum", "_neg")}, include_current=False, **limits)
    return auc_from_counts(ranked, by, one_class)


def auc_from_counts(ranked: DataFrame, by: Sequence[str], one_class: float | None = None) -> DataFrame:
    wins = F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)
    sums = ranked.groupBy(*by).agg(
        F.sum(wins).alias("_wins"), F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select(*by, "positives", "negatives", F.when(pairs > 0, F.col("_wins") / pairs).otherwise(
        F.lit(one_class).cast("double")).alias("auc"))


# ---------------------------------------------------------------- log-odds
#
# The score of a row depends on its bins alone. So rows are counted by their
# combination of bins first, and all fitting and scoring, under however many
# models, works on those counts.


def binned(df: DataFrame, label: str, bins: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``_y``, a ``_bin_<feature>`` per feature, and ``_n`` rows: one
    map-side-combined aggregate."""
    rows = df.select(*keep, F.col(label).cast("long").alias("_y"), *[b.alias(f"_bin_{f}") for f, b in bins.items()])
    counts = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    # to text only now, once per combination instead of once per row
    return counts.select(*keep, "_y", *[F.col(f"_bin_{f}").cast("string").alias(f"_bin_{f}") for f in bins], "_n")


def log_odds_fit(counts: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``ln((pos+1)/(neg+1))`` per feature bin, from binned counts."""
    long = counts.select(*by, "_y", "_n", *[F.col(f"_bin_{f}").alias(f) for f in features]).unpivot(
        [*by, "_y", "_n"], list(features), "feature", "bin").where(F.col("bin").isNotNull())
    sums = long.groupBy(*by, "feature", "bin").agg(
        F.sum(F.col("_y") * F.col("_n")).alias("pos"), F.sum((1 - F.col("_y")) * F.col("_n")).alias("neg"))
    return sums.withColumn("weight", log_odds_weight())


def log_odds_weight() -> Column:
    return F.log((F.col("pos") + 1.0) / (F.col("neg") + 1.0))


# Up to this many models a weight is a column of its own, which keeps sums in
# generated code; beyond, generated code would grow too long, and the weights
# of a bin are one array. The sums are the same.
COLUMN_SLOTS = 16


def log_odds_slots(model: DataFrame, slots: int) -> DataFrame:
    """(feature, bin) -> columns w0, w1, ... or an array ``w``: one weight per
    slot (0 where a slot has none). One row per bin."""
    if slots <= COLUMN_SLOTS:
        return model.groupBy("feature", "bin").agg(*[
            F.coalesce(F.max(F.when(F.col("_slot") == i, F.col("weight"))), F.lit(0.0)).alias(f"w{i}") for i in range(slots)])
    found = F.map_from_entries(F.collect_list(F.struct("_slot", "weight")))  # an entry per model
    return model.groupBy("feature", "bin").agg(found.alias("_w")).select(
        "feature", "bin", F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.col("_w")[i], F.lit(0.0))).alias("w"))


def log_odds_score(counts: DataFrame, wide: DataFrame, features: Sequence[str], slots: int, into: str = "_scores") -> DataFrame:
    """Scores of binned rows under all slots, as one array; unseen bins add 0.

    One join per feature against a table with one row per bin, so rows are
    neither unpivoted nor shuffled while the bins are few.
    """
    out = counts
    sizes = sizes_by(wide, "feature")
    columns = slots <= COLUMN_SLOTS
    totals = [F.lit(0.0)] * slots
    total = F.array_repeat(F.lit(0.0), slots)
    for f in features:
        weights = [F.col(f"w{i}").alias(f"_w_{f}_{i}") for i in range(slots)] if columns else [F.col("w").alias(f"_w_{f}")]
        side = small_side(wide.where(F.col("feature") == f).select(F.col("bin").alias(f"_k_{f}"), *weights), counted=sizes.get(f, 0))
        out = out.join(side, out[f"_bin_{f}"] == side[f"_k_{f}"], "left")
        if columns:
            totals = [t + F.coalesce(F.col(f"_w_{f}_{i}"), F.lit(0.0)) for i, t in enumerate(totals)]
        else:
            total = F.when(F.col(f"_w_{f}").isNull(), total).otherwise(F.zip_with(total, F.col(f"_w_{f}"), lambda t, w: t + w))
            out = out.withColumn(f"_sum_{f}", total).drop(f"_w_{f}")
            total = F.col(f"_sum_{f}")
    # Nine digits: sums that are equal but for the last bits must tie.
    tidy = lambda t: F.floor(t * 1e9 + 0.5).cast("double") / 1e9
    return out.select(*counts.columns, (F.array(*[tidy(t) for t in totals]) if columns else F.transform(total, tidy)).alias(into))


def log_odds_auc(parts: DataFrame, label: str, bins: dict[str, Column], split: str = "split", train: str = "train") -> DataFrame:
    """Fit on the train part, AUC of every part."""
    counts = freeze(binned(parts, label, bins, [split]))
    model = log_odds_fit(counts.where(F.col(split) == train), list(bins)).withColumn("_slot", F.lit(0))
    scored = log_odds_score(counts, freeze(log_odds_slots(model, 1)), list(bins), 1)
    return auc(scored.withColumn("_s", F.get("_scores", F.lit(0))), "_s", "_y", [split], weight="_n")


# ---------------------------------------------------------------- tree models

# Bins of a feature, one of them for missing values; a learner that looks at histograms sees no more of it.
TREE_BINS = 64
# Distinct training rows of one part of the training layout.
PART_ROWS = 50_000
# A category's code is drawn towards the mean of all rows as if it had so many more rows.
PRIOR_ROWS = 10.0


def _features(train: DataFrame, target: str, ignore: Sequence[str]):
    """A function that turns a frame into label, feature columns and their
    vector, fitted on train.

    A category's code is its smoothed target mean, which puts categories in the
    order that a split of a 0/1 target needs, however many there are. Null and
    unseen categories share a code below all others.
    """
    texts = string_columns(train, exclude=[target, *ignore])
    numbers = numeric_columns(train, exclude=[target, *ignore])
    if not texts and not numbers:
        raise ValueError("no feature columns")
    coder = None
    if texts:
        prior = train.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
        fitted = te_fit(train, target, texts)
        smooth = (F.col("mean") * F.col("n") + F.lit(prior * PRIOR_ROWS)) / (F.col("n") + F.lit(PRIOR_ROWS))
        coder = EncoderTable(fitted.table.withColumn("mean", smooth), fitted.columns)

    def prepare(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        extra = [c for c in extra if c not in texts + numbers]
        kept = df.select(*extra, F.col(target).cast("double").alias("_label"),
                         *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in numbers], *texts)
        out = coder.apply(kept) if coder else kept
        out = out.fillna(-1.0, [c + ENCODED for c in texts]) if texts else out
        return VectorAssembler(inputCols=[*[c + ENCODED for c in texts], *numbers], outputCol="_features", handleInvalid="keep").transform(out)

    prepare.columns = [*[c + ENCODED for c in texts], *numbers]
    return prepare


def training_layout(prepared: DataFrame) -> DataFrame:
    """``(_label, _features, _n)``: equal rows once, with their number as a
    weight, in parts and an order that follow from the rows alone, and written
    once for all rounds. Neither the cores nor the layout of the input change
    what a learner sees, and copies that a third of all rows are make one row.
    """
    columns = [c for c in prepared.columns if c not in ("_features", "_n")]
    rows = F.sum("_n") if "_n" in prepared.columns else F.count(F.lit(1))
    distinct = freeze(prepared.groupBy(*columns).agg(rows.cast("double").alias("_n"), F.first("_features").alias("_features")))
    parts = max(8, -(-distinct.count() // PART_ROWS))
    place = F.xxhash64(*columns)
    return freeze(distinct.repartition(parts, place).sortWithinPartitions(place, *columns).select("_label", "_features", "_n"))


def _one_class(train: DataFrame, target: str) -> bool:
    return train.select(F.col(target).cast("double")).distinct().limit(2).count() < 2


class TreeModel:
    """Trees on bins.

    A learner sees a feature by its bins alone, so rows are counted by their
    combination of bins; what is repeated for every round and level, and the
    scoring, works on those counts. All training rows take part in the cuts
    between bins and in the counts.
    """

    def __init__(self, train: DataFrame, target: str, model: str = "boosted", rounds: int = 20, depth: int = 6,
                 ignore: Sequence[str] = ()):
        self.prepare = _features(train, target, ignore)
        self.one_class, self.cuts, self.fitted = _one_class(train, target), {}, None
        shared = {"labelCol": "_label", "featuresCol": "_features", "weightCol": "_n", "maxBins": TREE_BINS, "seed": 5}
        if model == "boosted":
            self.learner = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, checkpointInterval=10, **shared)
        elif model == "tree":
            self.learner = DecisionTreeClassifier(maxDepth=depth, **shared)
        elif not self.one_class:
            raise ValueError(f"unknown classifier: {model}")
        if not self.one_class:
            self.cuts = value_cuts(self.prepare(train.where(F.col(target).isNotNull())), self.prepare.columns, TREE_BINS - 1)

    def counts(self, df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        """``extra``, ``_label``, ``_features`` (the bins) and ``_n`` rows."""
        prepared = self.prepare(df, extra)
        if self.one_class:
            return prepared.groupBy(*[c for c in extra if c in prepared.columns], "_label").agg(F.count(F.lit(1)).alias("_n"))
        counted = bin_counts(prepared, self.cuts, [*[c for c in extra if c in prepared.columns], "_label"])
        names = [f"_b{i}" for i in range(len(self.cuts))]
        return VectorAssembler(inputCols=names, outputCol="_features").transform(counted)

    def fit(self, counts: DataFrame) -> TreeModel:
        if not self.one_class:
            self.fitted = self.learner.fit(training_layout(counts.where(F.col("_label").isNotNull())))
        return self

    def score(self, counts: DataFrame) -> DataFrame:
        """``counts`` with the probability ``_p``."""
        if self.one_class:
            # nothing to learn: every row gets the same score
            return counts.withColumn("_p", F.lit(0.5))
        return self.fitted.transform(counts).withColumn("_p", vector_to_array("probability")[1])


def fit_predict(train: DataFrame, target: str, model: str = "boosted", rounds: int = 20, depth: int = 6,
                ignore: Sequence[str] = ()):
    """Train on ``train``; returns ``score(df, extra) -> df`` with ``extra``, ``_label``,
    ``_p``, and ``_n``, the number of rows that a row stands for."""
    trees = TreeModel(train, target, model, rounds, depth, ignore)
    trees.fit(trees.counts(train))
    return lambda df, extra=(): trees.score(trees.counts(df, extra))


def tstr_score(synthetic: DataFrame, real: DataFrame, target: str, *, by: Sequence[str] = (), model: str = "boosted",
               rounds: int = 20, depth: int = 6, ignore: Sequence[str] = ()) -> DataFrame:
    """Train on synthetic rows, AUC on real rows (per ``by`` group)."""
    score = fit_predict(synthetic, target, model, rounds, depth, [*ignore, *by])
    return auc(score(real, by), "_p", "_label", by, weight="_n")


def score_trainval(parts: DataFrame, target: str, *, split: str = "split", train: str = "train",
                   model: str = "boosted", rounds: int = 20, depth: int = 6, ignore: Sequence[str] = ()) -> DataFrame:
    """AUC and row count of every split of one frame, trained on its train part."""
    trees = TreeModel(parts.where(F.col(split) == train), target, model, rounds, depth, [*ignore, split])
    counts = freeze(trees.counts(parts, [split]))  # one count for training and scoring
    trees.fit(counts.where(F.col(split) == train).drop(split))
    out = auc(trees.score(counts), "_p", "_label", [split], weight="_n")
    guarded = F.when((F.col(split) == train) & F.col("auc").isNull(), F.lit(0.5)).otherwise(F.col("auc"))
    return out.select(split, (F.col("positives") + F.col("negatives")).alias("rows"), guarded.alias("auc"))


def tree_score(train: DataFrame, test: DataFrame, target: str, depth: int = 10, ignore: Sequence[str] = ()) -> DataFrame:
    """One decision tree on label-encoded columns; train and test AUC."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return score_trainval(both, target, model="tree", depth=depth, ignore=ignore)


def per_source_score(sources: DataFrame, real: DataFrame, label: str, bins: dict[str, Column],
                     source: Sequence[str] = ("source",), split: str = "split") -> DataFrame:
    """AUC of every source (and variant) on every real split, in one job.

    Every source gets its own weights; real rows, counted by bins, are scored
    under all of them at once and only then spread out by source.
    """
    features = list(bins)
    model = freeze(log_odds_fit(binned(sources, label, bins, source), features, by=list(source)))
    names = [tuple(r) for r in model.select(*source).distinct().orderBy(*source).collect()]
    slot = real.sparkSession.createDataFrame(
        [(i, *n) for i, n in enumerate(names)], model.select(F.lit(0).alias("_slot"), *source).schema)  # a row per source
    same = [model[c].eqNullSafe(slot[c]) for c in source]
    placed = model.join(F.broadcast(slot), reduce(and_, same)).select("feature", "bin", "weight", "_slot")
    wide = freeze(log_odds_slots(placed, len(names)))
    scored = log_odds_score(binned(real, label, bins, [split]), wide, features, len(names))
    # outer: the arrays are never empty, and no filter has to check that
    flat = scored.select(split, "_y", "_n", F.posexplode_outer("_scores").alias("_slot", "_s"))
    out = auc(flat, "_s", "_y", ["_slot", split], weight="_n")
    return out.join(F.broadcast(slot), "_slot").select(*source, split, "auc")  # a row per source
