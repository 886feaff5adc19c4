"""Searching mixture weights and generator settings in batches, and reading
the history of trials."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.functions.hashing import row_hash, uniform
from tabweave.functions.ordered import ONE_TASK_ROWS, carry, layout, running
from tabweave.operators.generate import MEMBER, draw_class_families, draw_family, fit_classes, fit_copula, thinned
from tabweave.operators.mixture import (
    REAL, candidate_cuts, mix_augment, mix_draw, mix_normalise, mix_size, mix_warmstart, source_counts)
from tabweave.operators.sample import HASH, step, with_hash
from tabweave.operators.score import (
    auc, binned, log_odds_fit, log_odds_score, log_odds_slots, log_odds_weight, per_source_score, tstr_score)
from tabweave.session import freeze, store

# ---------------------------------------------------------------- scoring a batch


def candidate_table(spark: SparkSession, weights: Sequence[Sequence[float]], sources: Sequence[str], first: int = 1) -> DataFrame:
    """Weight vectors as a long table ``(cand, ordinal, source, alpha)``."""
    rows = [(first + i, j + 1, s, float(w)) for i, vector in enumerate(weights) for j, (s, w) in enumerate(zip(sources, vector))]
    return spark.createDataFrame(rows, "cand int, ordinal int, source string, alpha double")


def score_candidates(
    sources: DataFrame, real: DataFrame, label: str, bins: dict[str, Column], sizes: DataFrame, key: Sequence[str],
    seed: object = 5, split: str = "split",
) -> DataFrame:
    """``(cand, split, auc)`` of every candidate on its own rows (``train``) and
    on every split of ``real``, with the log-odds scorer."""
    return score_batch(sources, binned(real, label, bins, [split]).withColumnRenamed(split, "split"),
                       label, bins, sizes, key, seed)


def score_batch(sources: DataFrame, real_counts: DataFrame, label: str, bins: dict[str, Column], sizes: DataFrame,
                key: Sequence[str] | None, seed: object = 5) -> DataFrame:
    """The same with the real rows already binned, and without ``key`` the
    source rows with their hash.

    The work does not grow with candidates times rows: a source row is placed
    in the interval between two neighbouring cuts of its source and counted
    there by bins, once; a candidate's rows are the counts of the intervals up
    to its own cut. Only counts are scored.
    """
    spark = sources.sparkSession
    features = list(bins)
    hashed = sources if key is None else with_hash(sources, [*key, "source"], seed)
    cuts = candidate_cuts(hashed, sizes)
    for _, c in cuts:
        if c.splits_copies:
            raise ValueError("the key must identify a source row: a cut falls between rows with the same key")
    cands = sorted({c for c, _ in cuts})
    slots = {c: i for i, c in enumerate(cands)}

    # 1. interval of each row: how many distinct cuts of its source lie below it
    by_source: dict[str, list[str]] = {}
    for _, c in cuts:
        by_source.setdefault(c.group, []).append(c.hash)
    by_source = {s: sorted(set(h)) for s, h in by_source.items()}
    level = F.lit(None).cast("int")
    for s, hs in by_source.items():
        # a row at a cut belongs below it, and no hash digit reaches "g"
        level = F.when(F.col("source") == F.lit(s), step(F.col(HASH), [h + "g" for h in hs])).otherwise(level)
    counts = freeze(binned(hashed.withColumn("_level", level), label, bins, ["source", "_level"]))

    # 2. a candidate owns the intervals up to its own cut
    reach = spark.createDataFrame(  # a row per candidate and source
        [(slots[cand], c.group, by_source[c.group].index(c.hash)) for cand, c in cuts], "_slot int, source string, _upto int")
    owned = (F.col("_level") <= F.col("_upto"))
    per_level = log_odds_fit(counts, features, ["source", "_level"])
    model = per_level.join(F.broadcast(reach), "source").where(owned).groupBy("_slot", "feature", "bin").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("weight", log_odds_weight())
    wide = freeze(log_odds_slots(model, len(cands)))

    # 3. scores under all candidates at once
    def scores(frame: DataFrame, keep: Sequence[str]) -> DataFrame:
        scored = log_odds_score(frame, wide, features, len(cands))
        return scored.select(*keep, "_y", "_n", F.posexplode_outer("_scores").alias("_slot", "_s"))

    own = scores(counts, ["source", "_level"]).join(F.broadcast(reach), ["source", "_slot"]).where(owned)
    both = scores(real_counts, ["split"]).unionByName(own.select(F.lit("train").alias("split"), "_y", "_n", "_slot", "_s"))
    scored = auc(both, "_s", "_y", ["_slot", "split"], weight="_n")
    names = spark.createDataFrame([(i, c) for c, i in slots.items()], "_slot int, cand int")
    guarded = F.when((F.col("split") == "train") & F.col("auc").isNull(), F.lit(0.5)).otherwise(F.col("auc"))
    return scored.join(F.broadcast(names), "_slot").select("cand", "split", guarded.alias("auc"))


# ---------------------------------------------------------------- mixture search


@dataclass
class SearchResult:
    """``history`` has a row per trial with the AUC on every split of the real
    rows; ``best`` is the chosen trial's row. ``promoted`` holds what the
    boosted trees said of the best few, ``(trial, split, auc)``."""

    history: DataFrame
    best: dict[str, float]
    weights: dict[str, float]
    stopped_at: int
    promoted: DataFrame | None = None


# Raw weights are whole numbers, so their sums are exact in any order and any
# SQL engine draws the same candidates.
GRAIN = 1_000_000


def drawn_weights(spark: SparkSession, names: Sequence[str], first: int, count: int, seed: object,
                  center: Sequence[float] | None = None, reach: float = 0.3) -> DataFrame:
    """``(cand, ordinal, source, alpha)`` of candidates ``first, first + 1, ...``: raw
    weights from a hash of candidate and source, uniform, or within ``reach``
    of ``center`` (weights that add up to 1), at least one grain each."""
    listed = spark.range(first, first + count).select(
        F.col("id").cast("int").alias("cand"), F.posexplode(F.array(*[F.lit(n) for n in names])).alias("_at", "source"))
    u = uniform(row_hash(["cand", "source"], seed))
    if center is None:
        raw = F.floor(u * GRAIN)
    else:
        middle = F.get(F.array(*[F.lit(int(c * GRAIN)) for c in center]), F.col("_at"))
        raw = middle + F.floor((2 * u - 1) * (reach * GRAIN))
    return listed.select("cand", (F.col("_at") + 1).cast("int").alias("ordinal"), "source",
                         F.greatest(raw.cast("double"), F.lit(1.0)).alias("alpha"))


def no_progress(scores: Sequence[float], patience: int, percent: float = 0.0) -> int | None:
    """The 1-based trial after which a search stops, or None.

    The loss is 1 - score. A trial is progress if its loss undercuts the best
    one so far by more than ``percent``; the first trial counts as one without.
    """
    best, idle = None, 0
    for i, score in enumerate(scores, start=1):
        loss = 1.0 - score
        if best is None:
            best, idle = loss, 1
            continue
        if loss < best - abs(best * percent / 100.0):
            best, idle = loss, 0
        else:
            idle += 1
        if idle >= patience:
            return i
    return None


def mix_search(
    sources: DataFrame, real: DataFrame, label: str, bins: dict[str, Column], key: Sequence[str], *,
    size: int | None = None, augmented: float = 0.0, batch: int = 16, max_trials: int = 64, patience: int = 20,
    percent: float = 0.0, seed: int = 5, split: str = "split", objective: str = "val", reach: float = 0.3,
    promote: int = 0, rounds: int = 20, depth: int = 6, ignore: Sequence[str] = (),
) -> SearchResult:
    """Weights that maximise the validation AUC.

    Trial 1 starts warm, from the AUC of the single sources; if that mixture (the
    probe) does not beat the best single source, it is that source alone. The
    rest of the first batch is drawn uniformly, later batches around the best so
    far. A batch is scored as one set of Spark jobs; the driver keeps
    candidates and scores only. What the batches read (hash, label and bins of
    the source rows, counts of the real rows) is written once.

    The AUC on the other splits of ``real`` is reported and has no say. With
    ``promote`` that many of the best trials are drawn and given to boosted
    trees, and the best of them on the objective is the result.
    """
    spark = sources.sparkSession
    rows = freeze(source_counts(sources))
    names = sorted(r["source"] for r in rows.select("source").collect())
    synthetic = [n for n in names if n != REAL]
    if augmented > 0 and REAL not in names:
        raise ValueError(f"an augmented share needs a source named {REAL}")
    used = [*synthetic, REAL] if augmented > 0 else synthetic
    judge = real.where(F.col(split) != "train")
    judge_counts = freeze(binned(judge, label, bins, [split]).withColumnRenamed(split, "split"))
    slim = store(with_hash(sources, [*key, "source"], seed).select("source", HASH, label, *[b.alias(f"_in_{f}") for f, b in bins.items()]))
    slim_bins = {f: F.col(f"_in_{f}") for f in bins}
    single = per_source_score(slim.where(F.col("source") != REAL), judge.where(F.col(split) == objective).select(
        label, split, *[b.alias(f"_in_{f}") for f, b in bins.items()]), label, slim_bins, split=split)
    single = single.select("source", F.coalesce("auc", F.lit(0.5)).alias("auc"))
    alone = {r["source"]: (r["auc"], r["alpha"]) for r in mix_warmstart(freeze(single)).collect()}
    lone_auc = [alone[s][0] for s in synthetic]
    warm = [max(float(int(alone[s][1] * GRAIN)), 0.0) for s in synthetic]
    corner = [float(GRAIN) if i == lone_auc.index(max(lone_auc)) else 0.0 for i in range(len(synthetic))]

    def scored(raw: DataFrame) -> dict[int, tuple[list[float], dict[str, float]]]:
        """Weights and AUC by split of each candidate."""
        if augmented > 0:
            raw = mix_augment(raw, augmented, len(synthetic) + 1)
        table = freeze(mix_normalise(raw, augmented))
        sizes = freeze(mix_size(table, rows, size))
        out: dict[int, tuple[list[float], dict[str, float]]] = {}
        for r in table.orderBy("cand", "ordinal").collect():
            out.setdefault(r["cand"], ([], {}))[0].append(r["alpha"])
        for r in score_batch(slim, judge_counts, label, slim_bins, sizes, None, seed).collect():
            out[r["cand"]][1][r["split"]] = 0.5 if r["auc"] is None else float(r["auc"])
        return out

    trials: list[tuple[list[float], dict[str, float]]] = []
    value = lambda t: t[1].get(objective, 0.5)
    stop = None
    while len(trials) < max_trials and stop is None:
        first = len(trials) + 1
        count = min(batch, max_trials - len(trials))
        if first == 1:
            # candidate 0 is the probe; trial 1 is either the probe or the corner
            raw = candidate_table(spark, [warm, corner], synthetic, 0)
            if count > 1:
                raw = raw.unionByName(drawn_weights(spark, synthetic, 2, count - 1, seed))
            done = scored(raw)
            done[1] = done[0] if value(done[0]) > max(lone_auc) else done[1]
        else:
            top = max(trials, key=value)[0][: len(synthetic)]
            done = scored(drawn_weights(spark, synthetic, first, count, seed, [a / (1.0 - augmented) for a in top], reach))
        trials += [done[first + i] for i in range(count)]
        stop = no_progress([value(t) for t in trials], patience, percent)
    kept = trials[: stop or len(trials)]
    others = sorted({s for t in kept for s in t[1]} - {"train", objective})
    history = spark.createDataFrame(
        [(i, *t[0], t[1].get("train", 0.5), value(t), *[t[1].get(o) for o in others]) for i, t in enumerate(kept, start=1)],
        ", ".join(["trial int", *[f"alpha_{j + 1} double" for j in range(len(used))], "train_auc double",
                   f"{objective}_auc double", *[f"`{o}_auc` double" for o in others]]))
    top = max(range(len(kept)), key=lambda i: (value(kept[i]), -i))
    found = SearchResult(history, {}, dict(zip(used, kept[top][0])), len(kept))
    if promote:
        found.promoted = freeze(rescore(found, sources, judge, label, key, size=size, top=promote, split=split, rounds=rounds,
                                        depth=depth, ignore=ignore, seed=seed, score=f"{objective}_auc"))
        said = {(r["trial"], r["split"]): r["auc"] for r in found.promoted.collect()}
        judged = [t for t, s in said if s == objective and said[t, s] is not None]
        if judged:
            top = max(judged, key=lambda t: (said[t, objective], -t)) - 1
        found.weights = dict(zip(used, kept[top][0]))
        found.best = {f"tree_{s}_auc": auc for (t, s), auc in said.items() if t == top + 1}
    found.best |= {"trial": top + 1, **{f"{s}_auc": auc for s, auc in kept[top][1].items()}, "val_auc": value(kept[top])}
    return found


def rescore(found: SearchResult, sources: DataFrame, real: DataFrame, label: str, key: Sequence[str], *,
            size: int | None = None, top: int = 3, split: str = "split", rounds: int = 20, depth: int = 6,
            ignore: Sequence[str] = (), seed: object = 5, score: str = "val_auc") -> DataFrame:
    """Draw the best few mixtures of a search and score them with boosted
    trees: ``(trial, split, auc)``. ``top`` models are trained one by one."""
    spark = sources.sparkSession
    names = list(found.weights)
    alphas = [f"alpha_{j + 1}" for j in range(len(names))]
    best = found.history.orderBy(F.desc(score), "trial").limit(top).collect()
    rows = [(r["trial"], j + 1, s, float(r[a])) for r in best for j, (s, a) in enumerate(zip(names, alphas))]
    sizes = freeze(mix_size(spark.createDataFrame(rows, "cand int, ordinal int, source string, alpha double"),
                            freeze(source_counts(sources)), size))
    drawn = store(mix_draw(sources, sizes, key, seed).drop("source"))  # all mixtures in one pass
    out = None
    for r in best:
        part = tstr_score(drawn.where(F.col("cand") == r["trial"]).drop("cand"), real, label, by=[split], rounds=rounds, depth=depth, ignore=[*ignore, *key]).select(
            F.lit(r["trial"]).alias("trial"), F.col(split).alias("split"), "auc")
        out = part if out is None else out.unionByName(part)
    return out


def hp_search(settings: Sequence[Mapping[str, object]], evaluate: Callable[[Mapping[str, object]], float],
              spark: SparkSession, patience: int = 10) -> DataFrame:
    """Try generator settings in order (the first ones are the defaults) until
    ``patience`` trials bring no progress; a row per trial.

    ``evaluate`` fits, draws and scores one setting; each is a Spark job of its
    own over the whole training table, and returns one number.
    """
    scores: list[float] = []
    for s in settings:
        scores.append(float(evaluate(s)))
        if no_progress(scores, patience) is not None:
            break
    return _tried(spark, settings, scores)


def _tried(spark: SparkSession, settings: Sequence[Mapping[str, object]], scores: Sequence[float]) -> DataFrame:
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    rows = [(i + 1, ", ".join(f"{k}={v}" for k, v in settings[i].items()), score, i == 0, i == best)
            for i, score in enumerate(scores)]
    return spark.createDataFrame(rows, "trial int, setting string, val_auc double, untuned boolean, tuned boolean")


def copula_settings(grid: int = 101) -> list[dict[str, object]]:
    """All grids that ``grid`` can be thinned to, fitted on all rows and per class; the default first."""
    grids = [(grid - 1) // step + 1 for step in range(1, (grid - 1) // 2 + 1) if (grid - 1) % step == 0]
    return [{"grid": g, "by_class": by_class} for g in grids for by_class in (False, True)]


def copula_search(
    train: DataFrame, real: DataFrame, label: str, bins: dict[str, Column], numeric: Sequence[str], categorical: Sequence[str], *,
    settings: Sequence[Mapping[str, object]] | None = None, n: int | None = None, patience: int = 10, split: str = "split",
    objective: str = "val", seed: object = 5,
) -> DataFrame:
    """``hp_search`` over the settings of the copula, as one batch.

    All settings are fitted together: one fit of the finest grid on all rows
    and one per class, of which coarser grids are a part. ``n`` rows of each
    setting are drawn into one table with a ``setting`` column, and all their
    scorers are fitted and applied on counts by setting and bin. The label is
    one of the categories of the joint fit; a per-class fit keeps the class counts of ``train``.
    """
    spark = train.sparkSession
    settings = list(settings or copula_settings())
    finest = max(s["grid"] for s in settings)
    classes = {r[0]: r[1] for r in train.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(label).collect()}
    total = sum(classes.values())
    n = total if n is None else n
    joint, apart = None, {}
    if not all(s["by_class"] for s in settings):
        joint = fit_copula(train, numeric, [*categorical, label], finest)
    if any(s["by_class"] for s in settings):
        apart = fit_classes(train, F.col(label), list(classes), numeric, categorical, finest)
    # class counts add up to n: whole parts, the rest to the last class
    sizes = {v: count * n // total for v, count in classes.items()}
    sizes[list(classes)[-1]] += n - sum(sizes.values())
    # settings of one fit differ in their grids alone: one draw for all of them
    draws = None
    for by_class in (False, True):
        members = [i for i, s in enumerate(settings) if bool(s["by_class"]) == by_class]
        if not members:
            continue
        family = lambda m: [thinned(m, settings[i]["grid"]) for i in members]  # noqa: B023, E731
        if by_class:
            made = draw_class_families(spark, {v: family(m) for v, m in apart.items()}, sizes, label, train.schema[label].dataType, seed)
        else:
            made = draw_family(spark, family(joint), n, seed)
        number = F.get(F.lit(members), F.col(MEMBER))
        part = made.select(number.alias("setting"), *numeric, *categorical, label)
        draws = part if draws is None else draws.unionByName(part)
    judged = per_source_score(draws, real.where(F.col(split) == objective), label, bins, ["setting"], split)
    said = {r["setting"]: r["auc"] for r in judged.collect()}
    scores = [0.5 if said.get(i) is None else float(said[i]) for i in range(len(settings))]
    return _tried(spark, settings, scores[: no_progress(scores, patience)])


# ---------------------------------------------------------------- trial history


def history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append trials; columns only one side has are filled with null."""
    return old.unionByName(new, allowMissingColumns=True)


def best_trial(df: DataFrame, score: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The row with the highest score per series; the earliest one on a tie."""
    best = Window.partitionBy(*by).orderBy(F.desc(score), *order)
    # rank = 1 is pushed below the shuffle (WindowGroupLimit), so a series
    # sends one row per task however long it is
    return df.where(F.col(score).isNotNull()).withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def best_so_far(df: DataFrame, score: str, order: Sequence[str], by: Sequence[str] = (),
                one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Running maximum of the score along each series."""
    return running(df, by, order, {"best": ("max", score)}, one_task_rows=one_task_rows)


def early_stop(df: DataFrame, score: str, order: Sequence[str], by: Sequence[str] = (), patience: int = 10,
               percent: float = 0.0, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Number the trials of each series, count the trials since the last
    progress, and flag the trials from the stopping one on.

    With a percentage the best loss only moves on progress, so each row
    depends on the whole past; with patience 1 a search ends at the first
    trial without progress, until when the best is the trial before. Those are
    the two settings in use; others need the sequential ``no_progress``.
    """
    if percent and patience != 1:
        raise ValueError("a percentage needs patience 1")
    # One layout of the order serves all running values.
    base = df.withColumn("_loss", 1.0 - F.col(score)).withColumn("_one", F.lit(1).cast("long"))
    laid = layout(base, by, order, one_task_rows=one_task_rows)
    if percent:
        laid = laid.withColumn("_me", F.struct(*order, "_loss"))
        first = carry(laid, by, order, {"_before": ("max", "_me"), "_done": ("sum", "_one")}, include_current=False)
        first = first.withColumn("_best", F.col("_before")["_loss"])
    else:
        first = carry(laid, by, order, {"_best": ("min", "_loss"), "_done": ("sum", "_one")}, include_current=False)
    progress = F.col("_loss") < F.col("_best") - F.abs(F.col("_best")) * F.lit(percent / 100.0)
    marked = first.withColumn("trial", F.col("_done") + 1).withColumn("_hit", F.when(progress, F.col("trial")).otherwise(F.lit(0).cast("long")))
    idle = carry(marked, by, order, {"_last": ("max", "_hit")}).withColumn("since", F.col("trial") - F.col("_last"))
    stops = idle.withColumn("_stop", ((F.col("trial") > 1) & (F.col("since") >= patience)).cast("long"))
    done = carry(stops, by, order, {"_stopped": ("max", "_stop")})
    return done.select(*df.columns, "trial", "since", (F.col("_stopped") == 1).alias("stopped"))
