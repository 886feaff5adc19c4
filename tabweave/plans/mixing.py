"""Mixtures, searches and trial histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import mixture, search
from tabweave.operators.sample import split3
from tabweave.plans.inputs import (
    EXPERIMENTS, KEY, METHODS, NUMERIC, SOURCES, SPLIT, TRIALS, auc_sql, bins, chain_sql, experiments, hash_sql,
    joins_sql, labelled, long_bins_sql, sources, trials, uniform_sql)
from tabweave.plans.inputs import table as read
from tabweave.session import freeze, store


def _weights(spark: SparkSession, folder: str, cand: str) -> DataFrame:
    """A weight per candidate and source: the rows they share."""
    ordinal = F.least("l_linenumber", F.lit(4))
    return read(spark, folder, "lineitem").groupBy(F.col(cand).alias("cand"), ordinal.alias("ordinal")).agg(
        F.count(F.lit(1)).cast("double").alias("alpha")).withColumn("source", F.concat(F.lit("s"), F.col("ordinal").cast("string")))


def _sized(spark: SparkSession, folder: str, cand: str) -> DataFrame:
    """Mixtures of two thirds of all rows, so that uneven weights exhaust some of the unequal sources."""
    weights = mixture.mix_normalise(_weights(spark, folder, cand))
    counts = mixture.source_counts(sources(spark, folder))
    return mixture.mix_size(weights, counts, counts.agg(F.sum("rows")).first()[0] * 2 // 3)


def mix_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix_normalise(_weights(spark, folder, "l_suppkey")).select("cand", "ordinal", "source", F.round("alpha", 9).alias("alpha"))


def mix_augment(spark: SparkSession, folder: str) -> DataFrame:
    out = mixture.mix_augment(_weights(spark, folder, "l_suppkey").select("cand", "ordinal", "source", "alpha"), 0.2)
    return out.select("cand", "ordinal", "source", F.round("alpha", 9).alias("alpha"))


def mix_size(spark: SparkSession, folder: str) -> DataFrame:
    return _sized(spark, folder, "l_suppkey").select("cand", "source", "size")


def mix_draw(spark: SparkSession, folder: str) -> DataFrame:
    """One mixture per return flag."""
    sizes = freeze(_sized(spark, folder, "l_returnflag"))
    return mixture.mix_draw(sources(spark, folder), sizes, KEY).select("cand", "source", *KEY)


def join_rank_range(spark: SparkSession, folder: str) -> DataFrame:
    """The same join, reduced to what each mixture holds."""
    sizes = freeze(_sized(spark, folder, "l_returnflag"))
    drawn = mixture.mix_draw(sources(spark, folder), sizes, KEY)
    return drawn.groupBy("cand", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("ones"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method")).cast("int")
    return experiments(spark, folder).select(
        "data", "experiment", F.col("method").alias("source"), place.alias("ordinal"),
        F.col("untuned_val_auc").alias("auc"), "tuned_val_auc")


def mix_warmstart(spark: SparkSession, folder: str) -> DataFrame:
    out = mixture.mix_warmstart(_scores(spark, folder).drop("tuned_val_auc"), by=["data", "experiment"])
    return out.select("data", "experiment", "source", F.round("alpha", 9).alias("alpha"))


def mix_corner(spark: SparkSession, folder: str) -> DataFrame:
    scores = _scores(spark, folder)
    warm = mixture.mix_warmstart(scores.drop("tuned_val_auc"), by=["data", "experiment"])
    # some probes beat the best single source, some do not
    probe = scores.groupBy("data", "experiment").agg((F.max("tuned_val_auc") * 1.15).alias("probe"))
    out = mixture.mix_corner(warm, probe, ["data", "experiment"])
    return out.select("data", "experiment", "source", F.round("alpha", 9).alias("alpha"))


def _real(spark: SparkSession, folder: str) -> DataFrame:
    return split3(labelled(spark, folder), KEY).where("split <> 'train'")


def mix_score(spark: SparkSession, folder: str) -> DataFrame:
    """A batch of mixtures (one per return flag) scored together."""
    sizes = freeze(_sized(spark, folder, "l_returnflag").withColumn(
        "cand", F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("cand")).cast("int")))
    out = search.score_candidates(sources(spark, folder), _real(spark, folder), "label", bins(), sizes, KEY)
    return out.select("cand", "split", F.round("auc", 9).alias("auc"))


# two whole batches; the patience is beyond the first
SEARCH = {"batch": 16, "max_trials": 32, "patience": 20, "reach": 0.3}


def _search(spark: SparkSession, folder: str, **more: int) -> search.SearchResult:
    rows = store(sources(spark, folder))
    size = mixture.source_counts(rows).agg(F.sum("rows")).first()[0] // 2
    return search.mix_search(rows, store(_real(spark, folder)), "label", bins(), KEY, size=size, **SEARCH, **more)


def mix_search(spark: SparkSession, folder: str) -> DataFrame:
    history = _search(spark, folder).history
    return history.select("trial", *[F.round(c, 9).alias(c) for c in history.columns if c != "trial"])


def mix_search_trees(spark: SparkSession, folder: str) -> DataFrame:
    """The best two trials of the search under boosted trees, validation and test AUC."""
    return _search(spark, folder, promote=2).promoted


def hp_search(spark: SparkSession, folder: str) -> DataFrame:
    """All copula settings, judged by the log-odds scorer on validation rows."""
    parts = freeze(split3(labelled(spark, folder), KEY))
    out = search.copula_search(parts.where("split = 'train'"), parts, "label", bins(), NUMERIC, ["l_linestatus"])
    return out.withColumn("val_auc", F.round("val_auc", 9))


def best_trial(spark: SparkSession, folder: str) -> DataFrame:
    return search.best_trial(trials(spark, folder), "score", ["ts", "event_id"], ["user_id"]).select("user_id", "event_id", "score")


def best_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return search.best_so_far(trials(spark, folder), "score", ["ts", "event_id"], ["user_id"]).drop("ts")


def early_stop(spark: SparkSession, folder: str) -> DataFrame:
    return search.early_stop(trials(spark, folder), "score", ["ts", "event_id"], ["user_id"], patience=10).drop("ts")


def early_stop_percent(spark: SparkSession, folder: str) -> DataFrame:
    return search.early_stop(trials(spark, folder), "score", ["ts", "event_id"], ["user_id"], patience=1, percent=5.0).select(
        "user_id", "event_id", "trial", "stopped")


def history(spark: SparkSession, folder: str) -> DataFrame:
    old = experiments(spark, folder).select("data", "method", "experiment", F.col("untuned_val_auc").alias("val_auc"))
    new = experiments(spark, folder).select("data", "method", "experiment", F.col("tuned_val_auc").alias("val_auc"), F.lit(0.2).alias("alpha_5"))
    return search.history(old, new)


QUERIES = {f.__name__: f for f in (
    mix_normalise, mix_augment, mix_size, mix_draw, join_rank_range, mix_warmstart, mix_corner, mix_score, mix_search, mix_search_trees,
    hp_search, best_trial, best_so_far, early_stop, early_stop_percent, history)}

_K = ", ".join(KEY)


def _cand(column: str) -> str:
    return f"""(SELECT {column} AS cand, concat('s', least(l_linenumber, 4)) AS source, least(l_linenumber, 4) AS ordinal,
      count(*)::DOUBLE AS alpha FROM lineitem GROUP BY ALL)"""


def _normal(column: str) -> str:
    return f"""(SELECT cand, ordinal, source, 1.0::DOUBLE / ((sum(alpha) OVER (PARTITION BY cand)) / 1.0::DOUBLE) * alpha AS alpha
      FROM {_cand(column)} c)"""


def _sizes(column: str) -> str:
    return _sizes_of(_normal(column), "sum(rows) * 2 // 3")


def _sizes_of(weights: str, goal: str) -> str:
    return f"""(WITH n AS (SELECT source, count(*) AS rows FROM {SOURCES} s GROUP BY source),
      a AS (SELECT c.*, n.rows, (SELECT {goal} FROM n)::BIGINT AS goal FROM {weights} c JOIN n USING (source)),
      b AS (SELECT *, goal - coalesce(sum(rows) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
          sum(alpha) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
        FROM a WINDOW fill AS (PARTITION BY cand ORDER BY coalesce(rows / nullif(alpha, 0.0::DOUBLE), 'Infinity'::DOUBLE), ordinal)),
      d AS (SELECT *, alpha > 0 AND rows * weights < alpha * left_over AS is_full FROM b),
      e AS (SELECT *, CASE WHEN is_full THEN rows WHEN bool_or(is_full) OVER c
          THEN coalesce(floor(alpha * (goal - sum(CASE WHEN is_full THEN rows END) OVER c)
            / nullif(sum(CASE WHEN NOT is_full THEN alpha END) OVER c, 0.0::DOUBLE) + 1e-9::DOUBLE), 0)
          ELSE floor(alpha * goal) END::BIGINT AS base FROM d WINDOW c AS (PARTITION BY cand)),
      f AS (SELECT *, least(base, rows) AS base2, goal - sum(least(base, rows)) OVER (PARTITION BY cand) AS rest FROM e)
      SELECT cand, source, (base2 + least(rows - base2, greatest(rest - coalesce(sum(rows - base2) OVER (
        PARTITION BY cand ORDER BY alpha DESC, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)))::BIGINT AS size FROM f)"""


_RANKED = f"""(SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('-', {_K}, source, '5'))) AS rn FROM {SOURCES} s)"""
_DRAWN = f"(SELECT z.cand, r.* FROM {_RANKED} r JOIN {_sizes('l_returnflag')} z ON z.source = r.source AND r.rn <= z.size)"
_WARM = f"""(SELECT data, experiment, method, lift / sum(lift) OVER (PARTITION BY data, experiment) AS alpha, untuned_val_auc, tuned_val_auc
  FROM (SELECT *, untuned_val_auc - min(untuned_val_auc) OVER (PARTITION BY data, experiment) + 0.001::DOUBLE AS lift FROM {EXPERIMENTS} e))"""
_MODEL = "ln((sum(label) + 1.0::DOUBLE) / (sum(1 - label) + 1.0::DOUBLE))"


def _batch(name: str, drawn: str) -> str:
    """CTEs ``{name}_*`` that score every ``cand`` of the table ``drawn``; needs ``parts``."""
    features = f"{', '.join(NUMERIC)}, l_linestatus"
    return f"""{name}_w AS MATERIALIZED (SELECT cand, feature, bin, {_MODEL} AS weight FROM ({long_bins_sql(drawn, 'cand')}) GROUP BY ALL),
  {name}_eval AS (SELECT cand, split, label, {features} FROM parts CROSS JOIN (SELECT DISTINCT cand FROM {drawn}) WHERE split <> 'train'
    UNION ALL SELECT cand, 'train', label, {features} FROM {drawn}),
  {name}_auc AS MATERIALIZED ({auc_sql(f"SELECT r.cand, r.split, r.label AS y, {chain_sql()} AS s FROM {name}_eval r " + joins_sql(f'{name}_w', 'AND w_{f}.cand = r.cand'), 'cand, split')})"""


_MIX_SCORE = f"""WITH parts AS MATERIALIZED {SPLIT},
  drawn AS MATERIALIZED (SELECT * REPLACE (list_position(['A', 'N', 'R'], cand)::INTEGER AS cand) FROM {_DRAWN}),
  {_batch('m', 'drawn')} SELECT cand, split, round(auc, 9) AS auc FROM m_auc"""


def _search_batch(name: str, raw: str) -> str:
    """CTEs of one batch of the search: ``{name}`` has a row per candidate, with
    its weights (a list), and its AUC on the three splits."""
    return f"""{name}_a AS MATERIALIZED (SELECT cand, ordinal, source, 1.0::DOUBLE / (sum(alpha) OVER (PARTITION BY cand) / 1.0::DOUBLE) * alpha AS alpha
    FROM ({raw})),
  {name}_z AS MATERIALIZED {_sizes_of(f'{name}_a', 'sum(rows) // 2')},
  {name}_d AS MATERIALIZED (SELECT z.cand, r.* FROM ranked r JOIN {name}_z z ON z.source = r.source AND r.rn <= z.size),
  {_batch(name, f'{name}_d')},
  {name} AS MATERIALIZED (SELECT cand, any_value(alphas) AS alphas, {', '.join(f"coalesce(max(CASE WHEN split = '{s}' THEN auc END), 0.5::DOUBLE) AS {s}" for s in ('train', 'val', 'test'))}
    FROM {name}_auc JOIN (SELECT cand, list(alpha ORDER BY ordinal) AS alphas FROM {name}_a GROUP BY cand) USING (cand) GROUP BY cand)"""


_N, _ALL = SEARCH["batch"], SEARCH["max_trials"]


def _hashed(first: int, end: int) -> str:
    return f"""(SELECT cand, ordinal, source, {uniform_sql(hash_sql(['cand', 'source'], 5), 0)} AS u
      FROM lone, (SELECT unnest(range({first}, {end + 1}))::INTEGER AS cand))"""


_MIX_SEARCH = f"""WITH parts AS MATERIALIZED {SPLIT}, ranked AS MATERIALIZED {_RANKED},
  single AS (SELECT source AS cand, * FROM {SOURCES} s), {_batch('s', 'single')},
  lone AS MATERIALIZED (SELECT cand AS source, row_number() OVER (ORDER BY cand)::INTEGER AS ordinal, coalesce(auc, 0.5::DOUBLE) AS auc FROM s_auc WHERE split = 'val'),
  lifted AS (SELECT *, auc - min(auc) OVER () + 0.001::DOUBLE AS lift, row_number() OVER (ORDER BY auc DESC, ordinal) AS top FROM lone),
  {_search_batch('b1', f"""SELECT 0 AS cand, ordinal, source, floor((1.0::DOUBLE / (sum(lift) OVER () / 1.0::DOUBLE) * lift) * {search.GRAIN})::DOUBLE AS alpha FROM lifted
    UNION ALL SELECT 1, ordinal, source, CASE WHEN top = 1 THEN {search.GRAIN} ELSE 0 END::DOUBLE FROM lifted
    UNION ALL SELECT cand, ordinal, source, greatest(floor(u * {search.GRAIN}), 1)::DOUBLE FROM {_hashed(2, _N)}""")},
  t1 AS MATERIALIZED (SELECT greatest(cand, 1) AS trial, * EXCLUDE (cand) FROM b1
    WHERE cand <> CASE WHEN (SELECT val FROM b1 WHERE cand = 0) > (SELECT max(auc) FROM lone) THEN 1 ELSE 0 END),
  best AS (SELECT alphas FROM t1 ORDER BY val DESC, trial LIMIT 1),
  {_search_batch('b2', f"""SELECT cand, ordinal, source, greatest(floor(alphas[ordinal] * {search.GRAIN})
      + floor((2 * u - 1) * {SEARCH['reach'] * search.GRAIN}::DOUBLE), 1)::DOUBLE AS alpha FROM {_hashed(_N + 1, _ALL)}, best""")},
  t AS (SELECT * FROM t1 UNION ALL SELECT cand, * EXCLUDE (cand) FROM b2),
  h AS (SELECT *, max(CASE WHEN 1 - val < before THEN trial ELSE 0 END) OVER (ORDER BY trial) AS hit
    FROM (SELECT *, min(1 - val) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t))
  SELECT trial, {', '.join(f'round(alphas[{j}], 9) AS alpha_{j}' for j in range(1, 5))}, {', '.join(f'round({s}, 9) AS {s}_auc' for s in ('train', 'val', 'test'))}
  FROM h WHERE trial <= (SELECT coalesce(min(trial), {_ALL}) FROM h WHERE trial > 1 AND trial - hit >= {SEARCH['patience']})"""

_LINE = "PARTITION BY user_id ORDER BY ts, event_id"
ORACLES = {
    "mix_normalise": f"SELECT cand, ordinal, source, round(alpha, 9) AS alpha FROM {_normal('l_suppkey')} n",
    "mix_augment": f"""WITH c AS {_cand('l_suppkey')} SELECT cand, ordinal, source,
        round(1.0::DOUBLE / (sum(alpha) OVER (PARTITION BY cand) / (1.0::DOUBLE - 0.2::DOUBLE)) * alpha, 9) AS alpha FROM c
      UNION ALL SELECT DISTINCT cand, 5, 'real', 0.2::DOUBLE FROM c""",
    "mix_size": f"SELECT cand, source, size FROM {_sizes('l_suppkey')} z",
    "mix_draw": f"SELECT cand, source, {_K} FROM {_DRAWN} d",
    "join_rank_range": f"SELECT cand, source, count(*) AS rows, sum(label)::BIGINT AS ones FROM {_DRAWN} d GROUP BY ALL",
    "mix_warmstart": f"SELECT data, experiment, method AS source, round(alpha, 9) AS alpha FROM {_WARM} w",
    "mix_corner": f"""SELECT data, experiment, method AS source, round(CASE WHEN probe > best THEN alpha
        WHEN top = 1 THEN 1.0 ELSE 0.0 END, 9)::DOUBLE AS alpha
      FROM (SELECT *, max(tuned_val_auc) OVER g * 1.15::DOUBLE AS probe, max(untuned_val_auc) OVER g AS best,
          row_number() OVER (PARTITION BY data, experiment ORDER BY untuned_val_auc DESC, method) AS top
        FROM {_WARM} w WINDOW g AS (PARTITION BY data, experiment))""",
    "mix_score": _MIX_SCORE,
    "mix_search": _MIX_SEARCH,
    "best_trial": f"""SELECT user_id, event_id, score FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id ORDER BY score DESC, ts, event_id) AS rn FROM {TRIALS} t) WHERE rn = 1""",
    "best_so_far": f"SELECT user_id, event_id, score, max(score) OVER ({_LINE}) AS best FROM {TRIALS} t",
    "early_stop": f"""WITH a AS (SELECT *, row_number() OVER ({_LINE}) AS trial, 1.0::DOUBLE - score AS loss FROM {TRIALS} t),
      b AS (SELECT *, min(loss) OVER ({_LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM a),
      c AS (SELECT *, max(CASE WHEN loss < best THEN trial ELSE 0 END) OVER ({_LINE}) AS hit FROM b)
      SELECT user_id, event_id, score, trial, trial - hit AS since,
        bool_or(trial > 1 AND trial - hit >= 10) OVER ({_LINE}) AS stopped FROM c""",
    "early_stop_percent": f"""WITH a AS (SELECT *, row_number() OVER ({_LINE}) AS trial, 1.0::DOUBLE - score AS loss FROM {TRIALS} t),
      b AS (SELECT *, lag(loss) OVER ({_LINE}) AS best FROM a)
      SELECT user_id, event_id, trial, bool_or(trial > 1 AND NOT loss < best - abs(best) * (5.0::DOUBLE / 100.0::DOUBLE)) OVER ({_LINE}) AS stopped FROM b""",
    "history": f"""SELECT data, method, experiment, untuned_val_auc AS val_auc, NULL::DOUBLE AS alpha_5 FROM {EXPERIMENTS} e
      UNION ALL SELECT data, method, experiment, tuned_val_auc, 0.2::DOUBLE FROM {EXPERIMENTS} e""",
}
