"""Mixing sources to target weights by repetition rates.

``mix`` aggregates the sizes of all documents per source, derives how often a
source has to be repeated to meet its target, and takes each document
``floor(rate)`` times plus one more time with a probability equal to the
fraction, decided by a hash of the document.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a source whose documents are all empty has target 0 and is
taken once (its rows carry no words); repeated rows are decided alike, because
the hash sees only doc_id and seed, or the text of a row without doc_id; an empty table gives an empty result;
further columns are carried along and never read. ``mix`` replaces columns of the
names that it adds; ``mixed_documents`` returns them as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabweave.llm.frames import aside, keep, table, word_count
from tabweave.session import small_side

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix"
NAMES = ("_mix_size", "_mix_source", "_mix_source_size", "_mix_target", "_mix_rate")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """Target and rate of every source.

    ``sizes`` has a row per source: source, source_size. Weights go round in
    code point order of the sources, null last. A target is at most ``most``
    times its source; what is cut off goes to the other sources by weight until
    none is above. That filling is solved without rounds: a source is full when
    the common level ``lambda`` reaches ``most * size / weight``, so sorting by
    that ratio and running two sums gives the level at which all is handed out.
    The table has a row per source, not per document; the two windows over it
    run in one task, which holds for as many sources as fit a sort on disk.
    """
    spot = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("spot"), F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "spot")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = (sizes.withColumn("spot", spot).withColumn("weight", weight)
           .withColumn("room", F.lit(float(most)) * F.col("source_size"))
           .withColumn("ratio", F.col("room") / F.col("weight"))
           .withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(everything)))
    # the level if every source before this one is full and the rest share by weight
    level = (F.col("wanted") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    out = out.withColumn("level", level).withColumn("open", F.col("level") < F.col("ratio"))
    first_open = F.min(F.when(F.col("open"), F.struct("ratio", "spot", "level"))).over(everything)
    out = out.withColumn("found", first_open["level"])
    target = F.coalesce(F.least(F.col("room"), F.col("found") * F.col("weight")), F.col("room"))
    out = out.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    return out.withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def bernoulli(key: Column, seed: str = SEED) -> Column:
    """A uniform in [0, 1) from the first 52 bits of a hash of the key."""
    hashed = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (how often the mix takes a document).

    Two scans of the documents: one for the sums, which are combined before the
    shuffle so that a hot source costs no more than any other, and one for the
    decisions. The source table is written and counted; it is broadcast only
    when small, otherwise joined by shuffle, where adaptive execution splits
    a hot source.
    """
    names = NAMES
    sized = docs.drop(*names, "_mix_copies").withColumn(names[0], word_count(F.col("text")))
    sums = sized.groupBy("source").agg(F.sum(names[0]).cast("long").alias("source_size"))
    sources = keep(source_targets(sums, weights, share, most), "mix_sources")
    side = small_side(sources.select(F.col("source").alias(names[1]), F.col("source_size").alias(names[2]),
                                     F.col("target").alias(names[3]), F.col("rate").alias(names[4])))
    joined = sized.join(side, F.col("source").eqNullSafe(F.col(names[1])))
    rate = F.col(names[4])
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    extra = (bernoulli(named, seed) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("_mix_copies", (F.floor(rate) + extra).cast("int"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix themselves, each row as often as it is taken."""
    renamed, back = aside(docs, (*NAMES, "_mix_copies", "_mix_copy"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))
    taken = mix(renamed, **options).where("_mix_copies > 0").withColumn("_mix_copy", copies)
    return taken.select(*renamed.columns).withColumnsRenamed(back)


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("_mix_size")).cast("long").alias("taken"),
        F.col("_mix_copies").alias("copies"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS weight
      FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS room, 2.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY ratio, source IS NULL, encode(source)
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
               sum(weight) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM r),
f AS (SELECT (SELECT arg_min(level, ratio) FROM l WHERE level < ratio) AS found),
t AS (SELECT source, source_size, coalesce(least(room, found * weight), room) AS target,
             CASE WHEN source_size > 0 THEN coalesce(least(room, found * weight), room) / source_size ELSE 1.0 END AS rate
      FROM l, f),
c AS (SELECT doc_id, size, source_size, target,
             (floor(rate) + ((('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE
               / 4503599627370496.0) < rate - floor(rate))::INT)::INT AS copies
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM c
"""
