"""Line dedup by prefix doubling over line ids, in DataFrame operations alone.

Lines get ids, documents become sequences of ids. Suffixes are ranked by their
first line, then by 2, 4, ... lines: the rank of a suffix and the rank of the
suffix that many lines further make a pair, and pairs are ranked anew. Suffixes
whose pair occurs once share no longer run with any other and leave. What is
left with equal rank at depth ``least`` are the LCP intervals of that depth:
every maximal repeated run of at least ``least`` lines is a chain of them. The
first place of an interval stays, the lines of all later ones go.

Ranks are given to distinct pairs, not to suffixes, so a line that a third of
all documents hold is one row when pairs are sorted; sorting is by range, and
joins of suffixes with their ranks split hot ranks.

A line is a piece between line feeds with at least one word; others are not
counted and not kept. Defined results: null and empty texts have no lines and
keep the empty text; places are ordered by doc_id (null last), then by a hash
of the text, then by line; repeated rows (same doc_id and text) are one
document and get the same result each; further columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm.frames import WORD, keep, shuffle_parts, table

LEAST = 2
PLACE = ("doc", "unnamed", "text_key", "pos")


def split_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def keyed(docs: DataFrame) -> DataFrame:
    """doc, unnamed, text_key (what a document is told by) and its lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc"), F.col("doc_id").isNull().alias("unnamed"),
        F.xxhash64(text, F.length(text)).alias("text_key"), split_lines(F.col("text")).alias("lines"))


def with_ranks(classes: DataFrame, *keys: str) -> DataFrame:
    """``classes`` with ``rank``, its number in the order of the keys: sorted by
    range, numbered within each range, the ranges' sizes added up."""
    spark = classes.sparkSession
    laid = keep(classes.repartitionByRange(shuffle_parts(spark), *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = {r["_range"]: r["n_classes"] for r in laid.groupBy("_range").agg(F.count(F.lit(1)).alias("n_classes")).collect()}
    before, at = [], 0
    for part in sorted(sizes):  # a row per range
        before.append((part, at))
        at += sizes[part]
    starts = spark.createDataFrame(before, "_range int, _before long")
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return laid.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_before") + number).drop("_range", "_before")


def _place() -> Column:
    return F.struct("unnamed", "doc", "text_key", "pos")


def repeated_suffixes(lines: DataFrame, least: int = LEAST) -> DataFrame:
    """Suffixes that share their first ``least`` lines with another one: their
    place, the rank of the interval, and the interval's first place.

    ``lines``: doc, unnamed, text_key, pos, a, b (two hashes of the line).
    """
    first = F.min(_place()).alias("first")
    classes = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
    ranks = keep(with_ranks(classes.select("a", "b", "first"), "a", "b"), "line_ids")
    suffixes = keep(lines.join(ranks, ["a", "b"]).select(*PLACE, "rank", "first"), "suffixes")
    depth = 1
    while depth < least:
        step = min(depth, least - depth)  # the last step may overlap
        near = suffixes.select(*PLACE, F.col("rank").alias("r"))
        far = suffixes.select(*PLACE[:3], (F.col("pos") - step).alias("pos"), F.col("rank").alias("s"))
        pairs = keep(near.join(far, list(PLACE)), "pairs")
        classes = pairs.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
        ranks = keep(with_ranks(classes.select("r", "s", "first"), "r", "s"), "pair_ranks")
        suffixes = keep(pairs.join(ranks, ["r", "s"]).select(*PLACE, "rank", "first"), "suffixes")
        depth += step
    return suffixes


def line_table(keyed_docs: DataFrame) -> DataFrame:
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.length(x)).alias("b")))
    return (keyed_docs.select(*PLACE[:3], F.posexplode(hashed).alias("pos", "h")).select(*PLACE, "h.a", "h.b")
            .dropDuplicates(list(PLACE)))


def later_copies(suffixes: DataFrame, least: int = LEAST) -> DataFrame:
    """Places of the lines that go."""
    later = suffixes.where(_place() > F.col("first"))
    return later.select(*PLACE[:3], F.explode(F.sequence(F.col("pos"), F.col("pos") + (least - 1))).alias("pos")).distinct()


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The maximal runs that go: doc_id, line, n_lines, and where they came first.

    Later suffixes that follow each other, and whose first places do too, make one run.
    """
    suffixes = repeated_suffixes(keep(line_table(keyed(docs.select("doc_id", "text"))), "lines"), least)
    later = suffixes.where(_place() > F.col("first"))
    order = Window.partitionBy(*PLACE[:3], "first.doc", "first.unnamed", "first.text_key", F.col("first.pos") - F.col("pos")).orderBy("pos")
    later = later.withColumn("island", F.col("pos") - F.row_number().over(order))
    runs = later.groupBy(*PLACE[:3], F.col("first.doc").alias("first_doc"), F.col("first.unnamed").alias("first_unnamed"),
                         F.col("first.text_key").alias("_t"), (F.col("first.pos") - F.col("pos")).alias("_d"), "island").agg(
        F.min("pos").alias("line"), (F.count(F.lit(1)) + (least - 1)).alias("n_lines"), F.min("first.pos").alias("first_line"))
    return runs.select(F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id"), "line", "n_lines",
                       F.when(~F.col("first_unnamed"), F.col("first_doc")).alias("first_doc_id"), "first_line")


def line_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and kept_text of every row."""
    full = keyed(docs.select("doc_id", "text"))
    lines = keep(line_table(full), "lines")
    gone = keep(later_copies(repeated_suffixes(lines, least), least), "gone")
    touched = gone.select(*PLACE[:3]).distinct()
    # a flag for each line of the documents that lose some
    flags = (lines.select(*PLACE).join(touched, list(PLACE[:3]), "left_semi")
             .join(gone.withColumn("gone", F.lit(True)), list(PLACE), "left")
             .groupBy(*PLACE[:3]).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("gone", F.lit(False)).alias("gone")))).alias("flags")))
    flags = flags.select(*PLACE[:3], F.transform("flags", lambda x: x["gone"]).alias("flags"))
    joined = full.join(flags, list(PLACE[:3]), "left")
    marked = F.zip_with("lines", "flags", lambda x, g: F.when(~F.coalesce(g, F.lit(False)), x))
    kept = F.when(F.col("flags").isNull(), F.col("lines")).otherwise(F.filter(marked, lambda x: x.isNotNull()))
    out = joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    text = F.concat_ws("\n", "kept")
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"),
                      F.sha2(text, 256).alias("kept_sha256"), text.alias("kept_text"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)),
                                      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(lines))) AS p, lines FROM d),
k AS (SELECT doc_id, p, lines[p] || chr(10) || lines[p + 1] AS two FROM w),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY two ORDER BY doc_id, p) AS n FROM k),
g AS (SELECT doc_id, list(DISTINCT q) AS gone FROM
      (SELECT doc_id, unnest([p, p + 1]) AS q FROM f WHERE n > 1) GROUP BY doc_id),
j AS (SELECT d.doc_id, d.lines, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
r AS (SELECT doc_id, len(lines)::BIGINT AS n_lines, len(gone)::BIGINT AS n_removed,
             list_filter(lines, lambda x, i: NOT list_contains(gone, i)) AS kept FROM j)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM r
"""
