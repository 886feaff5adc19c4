"""Collocations by Toivonen mining.

A phrase is a run of words inside one piece of a text, and it is frequent in its
language when it occurs ``least`` times. Every part of a frequent phrase is
frequent. So:

1. A sample of the documents proposes phrases, at a lowered threshold.
2. A full pass counts, exactly, all single words, and every phrase whose two
   parts (without its last word, without its first) are both proposed. These
   are the proposals themselves and their negative border.
3. Phrases that turn out frequent without having been proposed are failures of
   the border. They join the proposals, and another full pass counts what this
   opens up: every phrase not counted before whose two parts are proposed or
   are counted in that pass themselves. A phrase found frequent there has had
   its extensions counted along with it, so that pass closes the border.

Then all frequent phrases of up to ``longest`` words are counted, whatever the
sample was; it decides only whether there is a second pass and how much of no
use is counted on the way.

Proposals reach the tasks as one bitmap of fixed size per phrase length
(``bits``), put together on the cluster. A wrong yes only counts a phrase more;
the sets that decide anything are tables. Within a batch words get exact
numbers and phrases are pairs of numbers, so no hash tells phrases apart; the
counts of a batch are then added up by Spark under the phrase itself, combined
before the shuffle.

Defined results: a null text is empty, a null language is ``und``; repeated rows
count as often as they occur; ties in rank cannot remain, since phrases of a
language differ; further columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm import words as W
from tabweave.llm.frames import keep, map_arrow, table

LEAST = 10  # occurrences of a frequent phrase
LONGEST = 3  # words
SHARE = 50  # per cent: a phrase mostly seen inside a longer one goes
FIRST = 2000  # phrases reported for a language
SAMPLE = 0.2  # of the documents, by a hash of id and text
LOWERED = 0.75  # of the occurrences expected in the sample, rounded up
BITS = 1 << 24  # of a bitmap of proposals
BATCH_BYTES = 2 << 20  # a task holds some hundred bytes for each
BATCH_ROWS = 1 << 16
NO_LANG = "und"
SALTS = 16
HEAVY = 4096  # parts with more than this share of all words are dealt out by salts

# A phrase is counted under one key: its language, a tab, its words.
COUNTS = "key string, n long"

# Pieces end at these bytes, words at these and at the blank and the tab.
_CUTS = np.zeros(256, np.bool_)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_CUTS
_INSIDE[[0x20, 0x09]] = False


def _joined(left: pa.Array, right: pa.Array, between: str) -> pa.Array:
    kind = pa.large_string()
    return pc.binary_join_element_wise(left.cast(kind), right.cast(kind), pa.scalar(between, kind))


class Proposals:
    """A bitmap for each phrase length below the longest."""

    def __init__(self, bits: int, longest: int):
        self.maps = {size: np.zeros(bits // 64, np.uint64) for size in range(1, longest)}

    def places(self, keys: pa.Array) -> np.ndarray:
        data, offsets = W.text_buffer(keys)
        return W.span_hashes(data, offsets[:-1], offsets[1:], 31)

    def holds(self, size: int, places: np.ndarray) -> np.ndarray:
        made = self.maps[size]
        slot = (places >> np.uint64(6)) % np.uint64(len(made))
        return (made[slot] >> (places & np.uint64(63))) & np.uint64(1) > 0

    def joined(self, other: Proposals) -> Proposals:
        out = Proposals(64, 1)
        out.maps = {size: made | other.maps[size] for size, made in self.maps.items()}
        return out

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Proposals) and all((made == other.maps[size]).all() for size, made in self.maps.items())


def propose(found: DataFrame, longest: int, bits: int) -> Proposals:
    """Bitmaps of the phrases of ``found`` (key, words). At most ``bits``
    / 64 numbers for each length come to the driver."""
    empty = Proposals(bits, longest)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        places = empty.places(batch.column("key"))
        slot = ((places >> np.uint64(6)) % np.uint64(bits // 64)).astype(np.int64)
        value = np.uint64(1) << (places & np.uint64(63))
        yield pa.RecordBatch.from_pydict({"words": batch.column("words"), "slot": slot, "value": value.view(np.int64)})

    rows = map_arrow(found.where(F.col("words").between(1, longest - 1)).select("key", "words"), work,
                     "words int, slot long, value long")
    made = rows.groupBy("words", "slot").agg(F.bit_or("value").alias("value")).toArrow()
    size, slot = made["words"].to_numpy(), made["slot"].to_numpy()
    value = made["value"].to_numpy().view(np.uint64)
    for words in empty.maps:
        own = size == words
        empty.maps[words][slot[own]] = value[own]
    return empty


def count_batch(lang: pa.Array, text: pa.Array, longest: int, now: Proposals | None, old: Proposals | None) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of some texts.

    With ``now`` only phrases whose two parts are proposed. With ``old``, the
    proposals of the pass before, only phrases that were not counted then, and a
    part counts as proposed as well when it is counted here for the first time.
    """
    def made(keys: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(n), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([keys[a:a + BATCH_ROWS].cast(pa.string()), pa.array(n[a:a + BATCH_ROWS].astype(np.int64))], names=["key", "n"])

    tongue, tongues = W.codes(pc.fill_null(lang.cast(pa.string()), NO_LANG))
    data, offsets = W.text_buffer(text)
    data = W.LOWER[data]
    words = W.Words(data, offsets, _INSIDE)
    if not len(words):
        return
    document = words.document()
    piece = np.cumsum(_CUTS[data])[words.starts]
    linked = (piece[1:] == piece[:-1]) & (document[1:] == document[:-1])
    word, spelled = W.codes(W.span_texts(data, words.starts, words.ends))
    code, first = W.pair_codes(tongue[document], word)
    tongues = tongues.cast(pa.large_string())
    base, spelling = code, spelled.cast(pa.large_string()).take(pa.array(word[first]))
    keys = _joined(tongues.take(pa.array(tongue[document][first])), spelling, "\t")
    at = np.arange(len(words))  # where the phrases start, and their codes
    known = np.ones(len(keys), np.bool_)  # which were counted before
    if old is None:
        yield from made(_joined(tongues, pa.array([""] * len(tongues)), "\t"), np.bincount(tongue[document], minlength=len(tongues)))
        yield from made(keys, np.bincount(code))
    for size in range(2, longest + 1):
        if now is None:
            good = before = np.ones(len(keys), np.bool_)
        else:
            places = now.places(keys)
            good, before = now.holds(size - 1, places), np.zeros(len(places), np.bool_)
            if old is not None:
                good, before = good | ~known, old.holds(size - 1, places) & known
        every = np.full(len(words) + 1, -1, np.int64)
        every[at] = code
        left = at[at < len(words) - size + 1]
        left = left[linked[left + size - 2] & (every[left + 1] >= 0)]
        left = left[good[every[left]] & good[every[left + 1]]]
        if not len(left):
            return
        known = before[every[left]] & before[every[left + 1]]
        last = base[left + size - 1]
        code, first = W.pair_codes(every[left], last)
        keys = _joined(keys.take(pa.array(every[left][first])), spelling.take(pa.array(last[first])), " ")
        at, known = left, known[first]
        if old is None:
            yield from made(keys, np.bincount(code))
        elif not known.all():
            yield from made(keys.filter(pa.array(~known)), np.bincount(code)[~known])


def counted(docs: DataFrame, longest: int, now: Proposals | None = None, old: Proposals | None = None) -> DataFrame:
    """Phrases of ``docs`` (lang, text) with their counts, as ``count_batch`` picks them."""
    shared = docs.sparkSession.sparkContext.broadcast((now, old))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.text_parts(batch, limit=BATCH_BYTES):
            yield from count_batch(part.column("lang"), part.column("text"), longest, *shared.value)
            pa.default_memory_pool().release_unused()  # or freed batches stay with the worker

    rows = map_arrow(docs.select("lang", "text"), work, COUNTS)
    phrase = F.substring_index("key", "\t", -1)  # words hold no tab and no blank
    return rows.groupBy("key").agg(F.sum("n").alias("n")).select(
        "key", F.expr("substr(key, 1, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"),
        F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1).alias("words"),
        phrase.alias("phrase"), "n")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: float = SAMPLE, lowered: float = LOWERED,
                     bits: int = BITS) -> DataFrame:
    """key, lang, words, phrase, n of all phrases that occur ``least`` times, and each
    language's number of words in a row of ``words`` 0."""
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(sample * 1_000_000))
    enough = max(1, math.ceil(least * sample * lowered))
    found = counted(chosen, max(longest - 1, 1)).where((F.col("n") >= enough) & (F.col("words") > 0))
    proposed = propose(keep(found, "sample_phrases"), longest, bits)

    def full_pass(now: Proposals, old: Proposals | None = None) -> DataFrame:
        some = counted(docs, longest, now, old)
        # the key of a language's number of words ends in the tab; nothing else of rare phrases is looked at
        return keep(some.where((F.col("n") >= least) | F.col("key").endswith("\t")), "phrases")

    first = full_pass(proposed)
    wider = proposed.joined(propose(first, longest, bits))
    if wider == proposed:  # no failure of the border
        return first
    return first.unionByName(full_pass(wider, proposed))


def _cut(phrase: F.Column, size: int, low: int, high: int) -> F.Column:
    """Words low (from 0) to before high of a phrase of ``size`` words."""
    return F.array_join(F.slice(F.split(phrase, " "), low + 1, high - low), " ")


def _heavy(short: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, part, heavy of the parts that may belong to a large share of all
    candidates: a part belongs to no more of them than it occurs."""
    all_words = totals.agg(F.sum("n").alias("n"))
    return short.crossJoin(F.broadcast(all_words)).where(F.col("f").cast("double") * HEAVY > F.col("n")).select(
        "lang", "part", F.lit(True).alias("heavy"))


def _dealt(short: DataFrame, heavy: DataFrame) -> DataFrame:
    """lang, part, f, salt: heavy parts once for every salt, the others once."""
    salts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return short.join(F.broadcast(heavy), ["lang", "part"], "left").select("lang", "part", "f", F.explode(salts).alias("salt"))


def collocations(frequent: DataFrame, longest: int = LONGEST, share: int = SHARE, first: int = FIRST) -> DataFrame:
    """The ``first`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    exact = "decimal(15,0)"
    every = frequent.where("words > 0").select("lang", "words", "phrase", F.col("n").alias("a"))
    candidates = every.where("words > 1")
    totals = frequent.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    short = every.where(F.col("words") < longest).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    heavy = keep(_heavy(short, totals), "heavy_parts")
    parts = _dealt(short, heavy)
    cuts = reduce(DataFrame.unionByName, [
        candidates.where(F.col("words") == size).select(
            "lang", "phrase", "a", F.lit(k).alias("k"), _cut(F.col("phrase"), size, 0, k).alias("front"),
            _cut(F.col("phrase"), size, k, size).alias("back"))
        for size in range(2, longest + 1) for k in range(1, size)])
    for side, name in (("front", "l"), ("back", "r")):
        known = F.broadcast(heavy.withColumnRenamed("part", side))  # HEAVY rows a length at the most
        salt = F.when(F.col("heavy"), F.pmod(F.hash("phrase"), F.lit(SALTS))).otherwise(0)
        cuts = cuts.join(known, ["lang", side], "left").withColumn("salt", salt).drop("heavy")
        cuts = cuts.join(parts.withColumnsRenamed({"part": side, "f": name}), ["lang", "salt", side]).drop("salt")
    cuts = cuts.withColumn("score", F.expr(
        f"(cast(1000000 as decimal(7,0)) * cast(a as {exact}) * cast(a as {exact})) div (cast(l as {exact}) * cast(r as {exact}))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = [(size, low, high) for size in range(3, longest + 1) for low in range(size) for high in range(low + 2, size + 1) if high - low < size]
    if inner:
        over = reduce(DataFrame.unionByName, [
            candidates.where(F.col("words") == size).select("lang", _cut(F.col("phrase"), size, low, high).alias("phrase"), F.col("a").alias("longer"))
            for size, low, high in inner]).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(over, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language may hold most phrases, so it is thinned in parts first
    dealt = scored.withColumn("salt", F.pmod(F.hash("phrase", "a"), F.lit(SALTS * 4)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(frequent_phrases(table(spark, folder, "documents").select("doc_id", "lang", "text")))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, s, unnest(list_transform(range(1, len(ws) - s + 2), lambda i: array_to_string(ws[i:i + s - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3)) AS sizes(s)),
f AS (SELECT lang, s, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE s = 1 GROUP BY lang),
c AS (SELECT lang, s, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE s > 1 AND a >= 10),
k AS (SELECT *, array_to_string(ws[1:k], ' ') AS front, array_to_string(ws[k + 1:s], ' ') AS back
      FROM c, (VALUES (1), (2)) AS cuts(k) WHERE k < s),
x AS (SELECT k.lang, k.phrase, k.a, k.s, k.k, l.a AS l, r.a AS r,
             ((1000000::HUGEINT * k.a * k.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.front JOIN f r ON r.lang = k.lang AND r.phrase = k.back),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(longer) AS longer FROM
      (SELECT lang, a AS longer, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM c WHERE s = 3) GROUP BY ALL),
h AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM h)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000
"""
