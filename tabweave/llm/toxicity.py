"""Toxicity by the nearest labelled examples.

Examples are labelled documents, at most ``EXAMPLES`` of them, chosen by a hash.
A text is a vector over terms with weight (1 + ln tf) * idf and length 1; the
terms are the words that toxic examples hold far more often than others (G-test
beyond ``LEAST_G`` and a share beyond ``LEAST_LIFT``), idf comes from all
documents. A text's
neighbours are the ``NEAREST`` examples of greatest cosine, with all further
ones that tie with the last; examples with equal vectors are one neighbour with
all their votes. A vote has weight 1 / (``BLUR`` + 1 - cosine).
The share of toxic votes is calibrated: a monotone step function is fitted on
the examples, each judged by all others (pool adjacent violators).

The search is exact. Examples lie in blocks of ``BLOCK``, alike ones together,
in an inverted index that also knows each term's greatest weight in each block.
The sum of those bounds the cosine with any example of a block, so a text looks
at its most promising blocks first and then at all whose bound reaches the
cosine found so far; the others cannot hold a neighbour.

The index is a few MB whatever the size of the corpus, and goes to every task.
Texts are scored where they are read: two scans (document frequencies, scores),
and only counts of terms are shuffled.

Defined results: a null text is empty; a text without any term has no
neighbours and gets the share of toxic ones among the examples without terms;
several labels of one document count as one example of their mean; labels of
null do not count; repeated rows are scored alike; without examples every score
is 0; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import words as W
from tabweave.llm.frames import keep, map_arrow, table

EXAMPLES = 40_000  # the most labelled documents that the index holds
LEAST_G = 24.0  # G statistic of a term; about one in a million by chance
LEAST_LIFT = 3.0  # toxic share of the examples that hold a term, against that of all
TERMS = 20_000  # the most terms, those with the greatest statistic
NEAREST = 15
BLOCK = 64
BLUR = 0.05
CERTAIN = 0.7
TOGETHER = 2_000_000  # postings looked at for the texts that search at the same time
STEPS = 1 << 30  # cosines are compared in whole steps, so that equal ones tie

SCORES = ("doc_id long, score double, predicted int, votes double, "
          "neighbours array<struct<doc_id:long,similarity:double,toxic:double,examples:long>>")


def term_batch(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term number and frequency of the terms that the texts hold, in that order."""
    data, offsets = W.text_buffer(column)
    data = W.LOWER[data]
    words = W.Words(data, offsets, W.LETTERS)
    word, distinct = W.codes(W.span_texts(data, words.starts, words.ends))
    number = pc.fill_null(pc.index_in(distinct, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    found = number[word] if len(word) else word
    held = found >= 0
    key, tf = np.unique(words.document()[held] * max(1, len(terms)) + found[held], return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), tf


@dataclass
class Vectors:
    """Rows of unit vectors: the terms of row i are ``terms[first[i]:first[i + 1]]``."""

    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, rows: int, row: np.ndarray, terms: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> Vectors:
        weights = (1 + np.log(tf)) * idf[terms]
        norm = np.sqrt(np.bincount(row, weights**2, rows))
        return cls(np.searchsorted(row, np.arange(rows + 1)), terms, weights / norm[row])

    def slice(self, a: int, b: int) -> Vectors:
        first = self.first[a:b + 1]
        return Vectors(first - first[0], self.terms[first[0]:first[-1]], self.weights[first[0]:first[-1]])

    def keys(self) -> list[bytes]:
        """Bytes that are equal just for equal rows of the same making."""
        return [self.terms[a:b].tobytes() + self.weights[a:b].tobytes() for a, b in zip(self.first[:-1], self.first[1:], strict=True)]

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class BlockMaxIndex:
    """Examples in blocks, with postings by term and block and the greatest weight of each."""

    def __init__(self, vectors: Vectors, terms: int, block: int = BLOCK):
        self.block, self.count = block, len(vectors.first) - 1
        self.known = {key: i for i, key in enumerate(vectors.keys())}
        # alike examples together: by their heaviest term, then the next
        heavy = np.full((self.count, 2), terms, np.int64)
        for i in range(self.count):
            a, b = vectors.first[i], vectors.first[i + 1]
            best = vectors.terms[a:b][np.argsort(-vectors.weights[a:b], kind="stable")[:2]]
            heavy[i, :len(best)] = best
        self.order = np.lexsort((np.arange(self.count), heavy[:, 1], heavy[:, 0]))
        place = np.empty(self.count, np.int64)
        place[self.order] = np.arange(self.count)
        self.blocks = -(-self.count // block)
        at = place[vectors.row()]
        by = np.lexsort((at, vectors.terms))
        self.example, self.weight, term = at[by], vectors.weights[by], vectors.terms[by]
        self.postings = np.bincount(term, minlength=terms)
        cell = term * max(1, self.blocks) + self.example // block  # postings of a term in a block lie together
        self.cells, self.begin = np.unique(cell, return_index=True)
        self.end = np.append(self.begin[1:], len(cell))
        self.most = np.maximum.reduceat(self.weight, self.begin) if len(cell) else np.zeros(0)
        self.of_term = np.searchsorted(self.cells, np.arange(terms + 1) * max(1, self.blocks))

    def _spread(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of the ranges, and the range of each."""
        size = last - first
        owner = np.repeat(np.arange(len(size)), size)
        return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size), owner

    def cosines(self, queries: Vectors, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair of query and block, place in the block) -> cosine, as keys and whole steps."""
        query, block = pairs // self.blocks, pairs % self.blocks
        place, pair = self._spread(queries.first[query], queries.first[query + 1])
        cell = queries.terms[place] * self.blocks + block[pair]
        at = np.searchsorted(self.cells, cell)
        at[at == len(self.cells)] = 0
        held = self.cells[at] == cell
        at, place, pair = at[held], place[held], pair[held]
        post, owner = self._spread(self.begin[at], self.end[at])
        key, back = np.unique(pair[owner] * self.block + self.example[post] % self.block, return_inverse=True)
        made = np.bincount(back, queries.weights[place][owner] * self.weight[post], len(key))
        return key, np.round(made * STEPS).astype(np.int64)

    def bounds(self, queries: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and block that share a term, and the greatest cosine that each may hold."""
        first, last = self.of_term[queries.terms], self.of_term[queries.terms + 1]
        cell, owner = self._spread(first, last)
        pair, back = np.unique(queries.row()[owner] * self.blocks + self.cells[cell] % self.blocks, return_inverse=True)
        made = np.bincount(back, queries.weights[owner] * self.most[cell], len(pair))
        return pair, np.ceil(made * STEPS * (1 + 1e-9)).astype(np.int64) + 1

    def equal(self, queries: Vectors) -> np.ndarray:
        """The example that each query equals, else -1."""
        return np.array([self.known.get(key, -1) for key in queries.keys()], np.int64)

    def nearest(self, queries: Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, example and cosine steps of the ``k`` nearest of each query and those that tie
        with the last."""
        rows = len(queries.first) - 1
        none = np.zeros(0, np.int64)
        if not self.count or not len(queries.terms):
            return none, none, none
        pair, bound = self.bounds(queries)
        by = np.lexsort((-bound, pair // self.blocks))
        pair, bound = pair[by], bound[by]
        query = pair // self.blocks
        rank = np.arange(len(pair)) - np.searchsorted(query, np.arange(rows))[query]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        reach = np.zeros(rows, np.int64)  # the k-th best cosine of each query so far
        low, step = 0, 1 + k // self.block
        while True:  # a round of blocks after the other, for all queries at once
            now = np.flatnonzero((rank >= low) & (rank < low + step) & (bound >= reach[query]))
            if not len(now):
                break
            key, steps = self.cosines(queries, pair[now])
            own = query[now][key // self.block]
            example = self.order[pair[now][key // self.block] % self.blocks * self.block + key % self.block]
            own, example, steps = (np.concatenate(x) for x in zip(*found, (own, example, steps), strict=True))
            by = np.lexsort((example, -steps, own))
            own, example, steps = own[by], example[by], steps[by]
            begin = np.searchsorted(own, np.arange(rows + 1))
            full = np.flatnonzero(np.diff(begin) >= k)
            reach[full] = steps[begin[full] + k - 1]
            good = steps >= reach[own]
            found = [(own[good], example[good], steps[good])]
            low, step = low + step, step * 2
        return found[0] if found else (none, none, none)


@dataclass
class Model:
    """What a task needs to score texts."""

    terms: pa.Array
    idf: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray  # the least of the examples of each vector
    count: np.ndarray  # its examples, and the sum of their labels
    toxic: np.ndarray
    knots: np.ndarray  # calibrated scores are constant from one knot (a share of votes) to the next
    levels: np.ndarray
    bare: float  # of texts without terms

    def share(self, rows: int, queries: Vectors, own_label: np.ndarray | None = None):
        """The share of toxic votes and the neighbours. With ``own_label`` the
        queries are examples themselves and their own votes are left out."""
        found, a = [], 0
        work = np.concatenate(([0], np.cumsum(self.index.postings[queries.terms])))[queries.first]
        while a < rows:  # as many texts at a time as their postings allow
            b = min(max(a + 1, int(np.searchsorted(work, work[a] + TOGETHER, "right")) - 1), rows)
            own, example, steps = self.index.nearest(queries.slice(a, b), NEAREST)
            found.append((own + a, example, steps))
            a = b
        own, example, steps = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))
        count, toxic = self.count[example].astype(float), self.toxic[example]
        if own_label is not None:
            same = self.index.equal(queries)[own] == example
            count, toxic = count - same, toxic - np.where(same, own_label[own], 0.0)
        weight = 1 / (BLUR + 1 - np.minimum(steps / STEPS, 1.0))
        total = np.bincount(own, weight * count, rows)
        votes = np.bincount(own, weight * toxic, rows)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), np.nan), own, example, steps

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(share), self.bare)
        at = np.maximum(np.searchsorted(self.knots, np.nan_to_num(share) + 1e-9, "right") - 1, 0)
        return np.where(np.isnan(share), self.bare, self.levels[at])


def rising(share: np.ndarray, toxic: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending shares, each with the toxic and all
    examples that have it: the knots and levels of the best rising steps."""
    steps: list[list[float]] = []
    for knot, votes, n in zip(share.tolist(), toxic.tolist(), count.tolist(), strict=True):
        steps.append([knot, votes, n])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, votes, n = steps.pop()
            steps[-1][1] += votes
            steps[-1][2] += n
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps])


def _found_in(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """How many texts hold each term, and how many texts there are (term -1)."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.text_parts(batch):
            _, term, _ = term_batch(part.column("text"), terms)
            held = np.bincount(term, minlength=len(terms))
            used = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict({"term": np.append(used, -1), "n": np.append(held[used], part.num_rows)})

    return map_arrow(docs.select("text"), work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def pick_terms(examples: DataFrame, least_g: float = LEAST_G, lift: float = LEAST_LIFT, most: int = TERMS) -> list[str]:
    """Words that stand for the label toxic, by the G-test and the share of toxic examples."""
    # as ``term_batch`` cuts words: letters outside ASCII belong to them
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    toxic, rest = F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("rest")
    sums = examples.agg(toxic, rest).first()
    if not sums["toxic"] or not sums["rest"]:
        return []
    every = float(sums["toxic"] + sums["rest"])
    counts = examples.select("toxic", F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(toxic, rest)
    share = sums["toxic"] / every
    held = F.col("toxic") + F.col("rest")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (part(F.col("toxic"), held * share) + part(F.col("rest"), held * (1 - share))
             + part(F.lit(sums["toxic"]) - F.col("toxic"), (every - held) * share)
             + part(F.lit(sums["rest"]) - F.col("rest"), (every - held) * (1 - share)))
    best = counts.withColumn("g", F.round(g, 6)).where((F.col("g") >= least_g) & (F.col("toxic") >= lift * share * held)).orderBy(F.desc("g"), "word").limit(most)
    return sorted(r["word"] for r in best.select("word").collect())


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, least_g: float = LEAST_G) -> Model:
    """The model of labelled documents (``labels``: doc_id, toxic). Document
    frequencies come from all of ``docs``, all else from the examples."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    # at most ``most`` rows of numbers; their texts are picked up where they lie
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    examples = keep(docs.select("doc_id", "text").join(keep(chosen, "chosen"), "doc_id"), "examples")
    terms = pa.array(pick_terms(examples, least_g), pa.large_string()).cast(pa.large_binary())
    counts = {r["term"]: r["n"] for r in _found_in(docs, terms).collect()}  # a row per term
    idf = np.log((1 + counts.get(-1, 0)) / (1 + np.array([counts.get(t, 0) for t in range(len(terms))]))) + 1

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.text_parts(batch):
            row, term, tf = term_batch(part.column("text"), terms)
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").cast(pa.int64()), part.column("toxic"), pa.ListArray.from_arrays(first.astype(np.int32), term),
                pa.ListArray.from_arrays(first.astype(np.int32), tf)], names=["doc_id", "toxic", "terms", "tf"])

    vectors = keep(map_arrow(examples, work, "doc_id long, toxic double, terms array<long>, tf array<long>"), "vectors")
    # equal vectors are one neighbour; at most ``most`` rows come here
    merged = vectors.groupBy("terms", "tf").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    rows = merged.orderBy("doc_id", "terms", "tf").toArrow()
    bare = pc.equal(pc.list_value_length(rows["terms"]), 0)
    n, toxic = rows["n"].to_numpy().sum(), rows["toxic"].to_numpy().sum()
    none = rows.filter(bare)
    prior = (sum(none["toxic"].to_pylist()) + (toxic / n if n else 0.0)) / (sum(none["n"].to_pylist()) + 1)
    rows = rows.filter(pc.invert(bare))
    model = Model(terms, idf, BlockMaxIndex(_vectors(rows, idf), len(terms)), rows["doc_id"].to_numpy(), rows["n"].to_numpy(), rows["toxic"].to_numpy(),
                  np.zeros(0), np.zeros(0), float(prior))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = shared.value
        share, *_ = model.share(batch.num_rows, _vectors(batch, model.idf), batch.column("toxic").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(share), batch.column("toxic")], names=["share", "toxic"])

    judged = map_arrow(vectors.where(F.size("terms") > 0), judge, "share double, toxic double").groupBy(F.round("share", 9).alias("share")).agg(
        F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    steps = [r for r in judged.orderBy("share").collect() if not np.isnan(r["share"])]
    model.knots, model.levels = rising(*(np.array([r[c] for r in steps], float) for c in ("share", "toxic", "n")))
    return model


def _vectors(rows: pa.RecordBatch | pa.Table, idf: np.ndarray) -> Vectors:
    """Vectors of rows of term numbers and frequencies."""
    terms, tf = (pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in (rows.column("terms"), rows.column("tf")))
    size = pc.list_value_length(terms).to_numpy()
    flat = [np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy(zero_copy_only=False) for c in x.chunks)]).astype(np.int64) for x in (terms, tf)]
    return Vectors.of(len(size), np.repeat(np.arange(len(size)), size), *flat, idf)


def score_texts(docs: DataFrame, model: Model, evidence: bool = True) -> DataFrame:
    """doc_id, score, predicted, votes and the nearest examples of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in W.text_parts(batch):
            rows = part.num_rows
            queries = Vectors.of(rows, *term_batch(part.column("text"), model.terms), model.idf)
            share, own, example, steps = model.share(rows, queries)
            score = model.calibrated(share)
            first = np.searchsorted(own, np.arange(rows + 1))
            shown = np.minimum(np.diff(first), NEAREST if evidence else 0)
            pick = np.repeat(first[:-1], shown) + np.arange(shown.sum()) - np.repeat(np.cumsum(shown) - shown, shown)
            struct = pa.StructArray.from_arrays([pa.array(model.ids[example[pick]]), pa.array(steps[pick] / STEPS),
                                                 pa.array(model.toxic[example[pick]] / model.count[example[pick]]), pa.array(model.count[example[pick]])],
                                                names=["doc_id", "similarity", "toxic", "examples"])
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= CERTAIN).astype(np.int32)),
                pa.array(share, from_pandas=True), pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(shown))).astype(np.int32), struct)],
                names=["doc_id", "score", "predicted", "votes", "neighbours"])

    return map_arrow(docs.select("doc_id", "text"), work, SCORES)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, folder, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id")) != 1))
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "neighbours")
