"""Benchmark decontamination with training suffix arrays.

Every shard of the training documents (a few MB of whole texts) gets a suffix
array over its words; every suffix of the benchmark items is looked up in it by
binary search. The range of training suffixes that begin with a test window is
found with two searches; runs of such hits along a diagonal are the longest
verbatim matches with their places. Shards hold whole documents, so a result
needs no shuffle.

The array holds only suffixes whose first words occur at the start of some test
window: no others can match. Words are compared by 64-bit hashes.

The benchmark is counted first and cut into blocks of at most about
``block_words`` words; one block at a time is sent to all tasks, so what is
broadcast has a fixed bound. A benchmark of one block, the usual case, takes one
pass; with more, each pass hands the documents on with what it found.

Defined results: a null or empty text, of a document or an item, has no words
and matches nothing; an item of fewer than ``length`` words is one window; an
item without id still counts for hit words but is not listed; items that share
an id are one item; repeated rows get the same result each; very long items are
cut into overlapping pieces, which changes no window; further columns are
carried through ``decontaminate`` and not read; empty tables give empty
results, an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import words as W
from tabweave.llm.frames import aside, keep, map_arrow, table

LENGTH = 10
BLOCK_WORDS = 2_000_000
PIECE_WORDS = 100_000
HEAD = 3  # words that a training suffix must share with a window to be sorted

PIECES = "item string, at long, whole long, count long, hashes binary"
STATE = ("struct<n_words:long,n_hit:long,runs:binary,items:array<string>,"
         "matches:array<struct<item_id:string,item_start:long,start:long,length:long>>>")
STATE_TYPE = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("runs", pa.binary()), ("items", pa.list_(pa.string())),
    ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()),
                                    ("length", pa.int64())])))])
FOUND = "_leak_found"


def lower_words(column: pa.Array) -> W.Words:
    data, offsets = W.text_buffer(column)
    return W.Words(W.LOWER[data], offsets, W.LETTERS)


def cut_items(length: int, piece_words: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = lower_words(batch.column("text"))
        hashed = words.hashes()
        out = {"item": [], "at": [], "whole": [], "count": [], "hashes": []}
        for row, item in enumerate(batch.column("item_id").cast(pa.string()).to_pylist()):
            own = hashed[words.first[row]:words.first[row + 1]]
            step = max(1, piece_words - length + 1)
            for at in range(0, max(len(own) - length + 1, min(1, len(own))), step):
                piece = own[at:at + step + length - 1]
                for name, value in zip(out, (item, at, len(own), len(piece), piece.tobytes()), strict=True):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("item", pa.string()), ("at", pa.int64()), ("whole", pa.int64()), ("count", pa.int64()),
            ("hashes", pa.binary())]))

    return work


class Tests:
    """A block of the benchmark: its windows, each with item and place."""

    def __init__(self, rows: list, length: int):
        pieces = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        self.items = sorted({r["item"] for r in rows if r["item"] is not None})
        number = {item: k for k, item in enumerate(self.items)}
        self.hashed = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        starts, item, place, span, at = [], [], [], [], 0
        for r, piece in zip(rows, pieces, strict=True):
            width = min(length, r["whole"])
            here = np.arange(len(piece) - width + 1)
            starts.append(at + here)
            place.append(r["at"] + here)
            item.append(np.full(len(here), number.get(r["item"], -1)))
            span.append(np.full(len(here), width))
            at += len(piece)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.starts, self.item, self.place, self.span = map(join, (starts, item, place, span))
        self.head = int(min(HEAD, self.span.min())) if len(self.span) else 1
        self.heads = W.sequence_hashes(self.hashed, self.head)
        self.wanted = np.unique(self.heads[self.starts]) if len(self.starts) else np.zeros(0, np.uint64)


class SuffixArray:
    """Suffixes of a shard's documents in the order of their words."""

    def __init__(self, hashed: np.ndarray, room: np.ndarray, places: np.ndarray, depth: int):
        self.hashed, self.room = hashed, room
        self.at = places.copy()
        fresh = np.zeros(len(places), np.bool_)  # first of a group of suffixes that are equal so far
        fresh[:1] = True
        for d in range(depth):
            group = np.cumsum(fresh)
            tied = np.flatnonzero(np.bincount(group, minlength=len(fresh) + 1)[group] > 1)
            if not len(tied):
                break
            key, own = self.word(self.at[tied], d), group[tied]
            order = np.lexsort((key, own))
            self.at[tied] = self.at[tied][order]
            key, own = key[order], own[order]
            # suffixes that end here are equal for good
            fresh[tied[1:]] |= (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (key[1:] == 0)

    def word(self, at: np.ndarray, d: int | np.ndarray) -> np.ndarray:
        """Word d of the suffixes; 0, below every word, past the document's end."""
        inside = d < self.room[at]
        return np.where(inside, self.hashed[np.where(inside, at + d, 0)] | np.uint64(1), np.uint64(0))

    def search(self, tests: np.ndarray, starts: np.ndarray, span: np.ndarray, after: bool) -> np.ndarray:
        """Where the windows would be put in, before or after their equals."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.at))
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            suffix, same, less = self.at[middle], np.ones(len(open_), np.bool_), np.zeros(len(open_), np.bool_)
            for d in range(int(span[open_].max())):
                use = np.flatnonzero(same & (d < span[open_]))
                if not len(use):
                    break
                mine, test = self.word(suffix[use], d), tests[starts[open_[use]] + d] | np.uint64(1)
                less[use] = mine < test
                same[use] = mine == test
            right = less | (same & after)
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (range, place) of the ranges [low, high)."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return owner, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


def scan_shard(batch: pa.RecordBatch, tests: Tests) -> pa.Array:
    """What one shard has of the block, a struct per document."""
    words = lower_words(batch.column("text"))
    hashed, room = words.hashes(), words.room()
    before = batch.column(FOUND).to_pylist() if FOUND in batch.schema.names else [None] * batch.num_rows
    hit = np.zeros(len(words), np.bool_)
    items: dict[int, set] = {}
    matches: dict[int, list] = {}
    heads = W.sequence_hashes(hashed, tests.head)
    places = np.flatnonzero((room[:len(heads)] >= tests.head) & W.among(tests.wanted, heads))
    if len(places):
        shard = SuffixArray(hashed, room, places, int(tests.span.max()))
        # windows whose first words are nowhere in the shard need no search
        windows = np.flatnonzero(W.among(np.unique(heads[places]), tests.heads[tests.starts]))
        starts, span = tests.starts[windows], tests.span[windows]
        low = shard.search(tests.hashed, starts, span, after=False)
        high = shard.search(tests.hashed, starts, span, after=True)
        which, at = _spread(low, high)
        place, window = shard.at[at], windows[which]
        width = tests.span[window]
        hit = W.cover(place, width, len(words))
        document = words.document()[place]
        item = tests.item[window]
        if len(place):
            # consecutive windows on one diagonal make one verbatim match
            diagonal = place - tests.starts[window]
            order = np.lexsort((place, diagonal, item, document))
            d, i, g, p, w = document[order], item[order], diagonal[order], place[order], window[order]
            new = np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1)))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(new)) - 1
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                row = int(d[a])
                name = tests.items[i[a]] if i[a] >= 0 else None
                if name is not None:
                    items.setdefault(row, set()).add(name)
                matches.setdefault(row, []).append({
                    "item_id": name, "item_start": int(tests.place[w[a]]), "start": int(p[a] - words.first[row]),
                    "length": int(p[b] - p[a] + tests.span[w[b]])})
    out = []
    for row, old in enumerate(before):
        own = hit[words.first[row]:words.first[row + 1]]
        if old:
            ends = np.frombuffer(old["runs"], np.int64).reshape(2, -1)
            own = own | W.cover(ends[0], ends[1] - ends[0], len(own))
        out.append({
            "n_words": len(own), "n_hit": int(own.sum()), "runs": np.stack(W.runs(own)).astype(np.int64).tobytes(),
            "items": sorted(items.get(row, set()) | set(old["items"] if old else ())),
            "matches": (old["matches"] if old else []) + matches.get(row, [])})
    return pa.array(out, STATE_TYPE)


def find_leaks(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, block_words: int = BLOCK_WORDS,
               piece_words: int = PIECE_WORDS) -> DataFrame:
    """``docs`` with a struct column of what each document shares with the benchmark."""
    spark = docs.sparkSession
    pieces = keep(map_arrow(benchmark.select("item_id", "text"), cut_items(length, min(piece_words, block_words)),
                            PIECES), "benchmark_pieces")
    total = pieces.agg(F.sum("count")).first()[0] or 0
    blocks = max(1, -(-2 * total // block_words))  # half full on average, so that chance keeps them below the bound
    blocks = 1 if total <= block_words else blocks
    names = [c for c in docs.columns if c != FOUND]
    found = docs.select(*names)
    for k in range(blocks):
        rows = pieces.where(F.pmod(F.xxhash64("item", "at", "hashes"), F.lit(blocks)) == k)
        tests = spark.sparkContext.broadcast(Tests(rows.orderBy("item", "at", "hashes").collect(), length))

        def work(batch: pa.RecordBatch, tests=tests) -> Iterator[pa.RecordBatch]:
            for part in W.text_parts(batch):
                state = scan_shard(part, tests.value)
                kept = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, state], names=[*names, FOUND])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
        found = map_arrow(found, work, f"{fields}, `{FOUND}` {STATE}")
        if k + 1 < blocks:
            found = keep(found, "leaks")
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a word inside a benchmark window."""
    renamed, back = aside(docs, (FOUND,))
    found = find_leaks(renamed, benchmark, **options)
    return found.where(F.col(f"{FOUND}.n_hit") == 0).drop(FOUND).withColumnsRenamed(back)


def longest_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row per maximal verbatim match: doc_id, item_id, item_start, start, length (in words)."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, **options)
    return found.select("doc_id", F.explode(f"{FOUND}.matches").alias("m")).select("doc_id", "m.*")


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = find_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    state = F.col(FOUND)
    return found.select(
        "doc_id", state["n_words"].alias("n_words"), state["n_hit"].alias("n_hit"),
        F.size(state["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", state["items"]), 256).alias("items_sha256"),
        (state["n_hit"] > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform(state["matches"], lambda m: m["length"])), F.lit(0)).alias("longest"))
