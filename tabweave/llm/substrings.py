"""Substring dedup with fixed-block anchors.

A run of ``length`` words that also starts earlier is removed. Of two equal
runs of ``length`` words, the first holds a whole block of ``length // 2``
words at a multiple of ``length // 2`` in its document. So it is enough to
index those non-overlapping blocks, probe the index with every rolling window
of a block's size, and to look at longer runs only around the hits:

1. Texts are packed into chunks of a few MB, written once.
2. Every chunk sends the hashes of its rolling windows, each once, to buckets;
   the aligned blocks are marked. A bucket answers with the hashes that are an
   indexed block and occur at two places or more: the anchors.
3. Around its anchors a chunk extends the hits to windows of ``length`` words
   and sends their hashes to buckets. A bucket finds for each the first
   document, and tells the other chunks that theirs are later copies.
4. The later windows of a chunk, run together, are the maximal exact repeats;
   the words under them are removed.

No pairs are made: a passage with a million copies costs an entry per chunk
that holds it, and a bucket's size follows from the number of buckets. The
hashes of step 2 may collide, which only makes step 3 look at more windows; in
step 3, 64 bits and an independent bucket number tell windows apart.

Defined results: null and empty texts have no words and keep nothing; the hash
of nothing is that of the empty string; documents shorter than ``length``
words are left alone; rows that share a doc_id count as documents of their own,
one after the other in order of their chunks; rows without doc_id come last;
further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tabweave.llm import words as W
from tabweave.llm.frames import keep, map_arrow, shuffle_parts, table

LENGTH = 20
CHUNK_BYTES = 2 << 20
LAST = np.iinfo(np.int64).max  # the place of a row without doc_id
RESIDUE = np.uint64((1 << 30) - 1)

CHUNKS = "chunk string, ids binary, known binary, ends binary, text binary"
PROBES = "bucket int, chunk string, codes binary, marks binary"
HITS = "chunk string, bucket int, codes binary"
WINDOWS = "bucket int, chunk string, keys binary, ids binary, many binary"
LATER = "chunk string, later binary, own binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:long,stop:long>>"


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane, compressed; ascending integers shrink well."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def unsqueeze_sorted(data: bytes, dtype: type) -> np.ndarray:
    return np.cumsum(unsqueeze(data, dtype), dtype=dtype)


def pack_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of many documents each; the names of the chunks are only fixed once the table is written."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for piece in W.text_parts(batch, limit=chunk_bytes):
                data, offsets = W.text_buffer(piece.column("text"))
                ids = piece.column("doc_id")
                known = np.asarray(ids.is_valid())
                values = np.asarray(ids.fill_null(0).cast(pa.int64()))
                yield pa.RecordBatch.from_pydict({
                    "chunk": [f"{part}.{number}"], "ids": [values.tobytes()], "known": [known.tobytes()],
                    "ends": [offsets[1:].tobytes()], "text": [press.compress(data.tobytes())]})
                number += 1

    return docs.select("doc_id", "text").mapInArrow(work, CHUNKS)


class Chunk:
    """A chunk's documents and words."""

    def __init__(self, row: dict):
        self.name = row["chunk"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], np.bool_)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
        ends = np.frombuffer(row["ends"], np.int64)
        self.words = W.Words(self.data, np.concatenate(([0], ends)))
        self.hashed = self.words.hashes()
        place = np.where(self.known, self.ids, LAST)
        self.place = place
        self.rank = np.empty(len(place), np.int64)
        self.rank[np.lexsort((np.arange(len(place)), ~self.known, place))] = np.arange(len(place))

    def blocks(self, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and codes of the rolling windows of a block's size. A code
        holds the bucket and 30 further bits of the hash."""
        size = max(1, length // 2)
        starts = W.starts_in_documents(self.words, size)
        hashed = W.sequence_hashes(self.hashed, size)[starts]
        bucket = (hashed >> np.uint64(32)) % np.uint64(buckets)
        return starts, (bucket << np.uint64(30)) | (hashed & RESIDUE)

    def keys(self, length: int) -> np.ndarray:
        return W.sequence_hashes(self.hashed, length, 2)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(buckets)])), strict=True):
        if b > a:
            yield int(buckets[a]), slice(a, b)


def send_probes(length: int, buckets: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            chunk = Chunk(row)
            size = max(1, length // 2)
            starts, codes = chunk.blocks(length, buckets)
            if not len(codes):
                continue
            within = starts - chunk.words.first[chunk.words.document()[starts]]
            # the mark of an indexed block rides in the lowest bit through the sort
            tagged = np.sort((codes << np.uint64(1)) | (within % size == 0).astype(np.uint64))
            codes = tagged >> np.uint64(1)
            first = np.flatnonzero(np.diff(codes, prepend=codes[0] + np.uint64(1)))
            last = np.append(first[1:], len(codes)) - 1
            marks = (tagged[last] & np.uint64(1)).astype(np.uint8) | ((last > first).astype(np.uint8) << 1)
            codes = codes[first]
            out = {"bucket": [], "chunk": [], "codes": [], "marks": []}
            for bucket, part in _by_bucket(codes >> np.uint64(30)):
                out["bucket"].append(bucket)
                out["chunk"].append(chunk.name)
                out["codes"].append(squeeze_sorted((codes[part] & RESIDUE).astype(np.uint32)))
                out["marks"].append(squeeze(marks[part]))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("bucket", pa.int32()), ("chunk", pa.string()), ("codes", pa.binary()), ("marks", pa.binary())]))

    return work


def find_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the codes that are an indexed block and occur twice or more, for each chunk."""
    codes = [unsqueeze_sorted(x, np.uint32) for x in rows["codes"]]
    marks = np.concatenate([unsqueeze(x, np.uint8) for x in rows["marks"]])
    every = np.concatenate(codes)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    times = np.add.reduceat(1 + (marks[order] >> 1).astype(np.int64), first)
    indexed = np.maximum.reduceat(marks[order] & 1, first)
    anchor = np.empty(len(every), np.bool_)
    anchor[order] = np.repeat((times > 1) & (indexed > 0), np.diff(np.append(first, len(every))))
    out, at = [], 0
    for name, bucket, own in zip(rows["chunk"], rows["bucket"], codes, strict=True):
        hits = own[anchor[at:at + len(own)]]
        at += len(own)
        if len(hits):
            out.append((name, bucket, squeeze_sorted(hits)))
    return pd.DataFrame(out, columns=["chunk", "bucket", "codes"])


def send_windows(length: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("keys", pa.binary()), ("ids", pa.binary()),
                        ("many", pa.binary())])

    def work(chunks: pa.Table, hits: pa.Table) -> pa.Table:
        out = {name: [] for name in schema.names}
        if not chunks.num_rows or not hits.num_rows:
            return schema.empty_table()
        chunk = Chunk(chunks.to_pylist()[0])
        found = np.sort(np.concatenate([
            (np.uint64(b) << np.uint64(30)) | unsqueeze_sorted(x, np.uint32).astype(np.uint64)
            for b, x in zip(hits["bucket"].to_pylist(), hits["codes"].to_pylist(), strict=True)]))
        starts, codes = chunk.blocks(length, buckets)
        hit = np.zeros(len(chunk.words) + 1, np.int64)
        hit[starts[W.among(found, codes)] + 1] = 1
        hit = np.cumsum(hit)
        # windows of full length that hold a hit
        windows = W.starts_in_documents(chunk.words, length)
        size = max(1, length // 2)
        windows = windows[hit[windows + length - size + 1] > hit[windows]]
        if not len(windows):
            return schema.empty_table()
        keys = chunk.keys(length)[windows]
        bucket = W.sequence_hashes(chunk.hashed, length, 3)[windows] % np.uint64(buckets)
        document = chunk.words.document()[windows]
        order = np.lexsort((chunk.rank[document], keys, bucket))
        keys, bucket, document = keys[order], bucket[order], document[order]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1]))))
        many = np.diff(np.append(first, len(keys))) > 1
        keys, bucket, places = keys[first], bucket[first], chunk.place[document[first]]
        for number, part in _by_bucket(bucket):
            out["bucket"].append(number)
            out["chunk"].append(chunk.name)
            out["keys"].append(squeeze_sorted(keys[part]))
            out["ids"].append(squeeze(places[part]))
            out["many"].append(squeeze(many[part]))
        return pa.Table.from_pydict(out, schema=schema)

    return work


def find_first(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each chunk the windows that start earlier in another
    document's chunk, and the windows it holds first and several times."""
    rows = rows.sort_values("chunk")
    keys = [unsqueeze_sorted(x, np.uint64) for x in rows["keys"]]
    sizes = np.array([len(x) for x in keys])
    every = np.concatenate(keys)
    places = np.concatenate([unsqueeze(x, np.int64) for x in rows["ids"]])
    many = np.concatenate([unsqueeze(x, np.bool_) for x in rows["many"]])
    order = np.lexsort((np.repeat(np.arange(len(keys)), sizes), places, every))
    ranked = every[order]
    owner = np.empty(len(every), np.bool_)
    owner[order] = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    out, at = [], 0
    for name, own in zip(rows["chunk"], keys, strict=True):
        mine, twice = owner[at:at + len(own)], many[at:at + len(own)]
        at += len(own)
        if not mine.all() or twice.any():
            out.append((name, squeeze_sorted(own[~mine]), squeeze_sorted(own[mine & twice])))
    return pd.DataFrame(out, columns=["chunk", "later", "own"])


def joined_words(words: W.Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each document joined by one space: bytes, and offsets per document."""
    data = words.data.copy()
    data[~W.SPACED[data]] = 0x20
    document = words.document()
    stops = words.ends + (words.ends < words.offsets[document + 1])  # the separator behind a word comes along
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, words.starts[kept], 1)
    np.add.at(change, stops[kept], -1)
    taken = np.cumsum(change[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(taken, dtype=np.int64)))
    return data[taken], total[words.offsets]


def finish(length: int, texts: bool):
    def work(chunks: pa.Table, later: pa.Table) -> pa.Table:
        out = {name: [] for name in ("doc_id", "n_words", "n_removed", "kept_sha256", "repeats", "kept_text")}
        for row in chunks.to_pylist():
            chunk = Chunk(row)
            words = chunk.words
            removed = np.zeros(len(words), np.bool_)
            if later.num_rows:
                gone = np.sort(np.concatenate([unsqueeze_sorted(x, np.uint64) for x in later["later"].to_pylist()]))
                own = np.sort(np.concatenate([unsqueeze_sorted(x, np.uint64) for x in later["own"].to_pylist()]))
                windows = W.starts_in_documents(words, length)
                keys = chunk.keys(length)[windows]
                dropped = W.among(gone, keys)
                again = np.flatnonzero(W.among(own, keys) & ~dropped)
                if len(again):  # all but the first of them
                    order = again[np.lexsort((windows[again], chunk.rank[words.document()[windows[again]]], keys[again]))]
                    dropped[order[1:]] |= keys[order[1:]] == keys[order[:-1]]
                removed = W.cover(windows[dropped], length, len(words))
            gone_words = W.segment_sums(removed, words.first)
            joined, cuts = joined_words(words, ~removed)
            starts, stops = W.runs(removed & True)
            # a run that crosses documents is cut at their edges
            edges = words.first[1:-1]
            inner = edges[(edges > 0) & (edges < len(words))]
            inner = np.unique(inner[removed[inner - 1] & removed[inner]]) if len(inner) else inner
            starts, stops = np.sort(np.append(starts, inner)), np.sort(np.append(stops, inner))
            owner = np.searchsorted(words.first, starts, "right") - 1
            raw = joined.tobytes()
            spans: dict[int, list] = {}
            for d, a, b in zip(owner.tolist(), starts.tolist(), stops.tolist(), strict=True):
                spans.setdefault(d, []).append({"start": a - int(words.first[d]), "stop": b - int(words.first[d])})
            for d, (count, less) in enumerate(zip(words.counts.tolist(), gone_words.tolist(), strict=True)):
                text = raw[cuts[d]:cuts[d + 1]].removesuffix(b" ")
                out["doc_id"].append(int(chunk.ids[d]) if chunk.known[d] else None)
                out["n_words"].append(count)
                out["n_removed"].append(less)
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                out["repeats"].append(spans.get(d, []))
                out["kept_text"].append(text.decode() if texts else None)
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                            ("kept_sha256", pa.string()),
                            ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                            ("kept_text", pa.string())])
        made = pa.Table.from_pydict(out, schema=schema)
        return made if texts else made.drop_columns(["kept_text"])

    return work


def substring_dedup(docs: DataFrame, length: int = LENGTH, texts: bool = False, chunk_bytes: int = CHUNK_BYTES,
                    buckets: int | None = None) -> DataFrame:
    """A row per document: n_words, n_removed, the hash of the kept words joined
    by spaces, the removed runs as word numbers, and with ``texts`` the kept words.

    The number of buckets follows the session's shuffle partitions, which a
    cluster sets by its data; results do not depend on it, nor on the chunks.
    """
    buckets = buckets or shuffle_parts(docs.sparkSession)
    chunks = keep(pack_chunks(docs, chunk_bytes), "substring_chunks")
    probes = map_arrow(chunks, send_probes(length, buckets), PROBES)
    hits = probes.groupBy("bucket").applyInPandas(find_anchors, HITS)
    windows = (chunks.groupBy("chunk").cogroup(hits.groupBy("chunk"))
               .applyInArrow(send_windows(length, buckets), WINDOWS))
    later = windows.groupBy("bucket").applyInPandas(find_first, LATER)
    schema = RESULT + (", kept_text string" if texts else "")
    return chunks.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(finish(length, texts), schema)


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents"), LENGTH).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")
