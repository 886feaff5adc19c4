"""Token ids in Huffman-coded files.

Texts are encoded with a given public tokenizer and an end id is put behind
each. The global counts of the ids, one number per id of the vocabulary, give a
canonical Huffman code with limited code lengths. Documents are dealt out in
ranges of doc_id, so the files are in order, and written as independent blocks
of whole documents:

    shard, block       place of the block
    start              ids of the shard before the block
    doc_ids, sizes     documents of the block and their numbers of ids
    checkpoints        bit offsets of every 256th id, packed
    payload            the bits

The code lengths are a small table beside the blocks and define the code. A
block is decoded by table, all stretches between checkpoints side by side.

The tokenizer never merges across a lone space or line feed between two
characters that are not white space, nor from a letter or digit into a mark. So
a text is cut there, each distinct piece of a batch is encoded once, and pieces
met lately are kept by each worker. Tokens added to the vocabulary (such as
``<|endoftext|>``) are recognised in texts, as the tokenizer does by default.

Defined results: null and empty texts hold the end id alone; rows without
doc_id come last; rows that share a doc_id follow each other by size and ids;
further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import words as W
from tabweave.llm.frames import keep, map_arrow, shuffle_parts, table
from tabweave.llm.huffman import Code, code_lengths
from tabweave.llm.substrings import squeeze, unsqueeze
from tabweave.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END = 0
BLOCK_IDS = 1 << 18
REMEMBERED = 400_000  # distinct pieces in each of the two halves of a worker's memory

IDS = "doc_id long, n_tokens long, packed binary"
BLOCKS = ("shard int, block int, start long, n_ids long, doc_ids array<long>, sizes array<long>, checkpoints binary, "
          "payload binary")
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"

_BLANK = W._byte_set((0x09, 0x0D), (0x1C, 0x20))
_ALNUM = W._byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_MARKS = W._byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
# First bytes of characters that may be white space outside ASCII.
_MAYBE_BLANK = W._byte_set((0xC2, 0xC2), (0xE1, 0xE3))


def pieces(data: np.ndarray, offsets: np.ndarray, added: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces, and the number of pieces before each text. A token
    that ``added`` finds is a piece of its own."""
    size = len(data)
    padded = np.concatenate((np.full(3, 0x20, np.uint8), data, np.full(1, 0x20, np.uint8)))
    here = (data == 0x20) | (data == 0x0A)
    before, after = padded[2:2 + size], padded[4:4 + size]
    cut = here & ~_BLANK[before] & ~_BLANK[after] & ~_MAYBE_BLANK[after]
    cut &= ~((before >= 0x80) & (_MAYBE_BLANK[padded[1:1 + size]] | _MAYBE_BLANK[padded[:size]]))
    # a mark behind a letter or digit begins a piece as well
    letter = _ALNUM[before] | ((padded[1:1 + size] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    cut |= _MARKS[data] & letter
    raw = data.tobytes() if added else b""
    if added and added.search(raw):
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for found in added.finditer(raw, low, high):
                cut[found.start():found.end()] = False
                cut[found.start()] = True
                cut[found.end():found.end() + 1] = True
    cut[offsets[:-1][np.diff(offsets) > 0]] = True  # every text begins a piece
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


class Half:
    """Pieces and their ids on arrays: some 30 bytes a piece, a fifth of what a dict of bytes takes."""

    def __init__(self, dtype: type, pieces: pa.LargeBinaryArray | None = None, sizes: np.ndarray | None = None, ids: np.ndarray | None = None):
        self.pieces = pa.array([], pa.large_binary()) if pieces is None else pieces
        self.sizes = np.zeros(0, np.int32) if sizes is None else sizes
        self.ids = np.zeros(0, dtype) if ids is None else ids

    def __len__(self) -> int:
        return len(self.sizes)

    def find(self, wanted: pa.LargeBinaryArray) -> np.ndarray:
        """Where each wanted piece stands, -1 if nowhere."""
        return pc.fill_null(pc.index_in(wanted, value_set=self.pieces), -1).to_numpy(zero_copy_only=False)

    def with_more(self, pieces: pa.LargeBinaryArray, sizes: np.ndarray, ids: np.ndarray) -> Half:
        return Half(self.ids.dtype, pa.concat_arrays([self.pieces, pieces]),
                    np.concatenate((self.sizes, sizes.astype(np.int32))), np.concatenate((self.ids, ids)))


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of the stretches [begin, begin + size), one behind the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)


class Encoder:
    """A tokenizer with a memory of pieces, one per worker process."""

    made: dict[int, Encoder] = {}

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        added = json.loads(source).get("added_tokens") or []
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("texts are cut at added tokens, so these must be taken as they are")
        names = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.known, self.older = Half(self.dtype), Half(self.dtype)

    @classmethod
    def of(cls, source: str) -> Encoder:
        key = hash(source)
        if key not in cls.made:
            cls.made = {key: cls(source)}
        return cls.made[key]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind, and the offsets that cut them."""
        data, offsets = W.text_buffer(column)
        starts, first = pieces(data, offsets, self.added)
        back, distinct = W.codes(W.span_texts(data, starts, np.append(starts[1:], len(data))))
        begin, sizes, flat = self.look_up(distinct)
        count = sizes[back]
        cuts = np.concatenate(([0], np.cumsum(count)))[first]
        ids = np.insert(flat[_stretches(begin[back], count)], cuts[1:], END)
        return ids, cuts + np.arange(len(cuts))

    def look_up(self, distinct: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece where its ids begin, how many there are, and the ids."""
        begin, sizes = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        parts, at = [], 0
        wanted = np.arange(len(distinct))
        fresh = wanted  # not in the newer half; what is used again outlives the next turn
        for half in (self.known, self.older):
            place = half.find(distinct.take(pa.array(wanted)))
            found = place >= 0
            begin[wanted[found]] = at + (np.cumsum(half.sizes) - half.sizes)[place[found]]
            sizes[wanted[found]] = half.sizes[place[found]]
            parts.append(half.ids)
            at += len(half.ids)
            wanted = wanted[~found]
            fresh = wanted if half is self.known else fresh
        made, counts = array("H" if self.dtype is np.uint16 else "I"), []
        for k in range(0, len(wanted), 4096):
            texts = distinct.take(pa.array(wanted[k:k + 4096])).cast(pa.large_string()).to_pylist()
            for coded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                own = coded.ids
                made.extend(own)
                counts.append(len(own))
        sizes[wanted] = counts
        begin[wanted] = at + np.cumsum(sizes[wanted]) - sizes[wanted]
        flat = np.concatenate((*parts, np.frombuffer(made, self.dtype)))
        self.known = self.known.with_more(distinct.take(pa.array(fresh)), sizes[fresh], flat[_stretches(begin[fresh], sizes[fresh])])
        if len(self.known) > REMEMBERED:
            self.known, self.older = Half(self.dtype), self.known
        return begin, sizes, flat


def read_tokenizer(tokenizer: str = TOKENIZER) -> str:
    """The tokenizer's file, of a path or of a name among the public ones."""
    if not os.path.exists(tokenizer):
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    with open(tokenizer, encoding="utf-8") as file:
        return file.read()


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens and packed ids of every text."""
    source = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))  # as large as the vocabulary

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(source.value)
        for part in W.text_parts(batch):
            ids, cuts = encoder.encode(part.column("text"))
            packed = [squeeze_ids(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").cast(pa.int64()), "n_tokens": np.diff(cuts),
                "packed": pa.array(packed, pa.binary())})

    return map_arrow(docs.select("doc_id", "text"), work, IDS)


def squeeze_ids(ids: np.ndarray) -> bytes:
    import zstandard

    return bytes([ids.dtype.itemsize]) + zstandard.ZstdCompressor(level=3).compress(ids.tobytes())


def unsqueeze_ids(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), {2: np.uint16, 4: np.uint32}[data[0]])


def count_ids(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs. The driver gets a number per id of the vocabulary."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column("packed"):
                own = np.bincount(unsqueeze_ids(packed.as_py()))
                if len(own) > len(total):
                    total = np.concatenate((total, np.zeros(len(own) - len(total), np.int64)))
                total[:len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})

    rows = encoded.select("packed").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_blocks(encoded: DataFrame, lengths: np.ndarray, path: str) -> None:
    """The files: blocks of whole documents in ascending doc_id order."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = Code(lengths), TaskContext.get().partitionId()
        block = start = held = 0
        names: list = []
        parts: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            payload, checkpoints = code.encode(ids)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                "start": pa.array([start], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "sizes": pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                "checkpoints": [squeeze(np.diff(checkpoints, prepend=0))], "payload": [payload]})

        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                ids = unsqueeze_ids(packed)
                names.append(doc_id)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield made()
                    block, start, held, names, parts = block + 1, start + held, 0, [], []
        if parts:
            yield made()

    parts = shuffle_parts(encoded.sparkSession)
    order = [F.col("doc_id").asc_nulls_last(), "n_tokens", "packed"]
    ranged = encoded.repartitionByRange(parts, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(*order)
    ranged.mapInArrow(work, BLOCKS).write.parquet(f"{path}/blocks")
    spark = encoded.sparkSession
    code = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths) if n], "id int, bits int")
    code.coalesce(1).write.parquet(f"{path}/code")


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Encode ``docs`` and write code and blocks below ``path``."""
    encoded = keep(encode_documents(docs, tokenizer), "token_ids")
    write_blocks(encoded, code_lengths(count_ids(encoded)), path)


def read_code(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/code").collect()  # a row per id of the vocabulary
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return lengths


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32, and with ``with_ids`` the ids."""
    lengths = read_code(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # a row per shard, that is per task that wrote
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard] = at
        at += totals[shard]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for row in batch.to_pylist():
            ids = code.decode(row["payload"], np.cumsum(unsqueeze(row["checkpoints"], np.int64)), row["n_ids"])
            sizes = np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            raw = memoryview(ids.astype("<u4").tobytes())
            out = {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "start": pa.array(before[row["shard"]] + row["start"] + ends - sizes, pa.int64()),
                "n_tokens": pa.array(sizes),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)],
                                      pa.int64())}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return map_arrow(blocks, work, RESULT + (", ids array<int>" if with_ids else ""))


def encode_and_read(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)


def op5_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_read(table(spark, folder, "documents"))
