"""Words, hashes and text buffers of whole Arrow batches at once.

The operators cut texts into words and compare word sequences. Doing that word
by word in Python costs more than the rest of a job, so these helpers work on
the bytes of a batch: one array pass finds all words, one finds all hashes.
Nothing here depends on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT_BYTES = 4 << 20  # texts worked on together


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, np.bool_)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


# Bytes of a word. Bytes from 0x80 on belong to letters outside ASCII.
SPACED = ~_byte_set((0x20, 0x20), (0x09, 0x0D))
LETTERS = ~_byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets that cut them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def text_parts(batch: pa.RecordBatch, name: str = "text", limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of at most ``limit`` bytes of text (or one row)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0))
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Where the words of a batch lie: ``starts`` and ``ends`` in bytes,
    ``first[d]`` the number of words before document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED):
        self.data, self.offsets = data, offsets
        is_word = inside[data]
        edge = np.zeros(len(data) + 1, np.bool_)
        edge[offsets] = True  # a text ends every word
        before = np.zeros(len(data), np.bool_)
        before[1:] = is_word[:-1]
        self.starts = np.flatnonzero(is_word & (~before | edge[:-1]))
        after = np.zeros(len(data), np.bool_)
        after[:-1] = is_word[1:]
        self.ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, seed)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(seed: int, count: int) -> np.ndarray:
    """``count`` fixed 64-bit numbers of a seed."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    return mix(start + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


LONG_SPAN = 1024  # bytes from which a span is hashed by itself


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number (zeros behind the end)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span.

    Every eight bytes are mixed into two lanes before the next eight come in,
    so no sum over bytes can cancel out; long spans go through BLAKE2.
    """
    eight = _words_at(data)
    keys = numbers(seed, 4)
    length = (ends - starts).astype(np.int64)
    fold = length.astype(np.uint64)
    one, two = mix(fold + keys[0]), mix(fold ^ keys[1])
    long = np.flatnonzero(length > LONG_SPAN)
    left = np.flatnonzero((length > 0) & (length <= LONG_SPAN))
    at, rest = starts[left], length[left]
    while len(left):
        part = eight[at]
        short = rest < 8
        part[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        one[left] = mix(one[left] ^ part)
        two[left] = mix(two[left] * (keys[2] | np.uint64(1)) + part)
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    key = keys.tobytes()
    for k in long.tolist():
        whole = hashlib.blake2b(data[starts[k]:ends[k]].tobytes(), digest_size=16, key=key).digest()
        one[k], two[k] = np.frombuffer(whole, np.uint64)
    return mix(one + two * keys[3])


def span_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The spans (ascending, without overlap) as Arrow values."""
    length = (ends - starts).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(length)))
    change = np.zeros(len(data) + 1, np.int8)
    filled = length > 0
    change[starts[filled]] += 1
    change[ends[filled]] -= 1  # filled spans end at places of their own
    inside = np.cumsum(change[:-1], dtype=np.int8).view(np.bool_) if len(data) else np.zeros(0, np.bool_)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal just where the values are, and the distinct values by number."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def pair_codes(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs of small numbers: codes, and the first place of each pair."""
    room = int(right.max()) + 1 if len(right) else 1
    made, distinct = codes(pa.array(left.astype(np.int64) * room + right))
    first = np.full(len(distinct), -1, np.int64)
    first[made[::-1]] = np.arange(len(made))[::-1]
    return made, first


def sequence_hashes(items: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of ``length`` consecutive numbers (hashes) from each place on.

    Places with fewer numbers behind them are left out, so the result has
    ``len(items) - length + 1`` entries. Whether a sequence stays within one
    document is the caller's to check. Halves are joined by mixing, not by sums.
    """
    total = len(items) - length + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    key = int(numbers(seed, 1)[0]) | 1

    def joined(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
        return mix(left * np.uint64(key) + (right ^ np.uint64((key >> 7) + size)))

    out, have, piece, size, left = None, 0, mix(items ^ np.uint64(key >> 1)), 1, length
    while left:  # binary doubling: hashes of 1, 2, 4, ... items joined up
        if left & 1:
            shifted = piece[have:have + total]
            out = shifted if out is None else joined(out, shifted, size)
            have += size
        left >>= 1
        if left:
            piece = joined(piece[:len(piece) - size], piece[size:], size)
            size *= 2
    return mix(out)


def starts_in_documents(words: Words, length: int) -> np.ndarray:
    """The words at which ``length`` consecutive words of one document begin."""
    return np.flatnonzero(words.room() >= length)


def cover(starts: np.ndarray, length: int | np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a run of ``length`` from one of the starts."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:total]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def among(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted value whether the sorted array has it."""
    if len(sorted_values) == 0:
        return np.zeros(len(wanted), np.bool_)
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == wanted


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the segments that ``first`` cuts (empty ones are 0)."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]
