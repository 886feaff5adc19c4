"""Canonical length-limited Huffman codes over token ids, vectorised."""

from __future__ import annotations

import numpy as np

LIMIT = 18  # longest code in bits
STEP = 256  # ids between two checkpoints


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best code length for each id with none above ``limit`` (0: id does not occur), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    # each level merges the ids with pairs of the level below; only how many ids
    # come before the cut of a level is needed to read off the lengths
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate((weight, packages))
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(weight))
        values = merged[rank]
        pairs = len(values) // 2
        packages = values[0:2 * pairs:2] + values[1:2 * pairs:2]
    take = 2 * len(order) - 2
    for is_id in reversed(levels):
        ids = int(is_id[:take].sum())
        lengths[order[:ids]] += 1
        take = 2 * (take - ids)
    return lengths


class Code:
    """Codes by id, and the decoding table indexed by the next ``limit`` bits."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.limit = max(1, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        size = np.int64(1) << (self.limit - self.lengths[order])
        ends = np.cumsum(size)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (ends - size) >> (self.limit - self.lengths[order])
        self.symbol = np.zeros(1 << self.limit, np.int32)
        filled = int(ends[-1]) if len(order) else 0
        self.symbol[:filled] = np.repeat(order, size)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of the ids, and the bit offset of every ``STEP``-th id."""
        length = self.lengths[ids]
        stop = np.cumsum(length)
        at = stop - length
        words = np.zeros((int(stop[-1]) >> 5) + 2 if len(ids) else 0, np.uint64)
        if len(ids):
            # an id lies in the 64 bits from its 32-bit word on
            placed = self.codes[ids] << (64 - (at & 31) - length).astype(np.uint64)
            word = at >> 5
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] += np.add.reduceat(placed >> np.uint64(32), first)
            words[word[first] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes(), at[::STEP]

    def decode(self, data: bytes, checkpoints: np.ndarray, count: int) -> np.ndarray:
        """``count`` ids; all stretches between checkpoints advance together."""
        words = np.concatenate((np.frombuffer(data, ">u4").astype(np.uint64), np.zeros(2, np.uint64)))
        at = checkpoints.astype(np.int64)
        out = np.zeros((STEP, len(at)), np.int32)
        mask, shift = np.uint64((1 << self.limit) - 1), 64 - self.limit
        left = np.minimum(STEP, count - np.arange(len(at)) * STEP)
        for k in range(int(left.max(initial=0))):
            word = np.minimum(at >> 5, len(words) - 2)
            window = (words[word] << np.uint64(32)) | words[word + 1]
            symbol = self.symbol[(window >> (shift - (at & 31)).astype(np.uint64)) & mask]
            out[k] = symbol
            at = at + self.lengths[symbol]
        return out.T.reshape(-1)[:count]
