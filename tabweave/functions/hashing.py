"""Seeded pseudo-random columns that depend on the row alone.

``rand()`` depends on partitioning and changes when a lost task is rerun; a
hash of the row key does neither, and any SQL engine can reproduce it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK = "\\N"


def key_text(key: Sequence[str | Column]) -> Column:
    """The key columns as one text, as ``row_hash`` takes them."""
    columns = [F.col(item) if isinstance(item, str) else item for item in key]
    return F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(NULL_MARK)) for c in columns])


def row_hash(key: Sequence[str | Column], seed: object) -> Column:
    """md5 over the key columns and the seed, as 32 hex digits."""
    return F.md5(F.concat_ws("-", key_text(key), F.lit(str(seed))))


def uniform(hashed: Column, part: int = 0) -> Column:
    """A uniform in [0, 1) from one of the four 32-bit words of a hash."""
    word = F.conv(F.substring(hashed, 1 + 8 * part, 8), 16, 10)
    return word.cast("double") / F.lit(4294967296.0)


def normal_pair(hashed: Column, pair: int = 0) -> tuple[Column, Column]:
    """Two independent standard normals (Box-Muller) from half of a hash."""
    # 1 - u lies in (0, 1], so the logarithm is finite
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(hashed, 2 * pair)))
    angle = F.lit(2.0 * math.pi) * uniform(hashed, 2 * pair + 1)
    return radius * F.cos(angle), radius * F.sin(angle)


def uniform_array(hashes: pa.Array) -> np.ndarray:
    """The four uniforms of each hash of a batch, 16 bytes each: a row per word."""
    fixed = hashes.cast(pa.binary(16))
    words = np.frombuffer(fixed.buffers()[1], ">u4", 4 * len(fixed), 16 * fixed.offset)
    return words.reshape(-1, 4).T / 4294967296.0


def prefix_array(hashes: pa.Array) -> np.ndarray:
    """The first 32 bits of each hash of a batch, 32 hex digits each."""
    texts = hashes.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    digits = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]].reshape(len(texts), 32)[:, :8].astype(np.int64)
    return ((digits & 15) + 9 * (digits >> 6)) @ 16 ** np.arange(7, -1, -1)


def normal_array(uniforms: np.ndarray) -> np.ndarray:
    """Four standard normals of each hash, as ``normal_pair`` makes them."""
    radius, angle = np.sqrt(-2.0 * np.log(1.0 - uniforms[::2])), 2.0 * math.pi * uniforms[1::2]
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1).reshape(4, -1)


# rounds of md5: turns, constants and the word of the block each takes
_TURNS = [turn for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for turn in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
# hashes worked on together, and texts of one length from which this pays
_AT_ONCE = 1 << 14
_FEW = 16


def _md5_block(state: tuple, words: Sequence[np.ndarray]) -> tuple:
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            mixed = d ^ (b & (c ^ d))
        elif i < 32:
            mixed = c ^ (d & (b ^ c))
        elif i < 48:
            mixed = b ^ c ^ d
        else:
            mixed = c ^ (b | ~d)
        mixed = mixed + (a + (words[_WORD[i]] + _SINES[i]))
        a, d, c, b = d, c, b, b + ((mixed << _TURNS[i]) | (mixed >> (32 - _TURNS[i])))
    return tuple(x + y for x, y in zip(state, (a, b, c, d)))


def md5_prefixes(texts: pa.Array, endings: Sequence[str]) -> np.ndarray:
    """The first 32 bits of the md5 of every text with every ending: a row per
    text. Texts of one length are hashed together, so all arithmetic is on arrays."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    tails = [e.encode() for e in endings]
    out = np.zeros((len(texts), len(tails)), np.uint32)
    lengths = np.diff(at)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        if len(rows) < _FEW:
            for r in rows.tolist():
                text = data[at[r]:at[r + 1]].tobytes()
                out[r] = [int.from_bytes(hashlib.md5(text + t, usedforsecurity=False).digest()[:4], "big") for t in tails]
            continue
        for size in {len(t) for t in tails}:
            same = [k for k, t in enumerate(tails) if len(t) == size]
            blocks = (length + size + 8) // 64 + 1
            ends = np.zeros((len(same), 64 * blocks), np.uint8)
            for e, k in enumerate(same):
                ends[e, length:length + size + 1] = list(tails[k] + b"\x80")
            ends[:, -8:] = np.frombuffer(np.uint64(8 * (length + size)).tobytes(), np.uint8)
            ends = ends.view("<u4").T  # word, ending
            for i in range(0, len(rows), _AT_ONCE):
                some = rows[i:i + _AT_ONCE]
                body = np.zeros((len(some), 64 * blocks), np.uint8)
                body[:, :length] = data[at[some][:, None] + np.arange(length)]
                body = np.ascontiguousarray(body.view("<u4").T)  # word, text
                step = max(1, _AT_ONCE // len(some))
                for e in range(0, len(same), step):
                    part, state = slice(e, e + step), _START
                    with np.errstate(over="ignore"):
                        for k in range(0, 16 * blocks, 16):
                            # words without a byte of the text are one number per ending, those without an ending's one per text
                            state = _md5_block(state, [
                                ends[w, part, None] if 4 * w >= length else body[w] if 4 * w + 4 <= length else body[w] | ends[w, part, None]
                                for w in range(k, k + 16)])
                    first = np.broadcast_to(state[0], (len(same[part]), len(some)))
                    out[np.ix_(some, same[part])] = first.T.byteswap()
    return out
