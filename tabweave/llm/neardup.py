"""MinHash near-dedup with SuperMinHash signatures.

1. Each text becomes a set of hashed shingles and a SuperMinHash signature: per
   element the ranks of a random permutation of the slots, plus a fraction, so
   that the slots of one element differ by construction. An element stops as
   soon as its next rank is above every slot's value, so a long text costs
   little more than one step per shingle.
2. Equal sets are one class; only classes go on.
3. Signatures are cut into bands; classes that share a band form a bucket.
   Every member is compared with the bucket's smallest id: a link per member,
   never all pairs. Links are confirmed on the full sets.
4. Union-find joins the links into components.
5. A bucket whose members are still in several components gets its members
   outside the largest one compared with all others, signature against
   signature, in blocks spread over tasks. Members that the signatures leave
   open meet again with their full sets, and links found there are joined in.
   Only members and links travel, no pairs; after that no shared bucket holds
   an unchecked pair in different components.

With 25 bands of 5 slots a pair at similarity 0.85 is missed with a chance of
4e-7, and a signature estimate that far below the truth has a chance below
1e-5.

Defined results: null and empty texts have an empty set, link with nothing and
are kept; a text of fewer than five words has one shingle; repeated rows share
a class; rows that share a doc_id but not a text follow their own texts; rows
without doc_id take no part (component null, kept); further columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import words as W
from tabweave.llm.frames import keep, map_arrow, shuffle_parts, table
from tabweave.llm.substrings import squeeze_sorted, unsqueeze_sorted

SHINGLE = 5
SIMILARITY = 85  # per cent
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
DOUBT = 4.5  # standard deviations that an estimate may lie below the threshold
BLOCK = 256  # signatures compared with as many others in one step

SETS = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def shingle_sets(column: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the offsets that cut them."""
    data, offsets = W.text_buffer(column)
    words = W.Words(W.LOWER[data], offsets)
    hashed = words.hashes()
    every = W.sequence_hashes(hashed, length, 10)
    parts, counts = [], words.counts
    short = {k: W.sequence_hashes(hashed, k, 10 + k) for k in range(1, length)}
    for first, count in zip(words.first[:-1].tolist(), counts.tolist(), strict=True):
        if count >= length:
            own = np.sort(every[first:first + count - length + 1])
            parts.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            parts.append(short[count][first:first + 1] if count else every[:0])
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), first


def superminhash(items: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A signature of 64-bit values (rank in the high half) for each set."""
    sets = len(first) - 1
    signature = np.full(sets * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(first))
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    salts = W.numbers(77, slots)

    def draw(values: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        drawn = W.mix(values ^ salts[step])
        spot = step + (((drawn & low) * np.uint64(slots - step)) >> half).astype(np.int64)
        return spot, (np.uint64(step) << half) | (drawn >> half)

    spot, value = draw(items, 0)
    np.minimum.at(signature, owner * slots + spot, value)
    open_sets = (signature.reshape(sets, slots) >> half).max(axis=1) > 0 if sets else np.zeros(0, np.bool_)
    going = np.flatnonzero(open_sets[owner])
    for at in range(0, len(going), 1 << 16):  # sets may be cut here: a slot only ever takes the least value
        part = going[at:at + (1 << 16)]
        ranks = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(part), 1))
        row, values, mine = np.arange(len(part)), items[part], owner[part]
        ranks[row, spot[part]] = 0
        ranks[row, 0] = spot[part]
        for step in range(1, slots):
            full = signature.reshape(sets, slots)[np.unique(mine)].max(axis=1) >> half < step
            done = np.unique(mine)[full]
            if len(done):
                stay = ~np.isin(mine, done)
                row, values, mine = row[stay], values[stay], mine[stay]
            if not len(row):
                break
            place, value = draw(values, step)
            slot = ranks[row, place]
            ranks[row, place] = ranks[row, step]
            ranks[row, step] = slot
            np.minimum.at(signature, mine * slots + slot, value)
    return signature.reshape(sets, slots)


def _segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[first[1:]] - total[first[:-1]]


def read_sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in W.text_parts(batch, limit=2 << 20):
        items, first = shingle_sets(part.column("text"))
        size = np.diff(first)
        signature = W.mix(superminhash(items, first)).astype(np.uint32)
        # a set's own two hashes: sums over its elements, whatever their order
        ids = [_segment_sum(W.mix(items ^ s), first).view(np.int64) for s in W.numbers(78, 2)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": part.column("doc_id").cast(pa.int64()), "n_shingles": size, "set_a": ids[0], "set_b": ids[1],
            "signature": pa.array([s.tobytes() if n else None for s, n in zip(signature, size, strict=True)], pa.binary())})


def cut_bands(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rep = np.asarray(batch.column("rep"))
    if not len(rep):
        return
    slots = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(len(rep), BANDS, ROWS)
    key = np.zeros((len(rep), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + slots[:, :, k])
    band = np.tile(np.arange(BANDS, dtype=np.int32), len(rep))
    yield pa.RecordBatch.from_pydict({"key": key.reshape(-1).view(np.int64), "band": band, "rep": np.repeat(rep, BANDS)})


def least_agreement(similarity: int = SIMILARITY) -> int:
    """Equal slots below which a pair is surely less similar than the threshold."""
    p = similarity / 100
    return max(0, int(np.floor(SLOTS * p - DOUBT * np.sqrt(SLOTS * p * (1 - p)))))


def agreement(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures do not rule the link out."""
    a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint32).reshape(-1, SLOTS) for n in ("sig_a", "sig_b"))
    ok = (a == b).sum(axis=1) >= least_agreement()
    yield pa.RecordBatch.from_pydict({n: batch.column(n).filter(pa.array(ok)) for n in ("a", "b")})


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, ascending, are a link."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    both = int(W.among(large, small).sum())
    return 100 * both >= SIMILARITY * (len(x) + len(y) - both)


def confirm(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pairs linked by their full sets."""
    ok = [similar(unsqueeze_sorted(x, np.uint64), unsqueeze_sorted(y, np.uint64))
          for x, y in zip(batch.column("set_x").to_pylist(), batch.column("set_y").to_pylist(), strict=True)]
    yield pa.RecordBatch.from_pydict({n: batch.column(n).filter(pa.array(ok, pa.bool_())) for n in ("a", "b")})


def full_sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in W.text_parts(batch, limit=2 << 20):
        items, first = shingle_sets(part.column("text"))
        packed = [squeeze_sorted(items[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"rep": part.column("rep"), "packed": pa.array(packed, pa.binary())})


def union_find(links: DataFrame) -> DataFrame:
    """node, root (the smallest id reachable) for every node of the links a, b.

    Each task first runs union-find over its own links and passes on a forest,
    at most one link per node it saw. Labels then travel along the forest and
    jump to the label of their label, until nothing changes; the number of
    rounds grows with the logarithm of the longest path.
    """
    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, top(x)) for x in parent if top(x) != x]
        yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    links = keep(links.mapInPandas(forest, "a long, b long"), "forest")
    ways = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = keep(ways.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    while True:
        near = (ways.join(labels.select(F.col("node").alias("other"), "root"), "other")
                .groupBy("node").agg(F.min("root").alias("best")))
        better = labels.join(near, "node").select("node", "root", F.least("root", "best").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        moved = better.join(jump, "via", "left").select(
            "node", F.least("via", "far").alias("root"), (F.least("via", "far") < F.col("root")).alias("changed"))
        moved = keep(moved, "labels")
        labels = moved.select("node", "root")
        if moved.where("changed").limit(1).count() == 0:
            return labels


def _attach(pairs: DataFrame, side: DataFrame, value: str, x: str, y: str) -> DataFrame:
    """``value`` of both ends of the pairs. These tables grow with the input, so
    they are merged at every size; adaptive execution splits hot ids."""
    return (pairs.join(side.select(F.col("rep").alias("a"), F.col(value).alias(x)).hint("merge"), "a")
            .join(side.select(F.col("rep").alias("b"), F.col(value).alias(y)).hint("merge"), "b"))


def read_full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, packed set of the wanted classes; a class is read from a row of its smallest doc_id."""
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id").select(
        F.col("doc_id").alias("rep"), "text")
    return keep(map_arrow(texts, full_sets, "rep long, packed binary"), "sets")


def leader_links(members: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the members of each bucket with its leader."""
    pairs = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    close = map_arrow(_attach(pairs, classes, "signature", "sig_a", "sig_b"), agreement, "a long, b long")
    return keep(map_arrow(_attach(close, sets, "packed", "set_x", "set_y"), confirm, "a long, b long"), "links")


def by_group(work, columns: tuple[str, ...]):
    """A function for mapInPandas over rows sorted by ``columns`` that hands whole groups to ``work``."""
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            frame = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
            key = frame[list(columns)].to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
            made = [work(frame.iloc[s:e]) for s, e in zip(edges[:-2], edges[1:-1], strict=True)]
            carried = frame.iloc[edges[-2]:]
            if made:
                yield pd.concat(made, ignore_index=True)
        if carried is not None:
            yield work(carried)

    return over


BLOCK_KEYS = ("key", "i", "j")


def close_pairs(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Of two blocks of a bucket: for each member outside the main component
    the members of other components that the signatures do not rule out. A pair
    is looked at in the first band it shares, in one of its two orders."""
    needed = least_agreement()
    sig = np.frombuffer(b"".join(group["signature"]), np.uint32).reshape(-1, SLOTS)
    rep, comp, block, band = (group[c].to_numpy() for c in ("rep", "comp", "block", "band"))
    minor = comp != group["main"].to_numpy()
    same = group["i"].iat[0] == group["j"].iat[0]
    for x in np.flatnonzero(minor).tolist():
        y = np.flatnonzero((comp != comp[x]) & ((block != block[x]) | same) & (~minor | (rep > rep[x])))
        equal = sig[y] == sig[x]
        close = equal.sum(axis=1) >= needed
        y, equal = y[close], equal[close].reshape(-1, BANDS, ROWS).all(axis=2)
        yield x, y[equal.argmax(axis=1) == band[x]] if len(y) else y


def open_members(members: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """Members that are close to a member of another component, by pairs of blocks.

    ``members``: key, band, rep, comp of buckets with several components.
    Members of the largest component are not compared with each other. Blocks
    meet in tasks of bounded size, and what comes out is a row per member and
    pair of blocks, not per pair of members.
    """
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", "comp"))["comp"].alias("main"))
    buckets = buckets.withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("int"))
    placed = members.join(buckets.hint("merge"), "key").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.join(classes.select("rep", "signature").hint("merge"), "rep")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = (placed.select("key", "band", "rep", "comp", "main", "block", "signature", other.alias("other"))
              .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block",
                      "rep", "comp", "main", "signature"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        taken = np.zeros(len(group), np.bool_)
        for x, y in close_pairs(group):
            taken[y] = True
            taken[x] |= len(y) > 0
        return group[taken]

    return (spread.repartition(parts, *BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)
            .mapInPandas(by_group(work, BLOCK_KEYS), spread.schema))


def open_links(opened: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Links between components, confirmed on full sets where the blocks meet;
    of links that join the same components in one task the first is enough."""
    def work(group: pd.DataFrame) -> pd.DataFrame:
        rep, comp, packed = group["rep"].to_numpy(), group["comp"].tolist(), group["packed"].tolist()
        unpacked: dict[int, np.ndarray] = {}
        joined: dict[int, int] = {}
        a, b = [], []

        def top(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        def full(k: int) -> np.ndarray:
            if k not in unpacked:
                unpacked[k] = unsqueeze_sorted(packed[k], np.uint64)
            return unpacked[k]

        for x, near in close_pairs(group):
            for y in near.tolist():
                p, q = top(comp[x]), top(comp[y])
                if p != q and similar(full(x), full(y)):
                    joined[max(p, q)] = min(p, q)
                    a.append(rep[x])
                    b.append(rep[y])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    with_sets = opened.join(sets.hint("merge"), "rep")
    return keep(with_sets.repartition(parts, *BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)
                .mapInPandas(by_group(work, BLOCK_KEYS), "a long, b long"), "open_links")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of doc_id, text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = keep(map_arrow(docs, read_sets, SETS), "shingles")
    sets = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    classes = keep(sets, "classes")
    bands = map_arrow(classes.select("rep", "signature"), cut_bands, "key long, band int, rep long")
    buckets = (bands.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n"))
               .where("n > 1").select("key", "leader"))
    members = keep(bands.join(buckets.hint("merge"), "key"), "members")
    sets = read_full_sets(docs, members.select("rep").distinct())
    links = leader_links(members, classes, sets)
    roots = union_find(links)
    placed = (members.join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
              .select("key", "band", "rep", F.coalesce("root", "rep").alias("comp")))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    unsettled = keep(placed.join(mixed.select("key").hint("merge"), "key"), "unsettled")
    parts = shuffle_parts(spark)
    roots = union_find(links.unionByName(open_links(open_members(unsettled, classes, parts), sets, parts)))
    of_class = (classes.select("set_a", "set_b", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
                .select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), F.coalesce("root", "rep").alias("_root")))
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "set_a", "set_b")
    joined = full.join(of_class, (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b"))).select(
        "doc_id", "n_shingles", F.col("_root").alias("component_id"))
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return components(table(spark, folder, "documents"))
