"""A Merkle manifest of a table, with proofs by octopus multiproofs.

Every row is a leaf: the hash of its fields. The leaves of a group (a source), in
order, make a tree with up to ``FAN`` children a node; the groups' roots make a
tree over the groups. The root stands for the table, and the proof of a row is
the list of siblings on the way up to it.

Leaves are sorted into ranges of bounded size, whatever group they belong to:

1. A range knows where its leaves lie in their group from counts alone. It hashes
   every node below which it holds all leaves and hands on the edge nodes, those
   whose parent it cannot hash: at most 2 * (FAN - 1) for a level and group.
2. The nodes above are hashed level by level from edge nodes, which are few.
3. The nodes that the proofs of all leaves of a range need and that the range
   cannot derive are its octopus multiproof: the minimal union of missing node
   coordinates. It follows from the range's ends, is fetched in one join, and
   the range derives the shared interiors and expands its leaves' proofs.

The groups' roots go through the same steps as leaves of one more tree. A third
of all rows in one group is nothing special: the group has more ranges.

A hash is SHA-256 over the children's digests as lowercase hex text, joined; in
tables digests are kept as 32 bytes.

Defined results: a null field is ``-``, another its number of UTF-8 bytes, a
colon and itself; leaves ascend by id (null first), rows that share an id by
leaf, and equal leaves are equal rows, whose proofs may be dealt out among them
in any order; a group of one leaf has that leaf as its root, and a proof of no
siblings is the hash of nothing; further columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm.frames import keep, shuffle_parts, table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RANGE_LEAVES = 1 << 17  # about the most leaves of a range
FEW_LEAVES = 1 << 12  # ranges are not made smaller than this for the sake of more tasks

NODES = "tree string, level int, at long, size long, digest binary"
MISSING = "part int, tree string, level int, at long"
PROVEN = ("part int, tree string, id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean, proof array<struct<left:array<string>,right:array<string>>>")


def leaf_digest(values: dict[str, Column]) -> Column:
    """The hash of a row's fields."""
    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(told(v) for v in values.values())), 256))


# Nodes of one tree. ``size`` is the number of nodes of a level.

def climb(digests: list[bytes], at: int, size: int, fan: int) -> list[tuple[int, list[bytes], int]]:
    """Levels (first place, digests in hex, size) of what a run of neighbouring nodes lets one hash."""
    levels = [(at, digests, size)]
    while size > 1:
        at, digests, _ = levels[-1]
        end = at + len(digests)
        up = -(-size // fan)
        low, high = -(-at // fan), up if end == size else end // fan
        if high <= low:
            break
        levels.append((low, [_hash(digests[p * fan - at:min((p + 1) * fan, size) - at]) for p in range(low, high)], up))
        size = up
    return levels


def edges(levels: list[tuple[int, list[bytes], int]], fan: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(level, place, size, digest) of the nodes without a parent among the levels."""
    for k, (at, digests, size) in enumerate(levels):
        low, high = 0, 0
        if k + 1 < len(levels):
            low = levels[k + 1][0] * fan - at
            high = min((levels[k + 1][0] + len(levels[k + 1][1])) * fan, size) - at
        for i in (*range(low), *range(high, len(digests))):
            yield k, at + i, size, digests[i]


def missing(at: int, count: int, size: int, fan: int) -> list[tuple[int, int]]:
    """The fewest further nodes (level, place) that the proofs of a run of leaves need."""
    out, end, level = [], at + count, 0
    while size > 1:
        low, high = at // fan, -(-end // fan)
        out += [(level, p) for p in (*range(low * fan, at), *range(end, min(high * fan, size)))]
        at, end, size, level = low, high, -(-size // fan), level + 1
    return out


def _hash(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests)).hexdigest().encode()


def expand(digests: list[bytes], at: int, size: int, fetched: dict[tuple[int, int], bytes], fan: int):
    """The tree's root, and of each leaf of the run the steps (left, right) up to it, as joined siblings."""
    levels, level, own, count = [], 0, digests, size
    low = at
    while size > 1:
        first, last = low // fan, -(-(low + len(own)) // fan)
        start, stop = first * fan, min(last * fan, size)
        known = ([fetched[level, p] for p in range(start, low)] + own
                 + [fetched[level, p] for p in range(low + len(own), stop)])
        runs = [b"".join(known[k:k + fan]) for k in range(0, len(known), fan)]
        levels.append((first, runs))
        own = [sha256(r).hexdigest().encode() for r in runs]
        low, size, level = first, -(-size // fan), level + 1
    steps: dict[int, list[tuple[bytes, bytes]]] = {}

    def above(parent: int) -> list[tuple[bytes, bytes]]:
        """Steps of a node of level 1."""
        if parent not in steps:
            path, p = [], parent
            for first, runs in levels[1:]:
                run, i = runs[p // fan - first], 64 * (p % fan)
                path.append((run[:i], run[i + 64:]))
                p //= fan
            steps[parent] = path
        return steps[parent]

    def path(k: int) -> list[tuple[bytes, bytes]]:
        if count == 1:
            return []
        p = at + k
        run, i = levels[0][1][p // fan - levels[0][0]], 64 * (p % fan)
        return [(run[:i], run[i + 64:]), *above(p // fan)]

    return own[0], path


def _digests(column: pa.ChunkedArray) -> list[bytes | None]:
    return [None if d is None else d.hex().encode() for d in column.to_pylist()]


class Forest:
    """Trees over the rows of ``leaves`` (tree, id, leaf, claimed), ``id`` in their order."""

    def __init__(self, leaves: DataFrame, order: list[Column], fan: int = FAN):
        spark = leaves.sparkSession
        self.fan = fan
        total = leaves.count()
        parts = max(1, min(shuffle_parts(spark), total // FEW_LEAVES), math.ceil(total / RANGE_LEAVES))
        laid = leaves.repartitionByRange(parts, "tree", *order, "leaf", F.rand(1)).sortWithinPartitions("tree", *order, "leaf")
        # a row's place in its range: the rows of a range are sorted, and these numbers ascend
        laid = laid.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
        self.leaves = keep(laid, "leaves")
        counts = self.leaves.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("count"))
        whole = Window.partitionBy("tree")
        before = F.sum("count").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        self.runs = keep(counts.select("part", "tree", "count", F.coalesce(before, F.lit(0)).cast("long").alias("at"),
                                       F.sum("count").over(whole).alias("size")), "runs")
        self.nodes = self._nodes()
        self.subroots = self.nodes.where("size = 1").select("tree", F.col("digest").alias("subroot"))

    def _nodes(self) -> DataFrame:
        fan = self.fan

        def work(leaves: pa.Table, runs: pa.Table) -> pa.Table:
            leaves, out = leaves.sort_by("row"), []
            at = 0
            for run in sorted(runs.to_pylist(), key=lambda r: r["tree"].encode()):
                own = _digests(leaves.column("leaf").slice(at, run["count"]))
                at += run["count"]
                out += [(run["tree"], *node) for node in edges(climb(own, run["at"], run["size"], fan), fan)]
            tree, level, place, size, digest = zip(*out, strict=True) if out else ((),) * 5
            return pa.table({"tree": pa.array(tree, pa.string()), "level": pa.array(level, pa.int32()), "at": pa.array(place, pa.int64()),
                             "size": pa.array(size, pa.int64()), "digest": pa.array([bytes.fromhex(d.decode()) for d in digest], pa.binary())})

        made = [keep(self.leaves.select("part", "row", "leaf").groupBy("part").cogroup(self.runs.groupBy("part")).applyInArrow(work, NODES), "edges")]
        largest = self.runs.agg(F.max("size")).first()[0] or 1
        level, child = 0, F.struct("at", F.lower(F.hex("digest")).alias("digest"))
        while largest > 1:
            here = reduce(DataFrame.unionByName, made).where((F.col("level") == level) & (F.col("size") > 1))
            joined = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["digest"]), "")
            above = here.groupBy("tree", F.floor(F.col("at") / fan).cast("long").alias("up"), "size").agg(F.unhex(F.sha2(joined, 256)).alias("digest"))
            made.append(keep(above.select("tree", F.lit(level + 1).alias("level"), F.col("up").alias("at"),
                                          F.ceil(F.col("size") / fan).cast("long").alias("size"), "digest"), "nodes"))
            level, largest = level + 1, -(-largest // fan)
        return reduce(DataFrame.unionByName, made)

    def kits(self) -> DataFrame:
        """A row per range and tree: its run, and the fetched nodes of its multiproof."""
        fan = self.fan

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for runs in batches:
                rows = [(r.part, r.tree, *m) for r in runs.itertuples() for m in missing(r.at, r.count_, r.size_, fan)]
                yield pd.DataFrame(rows, columns=["part", "tree", "level", "at"])

        runs = self.runs.withColumnsRenamed({"count": "count_", "size": "size_"})
        wanted = runs.mapInPandas(work, MISSING)
        fetched = wanted.join(self.nodes.drop("size"), ["tree", "level", "at"]).groupBy("part", "tree").agg(
            F.collect_list(F.struct("level", "at", "digest")).alias("fetched"))
        return self.runs.join(fetched, ["part", "tree"], "left")

    def proofs(self, kits: DataFrame, full: bool = False) -> DataFrame:
        """Of each leaf its proof up to the root, and where its claimed leaf leads.

        ``kits`` may bring ``above``: the steps from the tree's root on, and ``root``.
        """
        fan = self.fan

        def work(leaves: pa.Table, kits: pa.Table) -> pa.Table:
            leaves, begin = leaves.sort_by("row"), 0
            out = {name: [] for name in ("tree", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof")}
            for kit in sorted(kits.to_pylist(), key=lambda r: r["tree"].encode()):
                own = leaves.slice(begin, kit["count"])
                begin += kit["count"]
                given, claimed = _digests(own.column("leaf")), _digests(own.column("claimed"))
                fetched = {(n["level"], n["at"]): n["digest"].hex().encode() for n in kit["fetched"] or []}
                subroot, path = expand(given, kit["at"], kit["size"], fetched, fan)
                top = [("".join(s["left"]).encode(), "".join(s["right"]).encode()) for s in kit["above"]] if "above" in kit else []
                root = kit["root"].encode() if "root" in kit else subroot
                for k, leaf in enumerate(given):
                    steps = [*path(k), *top]
                    node, proof = claimed[k] or leaf, sha256()
                    for left, right in steps:
                        proof.update(left)
                        proof.update(right)
                        node = sha256(left + node + right).hexdigest().encode()
                    for name, value in (("tree", kit["tree"]), ("leaf", leaf.decode()), ("subroot", subroot.decode()), ("root", root.decode()),
                                        ("proof_sha256", proof.hexdigest()), ("folded_root", node.decode()), ("verified", node == root)):
                        out[name].append(value)
                    out["proof"].append([{"left": _cut(a), "right": _cut(b)} for a, b in steps] if full else None)
            step = pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
            kinds = {"verified": pa.bool_(), "proof": pa.list_(step)}
            made = {name: pa.array(values, kinds.get(name, pa.string())) for name, values in out.items()}
            return pa.table({"part": leaves.column("part"), "tree": made.pop("tree"), "id": leaves.column("id"), **made})

        return self.leaves.select("part", "row", "id", "leaf", "claimed").groupBy("part").cogroup(kits.groupBy("part")).applyInArrow(work, PROVEN)


def _cut(joined: bytes) -> list[str]:
    return [joined[i:i + 64].decode() for i in range(0, len(joined), 64)]


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, full: bool = False, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and (with
    ``full``) proof of every row.

    ``claimed``: what a reader holds in place of some fields. ``folded_root`` is
    the root that the claimed row and the proof lead to.
    """
    fields = {name: F.col(name) for name in FIELDS}
    own = leaf_digest(fields)
    other = leaf_digest({**fields, **claimed}) if claimed else own
    # a null source comes first, so the others get a letter in front
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("long").alias("number"),
                         own.alias("leaf"), other.alias("claimed"))
    leaves = keep(leaves.withColumn("claimed", F.when(F.col("claimed") != F.col("leaf"), F.col("claimed"))), "digests")
    low = Forest(leaves, [F.asc_nulls_first("number")], fan)
    tops = low.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("subroot").alias("leaf"), F.lit(None).cast("binary").alias("claimed"))
    high = Forest(tops, [F.asc("id")], fan)
    above = keep(high.proofs(high.kits(), full=True).select(F.col("id").alias("tree"), F.col("proof").alias("above"), "root"), "tops")
    made = low.proofs(keep(low.kits().join(above, "tree"), "kits"), full)
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if full else [])]
    return made.select(F.col("id").cast("long").alias("doc_id"), *names)


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(*FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return manifest(docs, {"text": F.when(tampered, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))})


def _sql(levels: int = 5, tops: int = 3) -> str:
    """SQL for sources of up to 16**levels rows and up to 16**tops sources."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
                                       for c in (text if name == "text" else name for name in FIELDS)) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))"
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), "
           f"lambda y: ascii(y)::BIGINT)), lambda c, x: {bits}))")
    sql = [f"""WITH a AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {leaf('text')} AS leaf, {leaf(lower)} AS other, {crc} AS crc FROM documents)""",
           """low0 AS (SELECT tree, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
                       count(*) OVER (PARTITION BY tree) AS s FROM a)""",
           """f0 AS (SELECT *, CASE WHEN crc % 5 = 0 THEN other ELSE leaf END AS node, '' AS proof,
                     row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM a)"""]
    step = 0

    def climb(name: str, count: int, tree: str, place: str) -> None:
        nonlocal step
        for k in range(count):
            sql.append(f"""{name}{k + 1} AS (SELECT tree, p // 16 AS p, (s + 15) // 16 AS s,
                CASE WHEN s = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY p)) END AS digest
                FROM {name}{k} GROUP BY tree, p // 16, s)""")
            sql.append(f"""{name}_sides{k} AS (SELECT tree AS t, p AS q, s,
                coalesce(string_agg(digest, '') OVER (PARTITION BY tree, p // 16 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(digest, '') OVER (PARTITION BY tree, p // 16 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM {name}{k})""")
            sql.append(f"""f{step + 1} AS (SELECT f.* REPLACE (CASE WHEN s > 1 THEN proof || l || r ELSE proof END AS proof,
                CASE WHEN s > 1 THEN sha256(l || node || r) ELSE node END AS node, {place} // 16 AS {place})
                FROM f{step} f JOIN {name}_sides{k} ON {tree} = t AND {place} = q)""")
            step += 1

    climb("low", levels, "tree", "p")
    sql.append(f"subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS p FROM low{levels})")
    sql.append("high0 AS (SELECT '' AS tree, subroot AS digest, p, count(*) OVER () AS s FROM subroots)")
    sql.append(f"f{step + 1} AS (SELECT f.*, subroot, subroots.p AS o FROM f{step} f JOIN subroots USING (tree))")
    step += 1
    climb("high", tops, "''", "o")
    sql.append(f"""top AS (SELECT digest AS root FROM high{tops})
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{step}, top""")
    return ",\n".join(sql)


OP11_SQL = _sql()
