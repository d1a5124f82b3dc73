"""Conversation prefix tries in succinct level order.

1. rebuilt() numbers the turns of every conversation by range of the sorted table, so that one long conversation lies in many
   tasks, and puts the first turns of its hundred's first conversation before its own.
2. A prefix is known by the XOR of 128-bit hashes of (turn, place), summed by chunks of CHUNK places first; a node is a prefix,
   with its members counted before they are shuffled.
3. Nodes with at most CAP rows at and below them are light. The topmost light nodes are the roots of the shards; a shard holds
   about CAP nodes: many small subtrees, side by side below a node that stands for what is above them.
4. A shard becomes a LOUDS bit vector (in level order, a one per child and a zero to end each node) with label and value arrays,
   written as a row. Parents are read back from the bits; from the last level up, np.add.at adds every level to its parents.
5. The heavy nodes above are merged apart: what the shards' roots and the heavy nodes hold is added from the deep end along the
   path of each smallest member, by chunks, then summed by node.
6. The ids that end at a node are sorted by range, joined in pieces of PIECE ids and hashed piece by piece.

Defined results: rows without conv_id take no part; a null role or text is empty; turns stand in order, null first, equal ones
by role, by the first characters of the text and by a hash of it; repeated rows are turns of their own; % keeps the sign of
conv_id; an empty table has no nodes. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

CAP, CHUNK, PIECE, RANGE, SHARED, TURNS = 1 << 16, 4096, 4096, 1 << 18, 100, 6
KEY = ("depth", "k1", "k2")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv, part (of the sorted table), place (before it in the part), h1, h2 (hashes of role and text), chars of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.substring(role, 1, 64).alias("role"), F.substring(text, 1, 64).alias("begins"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(7), text, role).alias("h2"), F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("salt"))
    rows = materialize(rows, "trie-turns")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("begins"), F.col("h1"), F.col("h2"), F.col("salt")]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // RANGE)
    found = materialize(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "trie-ranges")
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order[1:])) - 1
    found = materialize(found.select("conv", "part", place.cast("long").alias("place"), "h1", "h2", "chars"), "trie-numbered")
    discard(rows)
    return found


def rebuilt(conversations: DataFrame, shared: int = SHARED, turns: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """(rows, ends): conv, depth (from 1), h1, h2, chars, length of every rebuilt turn; conv, length of every conversation."""
    rows = numbered(conversations)
    counts = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.withColumn("before", before), "trie-counts")
    convs = counts.groupBy("conv").agg(F.sum("n").alias("n"))
    sizes = convs.select(F.col("conv").alias("of"), F.col("n").alias("n_of"))
    convs = convs.withColumn("first", F.col("conv") - F.col("conv") % shared).withColumn("h", F.crc32(F.col("conv").cast("string")) % turns)
    take = F.least("h", F.coalesce("n_of", F.lit(0)))
    convs = convs.join(sizes, F.col("first") == F.col("of"), "left").withColumn("take", take)
    convs = materialize(convs.select("conv", "first", "h", "take", (F.col("take") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "trie-convs")
    known = counts.join(convs, "conv").select(F.col("conv").alias("c"), F.col("part").alias("p"), "before", "h", "take", "length")
    own = rows.join(known, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p"))).withColumn("at", F.col("before") + F.col("place"))
    heads = rows.where(F.col("conv") % shared == 0).join(counts.select(F.col("conv").alias("c"), F.col("part").alias("p"), "before"), (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p")))
    heads = heads.withColumn("at", F.col("before") + F.col("place")).where(F.col("at") < turns - 1).select(F.col("conv").alias("of"), "at", "h1", "h2", "chars")
    begin = convs.join(heads, (F.col("first") == F.col("of")) & (F.col("at") < F.col("take"))).select("conv", (F.col("at") + 1).alias("depth"), "h1", "h2", "chars", "length")
    own = own.where(F.col("at") >= F.col("h")).select("conv", (F.col("take") + F.col("at") - F.col("h") + 1).alias("depth"), "h1", "h2", "chars", "length")
    return materialize(own.union(begin), "trie-rows"), convs.select("conv", "length")


def running(rows: DataFrame, values: list[str], add, join, backwards: bool = False, chunk: int = CHUNK) -> DataFrame:
    """rows (conv, depth, ...) with each value summed (by the aggregate add, parts put together by join) along its conversation, itself
    included, from the first depth on or backwards from the last; by chunks of depths, then within them."""
    rows = rows.withColumn("chunk", F.floor(F.col("depth") / chunk))
    sums = rows.groupBy("conv", "chunk").agg(*(add(v).alias(v) for v in values))
    order = F.col("chunk").desc() if backwards else F.col("chunk")
    before = Window.partitionBy("conv").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), *(F.coalesce(add(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values))
    inner = Window.partitionBy("conv", "chunk").orderBy(F.col("depth").desc() if backwards else F.col("depth"))  # rows of one depth together
    rows = rows.join(sums, (F.col("conv") == F.col("c")) & (F.col("chunk") == F.col("k")))
    return rows.select("*", *(join(F.col(f"{v}_before"), add(v).over(inner)).alias(f"{v}_run") for v in values)).drop("c", "k", "chunk", *(f"{v}_before" for v in values))


def keyed(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv, depth, k1, k2 (of its prefix), p1, p2 (of the prefix before), label, chars, length."""
    rows = rows.withColumn("x1", F.xxhash64("h1", "h2", "depth", F.lit(1))).withColumn("x2", F.xxhash64("depth", "h2", F.lit(2), "h1"))
    xor = lambda a, b: a.bitwiseXOR(b)
    found = running(rows, ["x1", "x2"], F.bit_xor, xor, chunk=chunk)
    k1, k2 = F.col("x1_run"), F.col("x2_run")
    return materialize(found.select("conv", "depth", k1.alias("k1"), k2.alias("k2"), xor(k1, F.col("x1")).alias("p1"), xor(k2, F.col("x2")).alias("p2"), F.col("h1").alias("label"), "chars", "length"), "trie-keys")


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, k1, k2, p1, p2, label, chars, n (members), low (the smallest), weight (rows at and below it) of every node, the root included."""
    inner = rows.groupBy("depth", "k1", "k2").agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("label").alias("label"), F.first("chars").alias("chars"),
        F.count("*").alias("n"), F.min("conv").alias("low"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("low"), F.sum(F.col("length") + 1).alias("weight")).where("n > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.cast("long").alias("p1"), zero.alias("p2"), zero.alias("label"), zero.alias("chars"), "n", "low", "weight")
    return materialize(inner.unionByName(root), "trie-nodes")


def louds(parent: np.ndarray) -> np.ndarray:
    """The bits of a tree in level order; parent[j - 1] is the parent of node j, not falling."""
    degree = np.bincount(parent, minlength=len(parent) + 1)
    bits = np.ones(2 * len(parent) + 1, np.uint8)
    bits[np.cumsum(degree + 1) - 1] = 0
    return bits


def parents(bits: np.ndarray) -> np.ndarray:
    """The parent of every node but the first: the zeros before its one."""
    ones = np.flatnonzero(bits)
    return ones - np.arange(len(ones))


def level_bounds(parent: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the nodes of each level below the first node, in level order."""
    degree = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=len(parent) + 1))])
    found, lo, hi = [], 1, 1 + int(degree[1])
    while lo < hi:
        found.append((lo, hi))
        lo, hi = hi, 1 + int(degree[hi])
    return found


ARRAYS = ("depth", "k1", "k2", "p1", "p2", "label", "chars", "n", "low")


def encoded_shard(nodes: pd.DataFrame) -> dict[str, bytes]:
    """The LOUDS bits and the arrays, in level order, of the nodes of one shard."""
    deep = nodes["depth"].to_numpy()
    names = pd.DataFrame({"depth": deep, "a": nodes["k1"].to_numpy(), "b": nodes["k2"].to_numpy(), "at": np.arange(len(deep))})
    above = pd.DataFrame({"depth": deep - 1, "a": nodes["p1"].to_numpy(), "b": nodes["p2"].to_numpy()})
    up = above.merge(names, how="left", on=["depth", "a", "b"])["at"].fillna(-1).to_numpy().astype(np.int64)
    label = nodes["label"].to_numpy()
    by_parent = np.lexsort((nodes["k2"].to_numpy(), label, up))
    first = np.searchsorted(up[by_parent], np.arange(-1, len(up) + 1))
    level, order, parent, rank = np.array([-1]), [], [], np.zeros(1, np.int64)
    seen = 1
    while len(level):  # children of a level, in the order of their parents
        lo, n = first[level + 1], first[level + 2] - first[level + 1]
        child = by_parent[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
        order.append(child)
        parent.append(np.repeat(rank, n))
        rank, level = np.arange(seen, seen + len(child)), child
        seen += len(child)
    order = np.concatenate(order)
    return {"louds": np.packbits(louds(np.concatenate(parent))).tobytes(), **{c: nodes[c].to_numpy()[order].astype("<i8").tobytes() for c in ARRAYS}}


class Trie:
    """A shard read back: parent of every node (0 stands for what is above the shard), arrays by name (node j at j - 1)."""

    def __init__(self, row: dict):
        self.arrays = {c: np.frombuffer(row[c], "<i8") for c in ARRAYS}
        n = len(self.arrays["n"])
        self.bits = np.unpackbits(np.frombuffer(row["louds"], np.uint8))[: 2 * n + 1]
        self.parent = parents(self.bits)

    def children(self, node: int) -> range:
        zeros = np.flatnonzero(self.bits == 0)
        lo, hi = zeros[node - 1] + 1 if node else 0, zeros[node]
        return range(int(lo) - node + 1, int(hi) - node + 1)

    def rollups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """children, leaves and saved tokens of the nodes from 1 on; the last two over their subtrees."""
        degree = np.bincount(self.parent, minlength=len(self.parent) + 1)
        leaves = (degree == 0).astype(np.int64)
        saved = np.concatenate([[0], (self.arrays["n"] - 1) * self.arrays["chars"]])
        for lo, hi in reversed(level_bounds(self.parent)):
            np.add.at(leaves, self.parent[lo - 1 : hi - 1], leaves[lo:hi])
            np.add.at(saved, self.parent[lo - 1 : hi - 1], saved[lo:hi])
        return degree[1:], leaves[1:], saved[1:]


def shards(nodes: DataFrame, rows: DataFrame, heavy: DataFrame, cap: int = CAP) -> DataFrame:
    """shard, louds and the arrays (binary) of every shard of light nodes."""
    light = nodes.where((F.col("depth") > 0) & (F.col("weight") <= cap))
    above = rows.join(heavy.where("depth > 0").select(*KEY), list(KEY), "left_semi").groupBy("conv").agg((F.max("depth") + 1).alias("cut"))
    tops = rows.select("conv", "depth", "k1", "k2").join(above.withColumnRenamed("conv", "c"), F.col("conv") == F.col("c"), "left").where(F.col("depth") == F.coalesce("cut", F.lit(1)))
    tops = materialize(tops.select(F.col("conv").alias("c"), F.col("k1").alias("t1"), F.col("k2").alias("t2")), "trie-tops")
    count = max(1, 2 * light.count() // cap)
    found = light.join(tops, F.col("low") == F.col("c")).select(F.pmod(F.xxhash64("t1", "t2"), F.lit(count)).alias("shard"), *ARRAYS)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"shard": part["shard"].iloc[0], **encoded_shard(part)}])

    return found.groupBy("shard").applyInPandas(build, "shard long, louds binary, " + ", ".join(f"{c} binary" for c in ARRAYS))


def rolled(built: DataFrame) -> DataFrame:
    """depth, k1, k2, p1, p2, low, n, above (low of the parent; null for a root of the shard), children, leaves, saved of the shards' nodes."""
    names = ["depth", "k1", "k2", "p1", "p2", "low", "n", "above", "children", "leaves", "saved"]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                t = Trie({c: b.column(c)[k].as_py() for c in ("louds", *ARRAYS)})
                low = np.concatenate([[0], t.arrays["low"]])[t.parent]
                values = [*(t.arrays[c] for c in names[:7]), pa.array(low, mask=t.parent == 0), *t.rollups()]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], names=names)

    return built.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def merged(heavy: DataFrame, light: DataFrame, rows: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The columns of rolled() of the heavy nodes."""
    tops = light.where("above IS NULL")
    below = heavy.where("depth > 0").select("depth", "p1", "p2").union(tops.select("depth", "p1", "p2")).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"))
    own = heavy.join(below, list(KEY), "left").withColumn("children", F.coalesce("children", F.lit(0)))
    own = materialize(own.withColumn("leaves", (F.col("children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("chars")), "trie-heavy")
    none = F.lit(0).cast("long")
    path = rows.join(heavy.where("depth > 0").select(*KEY), list(KEY), "left_semi").select("conv", *KEY).union(convs.select("conv", none, none, none))
    held = own.select(F.col("low").alias("conv"), "depth", "leaves", "saved").union(tops.select("low", "depth", "leaves", "saved"))
    steps = path.select("conv", *KEY, none.alias("leaves"), none.alias("saved"), F.lit(True).alias("on")).union(held.select("conv", "depth", none, none, "leaves", "saved", F.lit(False)))
    add = lambda a, b: a + b
    sums = running(steps, ["leaves", "saved"], F.sum, add, backwards=True, chunk=chunk).where("on").groupBy(*KEY).agg(F.sum("leaves_run").alias("leaves"), F.sum("saved_run").alias("saved"))
    return own.drop("leaves", "saved").join(sums, list(KEY)).select("depth", "k1", "k2", "p1", "p2", "low", "n", F.lit(None).cast("long").alias("above"), "children", "leaves", "saved")


def end_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the nodes where conversations end; ends has depth, k1, k2, conv."""

    def by_node(batches):
        for b in batches:
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
            change = np.flatnonzero(np.concatenate([[True], (c["k1"][1:] != c["k1"][:-1]) | (c["k2"][1:] != c["k2"][:-1]) | (c["depth"][1:] != c["depth"][:-1])])) if b.num_rows else []
            yield c, list(zip(change, [*change[1:], b.num_rows]))

    def pieces(batches):
        for c, spans in by_node(batches):
            cut = [(i, min(j, i + piece)) for lo, j in spans for i in range(lo, j, piece)]
            columns = [pa.array([int(c[n][i]) for i, _ in cut], pa.int64()) for n in (*KEY, "conv")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([",".join(map(str, c["conv"][i:j].tolist())) for i, j in cut], pa.string())], names=[*KEY, "conv", "ids"])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=[*KEY, "ends_sha256"])

    def hashed(batches):
        rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in (*KEY, "ids"))))
        found = []
        for key, group in itertools.groupby(rows, key=lambda r: r[:3]):
            digest = hashlib.sha256(next(group)[3].encode())
            for r in group:
                digest.update(b"," + r[3].encode())
            found.append((*key, digest.hexdigest()))
            if len(found) >= 10_000:
                yield batch(found)
                found = []
        if found:
            yield batch(found)

    ordered = ends.repartitionByRange("k1", "k2", "depth", "conv").sortWithinPartitions("k1", "k2", "depth", "conv")
    cut = ordered.mapInArrow(pieces, "depth long, k1 long, k2 long, conv long, ids string")
    return cut.repartition("k1", "k2", "depth").sortWithinPartitions("k1", "k2", "depth", "conv").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def nodes(conversations: DataFrame, shared: int = SHARED, turns: int = TURNS, cap: int = CAP, chunk: int = CHUNK) -> DataFrame:
    """The columns of the op12 contract, a row per node."""
    rows, convs = rebuilt(conversations, shared, turns)
    rows = keyed(rows, chunk)
    found = nodes_of(rows, convs)
    heavy = materialize(found.where((F.col("depth") == 0) | (F.col("weight") > cap)), "trie-upper")
    light = materialize(rolled(materialize(shards(found, rows, heavy, cap), "trie-shards")), "trie-light")
    every = light.union(merged(heavy, light, rows, convs, chunk))
    up = heavy.select((F.col("depth") + 1).alias("d"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("low").alias("its"))
    top = every.where("above IS NULL").join(up, (F.col("depth") == F.col("d")) & (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2")), "left").withColumn("above", F.col("its"))
    every = every.where("above IS NOT NULL").unionByName(top.select(*every.columns))
    none = F.lit(0).cast("long")
    ends = end_digests(rows.where("depth = length").select(*KEY, "conv").union(convs.where("length = 0").select(none, none, none, "conv")))
    every = every.join(ends, list(KEY), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return every.select(F.col("low").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
