"""SimHash near-duplicates by bit-sliced comparison.

1. Every text becomes a 64-bit fingerprint (majority of the XXH64 bits of its word shingles).
2. Equal fingerprints collapse to one row, so copies are never expanded into pairs.
3. Two fingerprints at distance r <= 3 agree in at least two of five bit blocks, so ten tables, keyed by two
   blocks each, hold every linked pair in a common bucket. Buckets beyond CAP rows are split into chunks and every
   pair of chunks is compared by its own task, so no bucket lands in one task and no pair is lost.
4. Inside a bucket the fingerprints are stored as 64 vertical bit planes. One XOR per plane gives the mismatch bits
   of 64 candidates; carry-save counters add them up, and a block of 64 is abandoned once all lanes exceed the radius.
5. Each bucket emits a spanning star of its links; alternating large-star and small-star joins turn these into
   connected components.

Defined results: a null or empty text has fingerprint 0 and is linked like any other; a null doc_id keeps its row and
never becomes a component id unless all of its component is null; repeated rows stay repeated; an empty table gives an
empty result. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, portions

SEED, WORDS, RADIUS, BLOCKS, CAP = 42, 3, 3, 5, 4096
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes, [n] or [n, words], have each bit."""
    bits = np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
    total = np.zeros(bits.shape[1], np.int64)
    for at in range(0, len(bits), 255):
        total += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return total


def simhash(text: str | None, words: int = WORDS) -> int:
    """64-bit fingerprint: bit set if it is set in over half of the shingle hashes."""
    import xxhash

    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    lo, hi = (end - size)[: 1 - words or None].tolist(), end[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(lo)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(lo[at : at + (1 << 16)], hi[at : at + (1 << 16)])], "<u8")
        counts += bit_counts(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), text_key (xxhash64 of the text) of every row."""

    def run(batches):
        for b in portions(batches):
            fp = np.fromiter((simhash(t, words) for t in b.column(1).to_pylist()), "<u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view("<i8")), b.column(2)], names=["doc_id", "fp", "text_key"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(run, "doc_id long, fp long, text_key long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """[bits, words] bit planes: bit k of word w in plane b is bit b of fps[64 w + k]; fps is [n], or [n, k] for 64 k bits each."""
    padded = np.zeros((-(-len(fps) // 64) * 64, *fps.shape[1:]), "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def bit_sliced_links(fps: np.ndarray, end: np.ndarray, radius: int = RADIUS, most: int = 1 << 18):
    """Yield arrays (i, j), i < j < end[i], of rows at distance <= radius. end: where each row's bucket ends. All pairs of one i come together."""
    if not len(fps):
        return
    planes, n, fields = planes_of(fps), len(fps), np.ascontiguousarray(fps.reshape(len(fps), -1).T)
    width = max(1, int(radius).bit_length())
    start = (1 << width) - 1 - radius  # counters begin here, so that they overflow beyond the radius
    row = np.arange(n)
    first, last = (row + 1) // 64, (end - 1) // 64
    spans = np.where(end - row > 1, last - first + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(spans)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        i = np.repeat(row[at:to], spans[at:to])
        if len(i):
            w = first[i] + np.arange(len(i)) - np.repeat(bounds[at:to] - bounds[at], spans[at:to])
            low, high = np.clip(i + 1 - 64 * w, 0, 63).astype(np.uint64), np.clip(end[i] - 64 * w, 1, 64).astype(np.uint64)
            over = ~((FULL << low) & (FULL >> (np.uint64(64) - high)))  # lanes outside the bucket are over from the start
            counters = [np.full(len(i), FULL if start >> k & 1 else 0, np.uint64) for k in range(width)]
            for b in range(len(planes)):
                if b % 64 == 0:
                    q = fields[b // 64][i]
                carry = planes[b][w] ^ (np.uint64(0) - ((q >> np.uint64(b % 64)) & np.uint64(1)))
                for k in range(width):
                    counters[k], carry = counters[k] ^ carry, counters[k] & carry
                over |= carry
                if b % 8 == 7:
                    alive = over != FULL
                    if alive.sum() * 2 < len(alive):
                        i, w, q, over, counters = i[alive], w[alive], q[alive], over[alive], [c[alive] for c in counters]
                        if not len(i):
                            break
            if len(i):
                hit, lane = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                if len(hit):
                    yield i[hit], 64 * w[hit] + lane
        at = to


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the pairs (i, j) into the forest label, which points to the smallest row of each component."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up


def _stars(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) of every linked row but the roots; rows are sorted by group."""
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    size = np.diff(bounds)
    keep = np.repeat(size > 1, size)
    fps, size = fps[keep], size[size > 1]
    if not len(fps):
        return fps, fps
    end, label = np.repeat(np.cumsum(size), size), np.arange(len(fps))
    for i, j in bit_sliced_links(fps, end):
        label = hook(label, i, j)
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[child], fps[label[child]]


def _compare(batches):
    """Rows (g, fp) sorted by g; whole groups are compared together, about 64 thousand rows at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(g, f):
        a, b = _stars(g, f)
        return pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view("<u8")))
        rows += batch.num_rows
        if rows >= 1 << 16:
            g, f = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(g, g[-1], "left")) if g[0] != g[-1] else 0
            if cut:
                yield out(g[:cut], f[:cut])
            held, rows = [(g[cut:], f[cut:])], len(g) - cut
    if held:
        yield out(*(np.concatenate(x) for x in zip(*held)))


def _masks(blocks: int = BLOCKS, free: int = RADIUS) -> list[int]:
    """Bit masks of the tables: all ways to choose the blocks that `free` differing bits leave equal."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(cuts)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in itertools.combinations(parts, blocks - free)]


def links(distinct: DataFrame, cap: int = CAP) -> DataFrame:
    """Spanning stars (a, b) of the links between the distinct fingerprints in column fp."""
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(_masks())]
    rows = distinct.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", F.xxhash64("x.t", "x.key").alias("h"))  # two keys with one hash share a bucket, which only adds comparisons
    large = materialize(rows.groupBy("h").count().where(F.col("count") > cap).select(F.col("h").alias("h2"), F.ceil(F.col("count") / cap).cast("int").alias("parts")), "simhash-large")
    rows = rows.join(large, rows.h == large.h2, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts"))
    rows = rows.select("fp", "h", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    group = F.when(F.col("parts") == 1, F.col("h")).otherwise(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")))
    return rows.select(group.alias("g"), "fp").repartition("g").sortWithinPartitions("g").mapInArrow(_compare, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node but the roots; columns a, b of edges are the ends.

    Alternating large-star and small-star steps. Every step writes its edges to the shared folder, so lineage stays
    short, and deletes those before; joins are between written tables, so a hub is split by AQE or the small side is broadcast by its size."""
    edge = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        sums = edge.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == mark or not sums[0]:
            roots = edge.select(F.col("a").alias("node"), F.col("b").alias("root"))
            roots.scratch_path = edge.scratch_path
            return roots
        mark = sums
        used = [edge, smallest := materialize(edge.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "cc-min")]
        large = materialize(edge.join(smallest, edge.b == smallest.u, "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), "cc-large")
        smallest = materialize(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "cc-min")
        used += [large, smallest]
        rest = large.join(smallest, large.a == smallest.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edge = materialize(smallest.select(F.col("u").alias("a"), F.col("m").alias("b")).union(rest).distinct(), "cc")
        discard(*used)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id of the component), text_key (a hash of the text) of every row of docs."""
    prints = materialize(fingerprints(docs), "simhash-fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = connected_components(links(distinct))
    labelled = materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-root")
    heads = materialize(labelled.groupBy(F.col("root").alias("top")).agg(F.min("rep").alias("component_id")), "simhash-head")
    known = materialize(labelled.join(heads, labelled.root == heads.top).select(F.col("fp").alias("print"), "component_id"), "simhash-known")
    discard(distinct, roots, labelled, heads)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(known, prints.fp == known["print"]).select("doc_id", digits.alias("fingerprint"), "component_id", "text_key")


def deduplicate(docs: DataFrame, labels: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The documents, one of each component that labels finds: a row of the smallest doc_id; of rows with that same doc_id
    the one with the smallest text hash, and of equal rows one."""
    i, t = fresh(docs, "id", "text_key")
    heads = labels(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("text_key").alias("least"))
    heads = materialize(heads.select(F.coalesce("component_id", F.lit(-(2**63))).alias("head"), "least"), "simhash-keep")
    marked = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), t: F.xxhash64(F.col("text"))})
    kept = marked.join(heads, (marked[i] == heads["head"]) & (marked[t] == heads["least"]), "left_semi")
    return kept.dropDuplicates([i, t]).drop(i, t)
