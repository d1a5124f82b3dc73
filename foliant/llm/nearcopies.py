"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. By bit-sliced SimHash, then exactly.

1. Every text becomes its set of 64-bit shingle hashes and their SimHash of 512 bits; equal sets collapse to one row, so copies are never expanded.
2. All sets are put in one order, rarest shingles first. How often a shingle occurs is counted over all texts in one table of
   counters (about one for COUNTED shingles, at most 2^24); where shingles share one, the order is another, never the result.
3. Sets at similarity 0.8 share a shingle among the first fifth of either, n - ceil(4 n / 5) + 1 shingles. Only those are indexed. A set
   meets another in the bucket of a shared one if their sizes allow the similarity, and so does what lies behind the shingle in
   both: boilerplate is frequent, comes last in the order and is left out, unless it is so much of both that they are similar.
   Such buckets take the place of simhash's tables of equal bit blocks: at 0.8 some 15 % of the bits differ, so hardly a block stays equal.
4. In every bucket the fingerprints are compared as bit planes with carry-save counters, and blocks beyond the radius are abandoned
   (simhash.bit_sliced_links); only pairs within it go on. First by the first 64 bits, CLOSE of which may differ: each set is paired
   with the NEAREST sets after it, within WINDOW rows in order of size. Distinct pairs are compared once, exactly; links become
   components. Then all sets of one bucket in different components are compared by all 512 bits, so that a group of copies costs a few
   comparisons each. A pair of the similarity differs in more than RADIUS bits with a probability below 1 in 10^12 (its bits
   differ with at most 3/16 each, the case of 5 and 4 shingles). Of the pairs within the radius those are left out whose sketches
   differ in more bins than (n + m) / 9, which the similarity excludes, or than FAR of BINS, which is as unlikely. All
   others are compared exactly, so no link between different texts is lost. Buckets beyond CAP are cut into chunks, every
   two of which are paired by a task of their own.

Defined results: words are split and lowered as for the SimHash; a text of up to five words is one shingle; a null or empty
text has the empty set, and these are copies of each other; null doc_ids and repeated rows are treated as in simhash.
"""

from __future__ import annotations

import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, filesystem, give_back, kept, materialize, portions, scratch
from .simhash import SEED, bit_counts, bit_sliced_links, connected_components

WORDS, CAP, MEMBERS, COUNTED, BLOCK = 5, 4096, 2048, 64, 1 << 14
NEAREST, WINDOW, BINS, FAR = 8, 256, 1024, 180
#: 64-bit words of a fingerprint, and how many of its bits may differ; of the first word alone; words of candidates compared at once.
WIDTH, RADIUS, CLOSE, SPANS = 8, 163, 24, 1 << 14
#: Similarity from which documents are linked, as a fraction.
LEAST = (4, 5)
_PLACE = np.random.default_rng(SEED + 1).integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_TURN = np.random.default_rng(SEED).integers(0, 1 << 64, WIDTH, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles."""
    import xxhash

    parts = (text or "").encode("utf-8", "replace").lower().split()
    digest, width = xxhash.xxh64_intdigest, min(len(parts), words)
    h = np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))
    if not width:
        return h
    n = len(h) - width + 1
    return np.unique(_mixed(sum(h[k : k + n] * _PLACE[k] for k in range(width)) + np.uint64(width)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have at least the similarity LEAST."""
    if len(a) > len(b):
        a, b = b, a
    if LEAST[1] * len(a) < LEAST[0] * len(b):
        return False
    if not len(b):
        return True
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def overlap_possible(n, place, m, other, xp=np):
    """Whether sets of n and m shingles, whose first common one is at these places, can have the similarity LEAST."""
    rest = xp.minimum(n - place, m - other)
    up, down = LEAST
    return ((up + down) * rest >= up * (n + m)) & (down * xp.minimum(n, m) >= up * xp.maximum(n, m))


def frequencies(docs: DataFrame) -> list[tuple[int, str]]:
    """(block, path) of the counters of shingles over all texts, BLOCK in each file; their number follows from the texts' length."""
    text = F.col("text").cast("string")
    chars = docs.agg(F.sum(F.char_length(text))).first()[0] or 0
    width = 1 << min(max(int(chars // (6 * COUNTED)).bit_length(), 14), 24)
    folder = scratch(docs.sparkSession, "near-counts")

    def count(batches):
        total = np.zeros(width, np.uint32)
        for b in portions(batches):
            found = [shingles(t) for t in b.column(0).to_pylist()]
            place = (np.concatenate(found) & np.uint64(width - 1)).astype(np.int64)
            for at in range(0, len(place), 1 << 20):
                k, n = np.unique(place[at : at + (1 << 20)], return_counts=True)
                total[k] += n.astype(np.uint32)
        for at in range(0, width, BLOCK):
            if total[at : at + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": [at // BLOCK], "counts": [zlib.compress(total[at : at + BLOCK].tobytes(), 1)]})

    def add(batches):
        rows = ((k, c) for b in batches for k, c in zip(*(x.to_pylist() for x in b.columns)))
        for block, group in itertools.groupby(rows, key=lambda r: r[0]):
            total = np.zeros(BLOCK, np.uint64)
            for _, c in group:
                total += np.frombuffer(zlib.decompress(c), np.uint32)
            path = f"{folder}/{uuid.uuid4().hex}.bin"
            fs, inner = filesystem(path)
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(inner, compression=None) as out:
                out.write(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict({"block": [block], "path": [path]})

    counted = docs.select(text.alias("text")).mapInArrow(count, "block long, counts binary")
    found = materialize(counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, path string"), "near-counters")
    paths = sorted((x.block, x.path) for x in found.collect())  # at most 1,024 rows
    discard(found)
    return [(width // BLOCK, "")] + paths


def _counters(paths: list[tuple[int, str]]) -> np.ndarray:
    """The counters, read once by a process."""

    def read():
        found = np.zeros(paths[0][0] * BLOCK, np.uint32)
        for block, path in paths[1:]:
            fs, inner = filesystem(path)
            with fs.open_input_stream(inner, compression=None) as f:
                found[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(f.read(), np.uint32)
        return found

    return kept(("near-counts", *paths[:2]), read)


def prefix(found: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """The first n - ceil(4 n / 5) + 1 shingles of a set in the order of their counts."""
    if not len(found):
        return found
    size = len(found) - -(-len(found) * LEAST[0] // LEAST[1]) + 1
    count = counters[(found & np.uint64(len(counters) - 1)).astype(np.int64)]
    return found[np.lexsort((found, count))[:size]]


def sketch(found: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Words of bits: for each bin whether the set has a hash in it, then one bit of the smallest. A shingle changes its own bin only."""
    h = np.sort(_mixed(found ^ np.uint64(0x5851F42D4C957F2D)))
    own, first = np.unique((h >> np.uint64(65 - bins.bit_length())).astype(np.int64), return_index=True)
    out = np.zeros((2, bins), np.uint8)
    out[0, own] = 1
    out[1, own] = (h[first] >> np.uint64(7)).astype(np.uint8) & 1
    return np.packbits(out, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set, WIDTH words: a bit is 1 if it is set in over half of the shingles' hashes, of which every word has its own."""
    counts = np.zeros(64 * WIDTH, np.int64)
    for at in range(0, len(found), 1 << 13):
        counts += bit_counts(_mixed(found[at : at + (1 << 13), None] ^ _TURN))
    return np.packbits(2 * counts > len(found), bitorder="little").view("<u8")


def sketches(docs: DataFrame, paths: list[tuple[int, str]]) -> DataFrame:
    """doc_id, text_key, node (a hash of the shingle set), n (its size), prefix, bins (its sketch), print (its fingerprint), bits (the first word of that) of every row."""
    import xxhash

    def run(batches):
        for b in portions(batches):
            counters = _counters(paths)
            found = [shingles(t) for t in b.column(1).to_pylist()]
            node = np.array([xxhash.xxh3_64_intdigest(f.tobytes(), SEED) for f in found], np.uint64)
            first = [prefix(f, counters) for f in found]
            ends = np.cumsum([0] + [len(p) for p in first]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first).view("<i8")))
            marks = [fingerprint(f) for f in found]
            columns = [b.column(0), b.column(2), pa.array(node.view("<i8")), pa.array([len(f) for f in found], pa.int64()), lists]
            columns += [pa.array([sketch(f).tobytes() for f in found], pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())]
            columns += [pa.array([int(m.view("<i8")[0]) for m in marks], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", "n", "prefix", "bins", "print", "bits"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(run, "doc_id long, text_key long, node long, n long, prefix array<long>, bins binary, print binary, bits long")


def _nearest(c: dict, end: np.ndarray, old: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j < end[i] and j >= old, of each row and the NEAREST rows after it by the bits of their first fingerprint words, CLOSE at most."""
    left, right = [], []
    for i, j in bit_sliced_links(c["bits"], end, CLOSE, SPANS):
        ok = (j >= old) & overlap_possible(c["n"][i], c["place"][i], c["n"][j], c["place"][j])
        i, j = i[ok], j[ok]
        order = np.lexsort((np.bitwise_count(c["bits"][i] ^ c["bits"][j]), i))
        i, j = i[order], j[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < NEAREST
        left.append(i[best])
        right.append(j[best])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _first_pairs(batches):
    """Of rows (h, size, node, bits), sorted by h and size: those of buckets with more than one set as (h, node, n, place), and pairs (node, a) with null h. Of a
    bucket at most WINDOW rows and a batch are held."""
    names, held, alone = ("h", "size", "node", "bits"), None, True  # the end of the open bucket; whether it is one row that was not handed on
    columns = ["h", "node", "n", "place", "a"]

    def table(h, node, size, a):
        none = pa.nulls(len(node), pa.int64())
        if h is None:
            return pa.RecordBatch.from_arrays([none, pa.array(node), none, none, pa.array(a)], names=columns)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(node), pa.array(size >> 31), pa.array(size & 0x7FFFFFFF), none], names=columns)

    for batch in batches:
        c = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
        if not len(c["h"]):
            continue
        old = 0
        if held is not None and held["h"][0] == c["h"][0]:
            old = len(held["h"])
            c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
        bounds = np.flatnonzero(np.concatenate([[True], c["h"][1:] != c["h"][:-1], [True]]))
        size = np.diff(bounds)
        several = np.repeat(size > 1, size)
        keep = several.copy()
        if old and not alone:
            keep[:old] = False
        if keep.any():
            yield table(*(c[k][keep] for k in ("h", "node", "size")), None)
        if several.any():
            own = {"n": c["size"][several] >> 31, "place": c["size"][several] & 0x7FFFFFFF, "bits": c["bits"][several].view("<u8")}
            many = size[size > 1]
            i, j = _nearest(own, np.minimum(np.repeat(np.cumsum(many), many), np.arange(1, 1 + many.sum()) + WINDOW), old)
            node = c["node"][several]
            a, b = np.unique(np.sort(np.stack([node[i], node[j]]), axis=0), axis=1)
            if len(a):
                yield table(None, b, None, a)
        lo = max(int(bounds[-2]), len(c["h"]) - WINDOW)
        held, alone = {k: v[lo:] for k, v in c.items()}, int(size[-1]) == 1
        give_back()


def _crossing(batches):
    """Pairs (a, b) of rows (g, own, node, n, place, root, bins, print), sorted by g and n, of one bucket, at most RADIUS differing bits of the fingerprints,
    different roots, a possible overlap and sketches that are not too far apart; between chunks of a bucket only pairs of both. A group has at most two chunks."""
    names = ("g", "own", "node", "n", "place", "root", "bins", "print")
    rest = None

    def pairs(c):
        if not len(c["g"]):
            return
        bounds = np.flatnonzero(np.concatenate([[True], c["g"][1:] != c["g"][:-1], [True]]))
        size, differ = np.diff(bounds), lambda k: np.minimum.reduceat(c[k], bounds[:-1]) != np.maximum.reduceat(c[k], bounds[:-1])
        mixed, both = differ("root"), differ("own")
        kept = np.repeat(mixed, size)
        if not kept.any():
            return
        c, both, size = {k: v[kept] for k, v in c.items()}, np.repeat(both[mixed], size[mixed]), size[mixed]
        n, place, root, own, node, stop = c["n"], c["place"], c["root"], c["own"], c["node"], np.cumsum(size)
        end = np.concatenate([lo + np.searchsorted(n[lo:hi] * LEAST[0], n[lo:hi] * LEAST[1], "right") for lo, hi in zip((stop - size).tolist(), stop.tolist())])
        bins = np.frombuffer(b"".join(c["bins"]), "<u8").reshape(len(n), 2, -1)
        for i, j in bit_sliced_links(np.frombuffer(b"".join(c["print"]), "<u8").reshape(len(n), -1), end, RADIUS, SPANS):
            ok = (root[i] != root[j]) & overlap_possible(n[i], place[i], n[j], place[j]) & ~(both[i] & (own[i] == own[j]))
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 1 << 14):
                a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                apart = np.bitwise_count((bins[a, 0] ^ bins[b, 0]) | (bins[a, 1] ^ bins[b, 1])).sum(1)
                near = apart <= np.minimum((n[a] + n[b]) // 9, FAR)
                if near.any():
                    yield node[a[near]], node[b[near]]

    def out(c):
        held, rows = [], 0
        for p in pairs(c):
            held.append(p)
            rows += len(p[0])
            if rows > 1 << 16:
                yield held
                held, rows = [], 0
        if held:
            yield held

    def batch(held):
        a, b = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for b in batches:
        c = {k: b.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
        if rest is not None:
            c = {k: np.concatenate([rest[k], v]) for k, v in c.items()}
        if not len(c["g"]):
            continue
        cut = int(np.searchsorted(c["g"], c["g"][-1], "left"))
        rest = {k: v[cut:] for k, v in c.items()}
        yield from map(batch, out({k: v[:cut] for k, v in c.items()}))
        give_back()
    if rest is not None:
        yield from map(batch, out(rest))
    give_back()


def _compare(batches):
    """Links (a, b) of rows (a, part, later, node, set): the first row of each (a, part) is the set of a, which every later one is compared with."""
    rows = (r for b in portions(batches) for r in zip(*(c.to_pylist() for c in b.columns)))
    for (a, _), group in itertools.groupby(rows, key=lambda r: r[:2]):
        _, _, later, _, own = next(group)
        if later:
            raise ValueError("a pair without its first set")
        own, near = np.frombuffer(own, "<u8"), []
        near = [r[3] for r in group if similar(own, np.frombuffer(r[4], "<u8"))]
        if near:
            yield pa.RecordBatch.from_arrays([pa.array([a] * len(near), pa.int64()), pa.array(near, pa.int64())], names=["a", "b"])


def verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) at the similarity LEAST or more. A set goes to every set that it is compared with, MEMBERS to a group."""
    parts = pairs.groupBy(F.col("a").alias("a2")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")).where("parts > 1")
    later = pairs.join(parts, pairs.a == parts.a2, "left").select("a", F.pmod(F.xxhash64("b", F.lit(7)), F.coalesce("parts", F.lit(1))).alias("part"), F.lit(True).alias("later"), F.col("b").alias("member"))
    rows = materialize(later.union(later.select("a", "part").distinct().select("a", "part", F.lit(False), "a")), "near-rows")
    needed = rows.select("member").distinct()
    needed = materialize(distinct.join(needed, distinct.node == needed.member, "left_semi").select("node", F.col("rep.doc_id").alias("i"), F.col("rep.text_key").alias("t")), "near-needed")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    texts = keyed.join(needed, keyed.doc_id.eqNullSafe(needed.i) & (keyed.key == needed.t)).select("node", "text")

    def run(batches):
        for b in portions(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "found"])

    sets = texts.mapInArrow(run, "node long, found binary").dropDuplicates(["node"])
    both = rows.join(sets, rows.member == sets.node).select("a", "part", "later", "member", "found")
    both = both.repartition("a", "part").sortWithinPartitions("a", "part", "later")
    links = materialize(both.mapInArrow(_compare, "a long, b long"), "near-links")
    discard(rows, needed)
    return links


def links(docs: DataFrame, distinct: DataFrame, cap: int = CAP) -> DataFrame:
    """Links (a, b) of the pairs at the similarity LEAST or more that join all of each component; distinct has node, n, prefix, bins, print, bits, rep (doc_id, text_key)."""
    index = distinct.select("node", "n", "bits", F.posexplode("prefix").alias("place", "h"))
    index = index.select("h", (F.shiftleft("n", 31) + F.col("place")).alias("size"), "node", "bits").repartition("h").sortWithinPartitions("h", "size", "node")
    found = materialize(index.mapInArrow(_first_pairs, "h long, node long, n long, place long, a long"), "near-buckets")
    buckets, pairs = found.where("h IS NOT NULL"), found.where("h IS NULL").select("a", F.col("node").alias("b")).distinct()
    pairs = materialize(pairs, "near-pairs")
    near = verified(docs, distinct, pairs)
    roots = connected_components(near)
    own = buckets.select("h", "node", "n", "place").join(roots.select(F.col("node").alias("k"), F.col("root").alias("top")), F.col("node") == F.col("k"), "left")
    rows = materialize(own.select("h", "node", "n", "place", F.coalesce("top", "node").alias("root")), "near-rooted")
    mixed = rows.groupBy(F.col("h").alias("h2")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / cap).cast("int").alias("parts")).where("lo <> hi")
    mixed = materialize(mixed.select("h2", "parts"), "near-mixed")
    rows = rows.join(mixed, rows.h == mixed.h2).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.when(F.col("parts") == 1, F.col("h")).otherwise(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")))
    drawn = distinct.select(F.col("node").alias("k"), "bins", "print")
    rows = rows.select(group.alias("g"), F.col("own").cast("long").alias("own"), "node", "n", "place", "root").join(drawn, F.col("node") == F.col("k")).drop("k").repartition("g").sortWithinPartitions("g", "n", "node")
    again = rows.mapInArrow(_crossing, "a long, b long").distinct()
    again = materialize(again.join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    more = verified(docs, distinct, again)
    discard(found, mixed, roots)
    return near.union(more)


def near_copies(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, component_id (smallest doc_id of the component), text_key of every row of docs."""
    prints = materialize(sketches(docs, frequencies(docs)), "near-sketches")
    distinct = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bins").alias("bins"), F.first("print").alias("print"), F.first("bits").alias("bits")), "near-distinct")
    found = connected_components(links(docs, distinct, cap)).select(F.col("node").alias("k"), "root")
    labelled = materialize(distinct.select("node", "low").join(found, F.col("node") == F.col("k"), "left").select("node", "low", F.coalesce("root", "node").alias("root")), "near-root")
    heads = materialize(labelled.groupBy(F.col("root").alias("top")).agg(F.min("low").alias("component_id")), "near-head")
    known = materialize(labelled.join(heads, labelled.root == heads.top).select(F.col("node").alias("k"), "component_id"), "near-known")
    discard(distinct, labelled, heads)
    return prints.select("doc_id", "text_key", "node").join(known, F.col("node") == F.col("k")).select("doc_id", "component_id", "text_key")
