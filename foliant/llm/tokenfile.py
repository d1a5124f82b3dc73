"""Token-id files coded by a static range asymmetric numeral system (rANS).

A file is a row of segments, each about SEGMENT tokens of whole documents. A segment holds a frequency table, scaled to a
power of two and shared by its blocks, the documents' ids and lengths, and independent blocks of BLOCK tokens. A block has
LANES interleaved 64-bit coder states; token i belongs to lane i mod LANES. Its directory entry is a checkpoint: place and
number of its words, tokens before it, first document, final states, and a CRC-32 of its tokens, so that any set of blocks
can be decoded by itself and checked. All lanes of all blocks step together in numpy.

Documents are range-partitioned by doc_id and sorted, so the files in order of their part number hold the ids in ascending
doc_id order. A task writes a file of its own name and returns the file's segments; only segments in the written manifest
are read, so files of lost or repeated tasks are never seen.

Defined results: a null text is empty and has the end id alone; a null doc_id sorts first; rows with equal doc_id are
ordered by the hash of their text; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import filesystem, materialize, portions, scratch

MAGIC, SEGMENT, BLOCK, LANES, LOW = b"RANSTOK1", 1 << 21, 1 << 15, 64, np.uint64(1 << 31)
DENSE = 1 << 22  # ids below this are counted in a table, others by sorting
HEAD = struct.Struct("<8sIIQIIII")  # magic, CRC of the rest, precision, tokens, documents, symbols, blocks, words
ENTRY = np.dtype([("word", "<u4"), ("words", "<u4"), ("token", "<u8"), ("doc", "<u4"), ("crc", "<u4"), ("states", "<u8", LANES)])
S32, M32 = np.uint64(32), np.uint64(0xFFFFFFFF)


class Corrupt(ValueError):
    """A checksum of a token file does not hold."""


def table_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, their frequencies scaled to sum to 2**precision with none at zero, precision."""
    if len(ids) and ids.max() < DENSE:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts).astype(np.uint32)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    if not len(symbols):
        return symbols, counts, 12
    precision = max(12, min(24, (4 * len(symbols) - 1).bit_length()))
    total = 1 << precision
    freq = np.maximum(1, (counts * (total / max(1, counts.sum()))).astype(np.int64))
    over = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    while over > 0:  # take from the largest, never below one
        give = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // total + 1))
        give = np.minimum(give, np.maximum(0, over - (np.cumsum(give) - give)))
        freq[order] -= give
        over -= int(give.sum())
    freq[order[0]] -= over
    return symbols, freq, precision


def _encode(index: np.ndarray, freq: np.ndarray, start: np.ndarray, precision: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """index: [blocks, steps, LANES]. States [blocks, LANES], emitted words and their mask [blocks, steps, LANES]."""
    blocks, steps, lanes = index.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    words, mask = np.zeros((blocks, steps, lanes), np.uint32), np.zeros((blocks, steps, lanes), bool)
    p, top = np.uint64(precision), np.uint64(63 - precision)
    for t in range(steps - 1, -1, -1):
        f = freq[index[:, t]]
        full = x >= (f << top)
        words[:, t], mask[:, t] = x & M32, full
        x = np.where(full, x >> S32, x)
        q = x // f
        x = (q << p) + (x - q * f) + start[index[:, t]]
    return x, words, mask


def _decode(x: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, freq: np.ndarray, start: np.ndarray, slot: np.ndarray, precision: int) -> np.ndarray:
    """Inverse of _encode: x [blocks, LANES] states, at: each block's first word."""
    out = np.empty((len(x), steps, x.shape[1]), np.uint32)
    p, low = np.uint64(precision), np.uint64((1 << precision) - 1)
    at = at.astype(np.int64).copy()
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    for t in range(steps):
        c = x & low
        s = slot[c]
        out[:, t] = s
        x = freq[s] * (x >> p) + c - start[s]
        need = x < LOW
        k = np.cumsum(need, axis=1)
        place = np.minimum(at[:, None] + k - 1, len(words) - 1)
        x = np.where(need, (x << S32) | words[np.maximum(place, 0)], x)
        at += k[:, -1]
    return out


def pack(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A segment of (doc_id, ids) pairs."""
    ids = np.concatenate([x for _, x in docs]).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    symbols, freq, precision = table_of(ids)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else np.zeros(0, np.uint64)
    f = freq.astype(np.uint64)
    if len(ids) and symbols[-1] < DENSE:
        place = np.zeros(int(symbols[-1]) + 1, np.int32)
        place[symbols] = np.arange(len(symbols))
        index = place[ids]
    else:
        index = np.searchsorted(symbols, ids)
    ends = np.cumsum([len(x) for _, x in docs])
    entries, streams, word = np.zeros(-(-len(ids) // BLOCK), ENTRY), [], 0
    whole = len(ids) // BLOCK
    for lo, hi in ((0, whole), (whole, len(entries))):
        if lo == hi:
            continue
        part = index[lo * BLOCK : hi * BLOCK]
        if lo == whole:  # the last block is filled up with its commonest symbol
            part = np.concatenate([part, np.full(-len(part) % LANES, int(np.argmax(freq)), part.dtype)])
        x, words, mask = _encode(part.reshape(hi - lo, -1, LANES), f, start, precision)
        for b in range(hi - lo):
            own = words[b][mask[b]]
            token = (lo + b) * BLOCK
            entries[lo + b] = (word, len(own), token, np.searchsorted(ends, token, "right"), zlib.crc32(ids[token : token + BLOCK].tobytes()), x[b])
            streams.append(own)
            word += len(own)
    valid = np.array([d is not None for d, _ in docs], np.uint8)
    body = b"".join([
        symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), entries.tobytes(),
        np.array([d or 0 for d, _ in docs], "<i8").tobytes(), np.diff(ends, prepend=0).astype("<u4").tobytes(), valid.tobytes(),
        np.concatenate(streams).astype("<u4").tobytes() if streams else b"",
    ])
    return HEAD.pack(MAGIC, zlib.crc32(body), precision, len(ids), len(docs), len(symbols), len(entries), word) + body


def unpack(data: bytes, blocks: range | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a segment; blocks: only the ids of these blocks."""
    magic, crc, precision, tokens, n, symbols_n, blocks_n, words_n = HEAD.unpack_from(data)
    if magic != MAGIC or zlib.crc32(data[HEAD.size :]) != crc:
        raise Corrupt("segment")
    at = HEAD.size

    def take(dtype, count):
        nonlocal at
        found = np.frombuffer(data, dtype, count, at)
        at += found.nbytes
        return found

    symbols, freq = take("<u4", symbols_n), take("<u4", symbols_n).astype(np.uint64)
    entries, doc_ids, lengths, valid, words = take(ENTRY, blocks_n), take("<i8", n), take("<u4", n), take(np.uint8, n), take("<u4", words_n)
    start = np.cumsum(freq) - freq
    slot = np.repeat(np.arange(symbols_n, dtype=np.int32), freq.astype(np.int64))
    chosen = list(blocks if blocks is not None else range(blocks_n))
    whole = tokens // BLOCK
    parts = []
    for group in ([b for b in chosen if b < whole], [b for b in chosen if b >= whole]):
        if not group:
            continue
        e = entries[group]
        size = BLOCK if group[0] < whole else tokens - whole * BLOCK
        found = _decode(e["states"].astype(np.uint64), words, e["word"], -(-size // LANES), freq, start, slot, precision)
        found = symbols[found.reshape(len(group), -1)[:, :size]]
        for ids, c in zip(found, e["crc"]):
            if zlib.crc32(np.ascontiguousarray(ids).tobytes()) != c:
                raise Corrupt("block")
        parts.append(found.reshape(-1))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return [int(d) if v else None for d, v in zip(doc_ids.tolist(), valid.tolist())], lengths.astype(np.int64), ids


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write token files into path; the written manifest: part, file, offset, length, before (tokens of the file before), tokens."""
    text = F.col("text").cast("string")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the hash spreads rows without doc_id, or with one doc_id, over tasks
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id())

    def run(batches):
        bpe, fs, at, before, held, size = encoder(vocabulary), None, 0, 0, [], 0
        name, out, part = f"{path}/{uuid.uuid4().hex}.rans", None, None
        end = end_id.to_bytes(4, "little")
        found = []

        def flush():
            nonlocal at, before, held, size
            data = pack(held)
            out.write(data)
            found.append((part, name, at, len(data), before, size))
            at, before, held, size = at + len(data), before + size, [], 0

        for b in portions(batches):
            for d, coded, part in zip(b.column(0).to_pylist(), bpe.encode_all(b.column(1)), b.column(2).to_pylist()):
                if out is None:
                    fs, inner = filesystem(name)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(inner, compression=None)
                ids = np.frombuffer(coded + end, "<u4")
                held.append((d, ids))
                size += len(ids)
                if size >= SEGMENT:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        columns = list(zip(*found)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "file", "offset", "length", "before", "tokens"])

    return materialize(rows.mapInArrow(run, "part int, file string, offset long, length long, before long, tokens long"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document in the files of a manifest."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    segments = manifest.join(parts, F.col("part") == F.col("p")).select("file", "offset", "length", (F.col("base") + F.col("before")).alias("start"))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, inner = filesystem(row["file"])
                with fs.open_input_file(inner) as f:
                    doc_ids, lengths, ids = unpack(f.read_at(row["length"], row["offset"]))
                ids, ends = ids.astype("<u4"), np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + row["start"]), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.repartition(2 * manifest.sparkSession.sparkContext.defaultParallelism, "file", "offset").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    return read(write(docs, scratch(docs.sparkSession, "tokens"), vocabulary, end_id))
