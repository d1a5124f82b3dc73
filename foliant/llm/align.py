"""Cross-tokenizer alignment: which tokens of a byte-level vocabulary A and of a piece vocabulary B cover the same bytes.

1. A text, with a space before it, is cut into units: before a single space that stands between a character that is no space
   and one that is no white space. No token of A or B crosses such a place, so units are encoded once, many at a time, and
   remembered (CACHE of them in a process; the others are encoded again in each portion of a batch).
2. Tokens become byte ends. The union of both vocabularies' ends cuts the bytes into links, each in one token of either; where
   both end, a group ends. All of it is numpy over the units of a portion.
3. Every partition counts its links by packed keys, B << 32 | A, with np.unique. The partial counts are partitioned by range of
   the key and sorted; each task sums the runs and writes sorted shards of at most SHARD keys with the highest count of each B
   in it. There are at most len(A) * len(B) keys, and the manifest has a row per shard: both are bounded by the vocabularies.
4. Tasks map the shards into memory and find counts by searchsorted. A shared folder that is not mounted cannot be mapped;
   then at most RESIDENT shards are held in memory.

Defined results: a text that is null or empty, or whose tokens' bytes differ from it (with its space) in A or B, has no tokens:
zeros, and it counts no links. Rows are answered one by one: null or repeated doc_ids keep their rows, and repeated texts count
every time. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import discard, filesystem, materialize, portions, scratch

CACHE, LONGEST, BLOCK, BUFFER, SHARD, RESIDENT = 300_000, 64, 50_000, 1 << 21, 1 << 20, 16
_ALIGNERS: dict[tuple, "Aligner"] = {}


class Aligner:
    """Units of texts and what both vocabularies make of them. Slots up to CACHE are kept, those beyond serve one portion."""

    def __init__(self, path_a: str, path_b: str, cache: int = CACHE):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in byte_alphabet().items()}
        raw = {i: bytes(back[c] for c in token) for token, i in model["vocab"].items() if all(c in back for c in token)}
        size_a, size_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        self.bytes_a = [raw.get(i, b"") for i in range(size_a)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(size_b))]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranked = all(model["vocab"]["".join(m)] == 256 + k for k, m in enumerate(merges))  # then an id is the rank of its merge
        ranks = {b: i for i, b in raw.items() if i < 256 + len(merges)}
        import public_tokenizers

        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked else None
        most = max(size_a, size_b)
        self.decimals = [f"{i}{s}" for i in range(most) for s in ",|;"]
        self.cuts = re.compile(r"(?<=[^ ]) (?=\S)").split
        self.uneven = re.compile(r" \s| \Z|\A ").search
        self.cache, self.known, self.n, self.counts = cache, {}, 0, None
        self.strings: list[str] = []
        self.sums = np.zeros((6, 1024), np.int64)  # n_a, n_b, n_groups, n_links, n_best, count_sum of each slot
        self.bad = np.zeros(1024, bool)
        self.offset, self.keys = np.zeros(1025, np.int64), np.zeros(1024, np.int64)

    def units(self, text: str) -> list[str]:
        """The units of a text without the space each begins with."""
        return self.cuts(text) if self.uneven(text) else text.split(" ")

    def _encoded(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The units in the order of the ids, ids of A, ids of B; simple units are encoded together by A."""
        simple, rest = [], []
        for u in units:
            plain = self.fast and len(u) < 256 and (u.isascii() or max(u) < "ɐ") and not u[-1].isspace() and not u[0].isspace()
            (simple if plain else rest).append(u)
        ids = [np.array(self.fast.encode_ordinary(" " + " ".join(simple)), np.int64)] if simple else []
        ids += [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast([" " + u for u in rest], add_special_tokens=False)]
        in_order = simple + rest
        pieces = self.b.encode(in_order, num_threads=1)
        return in_order, np.concatenate(ids), np.array([i for p in pieces for i in p], np.int64)

    def _faithful(self, unit: str) -> bool:
        whole = (" " + unit).encode()
        a = self.a.encode(" " + unit, add_special_tokens=False).ids
        return b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, self.b.encode(unit)))

    def _room(self, slots: int, keys: int) -> None:
        if slots > self.sums.shape[1]:
            more = max(slots, 2 * self.sums.shape[1])
            self.sums = np.concatenate([self.sums, np.zeros((6, more - self.sums.shape[1]), np.int64)], 1)
            self.bad = np.concatenate([self.bad, np.zeros(more - len(self.bad), bool)])
            self.offset = np.concatenate([self.offset, np.zeros(more + 1 - len(self.offset), np.int64)])
        if keys > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros(max(keys, 2 * len(self.keys)) - len(self.keys), np.int64)])

    def _add(self, units: list[str], at: int) -> list[str]:
        """Fill the slots from `at` on for distinct units; the units in the order of the slots."""
        units, a, b = self._encoded(units)
        whole = " " + " ".join(units)
        bad: list[str] = []
        raw = whole.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            bad = [u for u in units if not self._faithful(u)]
            gone = set(bad)
            units = [u for u in units if u not in gone]
            if units:
                units, a, b = self._encoded(units)
        n, m = len(units), len(bad)
        self._room(at + n + m, self.offset[at] + (len(a) + len(b) if n else 0))
        if n:
            stop = np.cumsum([len(u.encode()) + 1 for u in units])
            end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
            both = np.concatenate([end_a, end_b])
            both.sort(kind="stable")
            new = np.concatenate([both[1:] != both[:-1], [True]])
            twice = np.flatnonzero(~new)
            group, cut = both[twice], both[new]
            keys = b[np.searchsorted(end_b, cut)] << 32 | a[np.searchsorted(end_a, cut)]
            bounds = lambda ends: np.searchsorted(ends, stop, "right")
            links = bounds(cut)
            for row, ends in enumerate((bounds(end_a), bounds(end_b), bounds(group), links)):
                self.sums[row, at : at + n] = np.diff(ends, prepend=0)
            self.offset[at + 1 : at + n + 1] = self.offset[at] + links
            self.keys[self.offset[at] : self.offset[at] + len(keys)] = keys
            # tokens in the order of the text form: by group, A before B
            ids, side = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            place = 2 * np.searchsorted(group, np.concatenate([end_a, end_b])) + side
            order = np.argsort(place, kind="stable")
            place, ids = place[order], ids[order]
            mark = np.minimum(np.diff(place, append=place[-1] + 2), 2)  # 0: the same side goes on; 1: the other side, or the next group
            mark = np.where(mark == 0, 0, np.where(place % 2 == 0, 1, 2))
            shown = list(map(self.decimals.__getitem__, ids * 3 + mark))
            first = np.concatenate([[0], bounds(end_a) + bounds(end_b)])
            forms = ["".join(shown[x:y])[:-1] for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
            self.bad[at : at + n] = False
        else:
            forms = []
        self.sums[:, at + n : at + n + m] = 0
        self.offset[at + n + 1 : at + n + m + 1] = self.offset[at + n]
        self.bad[at + n : at + n + m] = True
        del self.strings[at:]
        self.strings += forms + [""] * m
        if self.counts is not None:
            self._weigh(at, at + n + m)
        return units + bad

    def _weigh(self, lo: int, hi: int) -> None:
        """n_best and count_sum of slots from lo to before hi."""
        start = self.offset[lo : hi + 1]
        count, best = self.counts.find(self.keys[start[0] : start[-1]])
        for row, value in ((4, best), (5, count)):
            total = np.concatenate([[0], np.cumsum(value.astype(np.int64))])
            self.sums[row, lo:hi] = np.diff(total[start - start[0]])

    def weighted(self, counts: "Counts | None") -> None:
        """From now on slots have n_best and count_sum by these counts."""
        if counts is not None and (self.counts is None or self.counts.manifest != counts.manifest):
            self.counts = counts
            for lo in range(0, self.n, BLOCK):
                self._weigh(lo, min(self.n, lo + BLOCK))
        self.counts = counts

    def slots(self, texts: list) -> list[np.ndarray]:
        """The slots of the units of every text, in order; none for a null, empty or unfaithful text. Good until the next call."""
        cut = [self.units(t) if t else [] for t in texts]
        get, local = self.known.get, {}
        fresh = list(dict.fromkeys(u for units in cut for u in units if u not in self.known))
        short = [u for u in fresh if len(u) < LONGEST][: self.cache - self.n]
        kept = set(short)
        for lo in range(0, len(short), BLOCK):
            names = self._add(short[lo : lo + BLOCK], self.n)
            self.known.update(zip(names, range(self.n, self.n + len(names))))
            self.n += len(names)
        others = [u for u in fresh if u not in kept]
        at = self.n
        for lo in range(0, len(others), BLOCK):
            names = self._add(others[lo : lo + BLOCK], at)
            local.update(zip(names, range(at, at + len(names))))
            at += len(names)
        self.used = at
        found = []
        for units in cut:
            got = [get(u, -1) for u in units]
            if local and -1 in got:
                got = [local[u] if k < 0 else k for u, k in zip(units, got)]
            s = np.array(got, np.int64)
            found.append(s[:0] if len(s) and self.bad[s].any() else s)
        return found

    def links(self, slot: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The link keys of slots and, for each, the times of its slot."""
        lo, n = self.offset[slot], self.sums[3, slot]
        place = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        return self.keys[place], np.repeat(times, n)


def aligner(path_a: str, path_b: str) -> Aligner:
    """This process's aligner for two vocabulary files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    found, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, counts)
    return found, total


def partial_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """key, n: the link counts of each partition; a key may come more than once where a partition has over BUFFER distinct keys."""

    def rows(keys, n):
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], names=["key", "n"])

    def run(batches):
        own = aligner(path_a, path_b)
        own.weighted(None)
        times, buffer, size = np.zeros(own.cache, np.int64), [], 0
        for b in portions(batches):
            slots = own.slots(b.column(0).to_pylist())
            seen = np.bincount(np.concatenate(slots), minlength=own.used) if slots else np.zeros(own.used, np.int64)
            times[: own.n] += seen[: own.n]
            if own.used > own.n:
                beyond = own.n + np.flatnonzero(seen[own.n : own.used])
                buffer.append(summed(*own.links(beyond, seen[beyond])))
                size += len(buffer[-1][0])
            if size > BUFFER:
                buffer = [summed(*map(np.concatenate, zip(*buffer)))]
                size = len(buffer[0][0])
                if size > BUFFER:
                    yield from rows(*buffer[0])
                    buffer, size = [], 0
        used = np.flatnonzero(times)
        buffer += [summed(*own.links(at, times[at])) for at in np.array_split(used, 1 + len(used) // BLOCK)]
        yield from rows(*summed(*map(np.concatenate, zip(*buffer))))

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n long")


def _save(path: str, array: np.ndarray) -> None:
    data = io.BytesIO()
    np.save(data, array)
    fs, inner = filesystem(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner, compression=None) as out:
        out.write(data.getbuffer())


def count_shards(docs: DataFrame, path_a: str, path_b: str, shard: int = SHARD) -> DataFrame:
    """lo, hi (keys), n, path of the sorted shards of the corpus's link counts: <path>.keys.npy, .counts.npy, and .best.npy, rows (B, highest count)."""
    partial = materialize(partial_counts(docs, path_a, path_b), "align-partial")
    distinct = partial.agg(F.approx_count_distinct("key")).first()[0]
    folder = scratch(docs.sparkSession, "align-counts")

    def run(batches):
        keys, counts, held = [], [], 0

        def saved(k, c):
            path = f"{folder}/{uuid.uuid4().hex}"
            start = np.flatnonzero(np.diff(k >> 32, prepend=-1))
            for name, array in (("keys", k), ("counts", c), ("best", np.stack([k[start] >> 32, np.maximum.reduceat(c, start)], 1))):
                _save(f"{path}.{name}.npy", array)
            return pa.RecordBatch.from_pydict({"lo": [int(k[0])], "hi": [int(k[-1])], "n": [len(k)], "path": [path]})

        for b in batches:
            k, c = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            if not len(k):
                continue
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            k, c = k[start], np.add.reduceat(c, start)
            if keys and keys[-1][-1] == k[0]:
                counts[-1][-1] += c[0]
                k, c = k[1:], c[1:]
            if len(k):
                keys.append(k)
                counts.append(c)
                held += len(k)
            if held > shard:  # the last key may go on in the next batch
                k, c = np.concatenate(keys), np.concatenate(counts)
                yield saved(k[:-1], c[:-1])
                keys, counts, held = [k[-1:]], [c[-1:]], 1
        if held:
            yield saved(np.concatenate(keys), np.concatenate(counts))

    parts = partial.repartitionByRange(max(1, -(-distinct // shard)), "key").sortWithinPartitions("key")
    manifest = materialize(parts.mapInArrow(run, "lo long, hi long, n long, path string"), "align-manifest")
    discard(partial)
    return manifest


class Counts:
    """Counts of link keys from shards: manifest holds (lo, path), in order of lo."""

    def __init__(self, manifest: list[tuple[int, str]]):
        self.manifest, self.lows = manifest, np.array([lo for lo, _ in manifest], np.int64)
        self.held: dict[int, tuple] = {}
        tops = [self._load(f"{path}.best.npy") for _, path in manifest]
        self.top = np.zeros(1 + max((int(t[:, 0].max()) for t in tops), default=0), np.int64)
        for t in tops:
            np.maximum.at(self.top, t[:, 0], t[:, 1])

    @staticmethod
    def _load(path: str) -> np.ndarray:
        if path.startswith("file:") or "://" not in path:
            return np.load(path.removeprefix("file://"), mmap_mode="r")
        fs, inner = filesystem(path)
        with fs.open_input_stream(inner, compression=None) as f:
            return np.load(io.BytesIO(f.read()))

    def _shard(self, k: int) -> tuple:
        if k not in self.held:
            found = tuple(self._load(f"{self.manifest[k][1]}.{name}.npy") for name in ("keys", "counts"))
            if not isinstance(found[0], np.memmap) and len(self.held) >= RESIDENT:
                self.held.pop(next(iter(self.held)))
            self.held[k] = found
        return self.held[k]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each key, and whether it is the highest of its B."""
        distinct, place = np.unique(keys, return_inverse=True)
        count, where = np.zeros(len(distinct), np.int64), np.searchsorted(self.lows, distinct, "right") - 1
        for k in np.unique(where):
            if k >= 0:
                mine = np.flatnonzero(where == k)
                own, n = self._shard(int(k))
                at = np.minimum(np.searchsorted(own, distinct[mine]), len(own) - 1)
                count[mine] = np.where(own[at] == distinct[mine], n[at], 0)
        best = count == self.top[np.minimum(distinct >> 32, len(self.top) - 1)]
        return count[place], best[place]


def pair_counts(manifest: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus join token a of A and token b of B, read from count_shards()."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                keys, n = (Counts._load(f"{path}.{name}.npy") for name in ("keys", "counts"))
                for at in range(0, len(keys), 1 << 16):
                    k = keys[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array((k >> 32).astype(np.int32)), pa.array(np.asarray(n[at : at + (1 << 16)]))], names=["a", "b", "n"])

    return manifest.select("path").mapInArrow(run, "a int, b int, n long")


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def aligned(docs: DataFrame, path_a: str, path_b: str, manifest: DataFrame, hashed: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum of every row, with groups (`a1,a2|b1;a3|b2,b3`) or its groups_sha256."""
    shards = sorted((x.lo, x.path) for x in manifest.select("lo", "path").collect())  # a row per SHARD keys, bounded by the vocabularies
    last, loaded = "groups_sha256" if hashed else "groups", []

    def run(batches):
        own = aligner(path_a, path_b)
        if not loaded:
            loaded.append(own.counts if own.counts is not None and own.counts.manifest == shards else Counts(shards))
        own.weighted(loaded[0])
        for b in portions(batches):
            slots = own.slots(b.column(1).to_pylist())
            length = np.array([len(s) for s in slots])
            flat, ends = np.concatenate(slots), np.concatenate([[0], np.cumsum(length)])
            columns = [pa.array(np.diff(np.concatenate([[0], np.cumsum(row[flat])])[ends])) for row in own.sums]
            forms = [";".join(map(own.strings.__getitem__, s.tolist())) for s in slots]
            if hashed:
                forms = [hashlib.sha256(f.encode()).hexdigest() if f else "" for f in forms]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(forms, pa.string())], names=["doc_id", *NAMES, last])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + f", {last} string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The columns of the op13 contract."""
    return aligned(docs, path_a, path_b, count_shards(docs, path_a, path_b), hashed=True)
