"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has a row per hash position and a bit per language in it, so the AND of an n-gram's HASHES rows
is the set of all languages that contain the n-gram. The n-grams of a text are looked up, a popcount is kept per language
and corrected for that language's false-positive rate, and the largest corrected share decides.

The filter is fitted on at most PER_LANG documents of each language (by hash of the text, all of a rarer language): an n-gram
belongs to a language if its document rate there is at least MIN_RATE and SHARE times its highest rate in any language, at
most GRAMS of them, the most frequent first. N-grams are of three lower-cased letters, with anything else as a single blank
character, and have two letters at least. The filter's size depends on the number of languages alone.

Defined results: `und`, score 0, for a null text, a text without a letter, or if nothing could be learned; texts whose
n-grams are in no filter get the first language by name with score 0; ties go to the language first by name. A null doc_id
counts as an empty text under crc32, so it is held out. An empty table gives an empty result. Only doc_id, text and lang
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, portions

PER_LANG, GRAMS, MIN_RATE, SHARE, BITS, HASHES, PIECE = 2000, 20000, 0.002, 0.3, 18, 3, 1 << 18
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
TURNS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return kept("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, n-gram hashes, their text's number from first, whether each text has a letter) of stretches of the texts,
    about PIECE characters each. Every text has a blank of its own at both ends, so no n-gram spans two texts."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < PIECE):
            size += len(texts[to]) + 2
            to += 1
        part = [t.lower() for t in texts[at:to]]
        c = np.frombuffer("".join(f" {t} " for t in part).encode("utf-32-le", "replace"), "<u4")
        owner = np.repeat(np.arange(to - at), [len(t) + 2 for t in part])
        letter = letters()[c]
        some = np.bincount(owner[letter], minlength=to - at) > 0
        c = np.where(letter, c, 0).astype(np.uint64)
        if len(c) < 3:
            yield at, to, np.zeros(0, np.uint64), np.zeros(0, np.int64), some
        else:
            n = letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:]
            keep = np.flatnonzero(n >= 2)
            h = c[keep] * FACTORS[0] + c[keep + 1] * FACTORS[1] + c[keep + 2] * FACTORS[2]
            h ^= h >> np.uint64(32)
            h *= FACTORS[1]
            h ^= h >> np.uint64(29)
            yield at, to, h, owner[keep], some
        at = to


def positions(h: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    return [((h * t) >> np.uint64(64 - bits)).astype(np.int64) for t in TURNS[:HASHES]]


class Filter:
    """Bit-sliced Bloom filter: words[p, w] holds bits of the languages 64 w .. 64 w + 63 at position p."""

    def __init__(self, languages: list[str], sets: list[np.ndarray], bits: int = BITS):
        self.languages, self.bits = languages, bits
        self.words = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64)
        fill = []
        for k, own in enumerate(sets):
            for p in positions(own, bits):
                self.words[k // 64][np.unique(p)] |= np.uint64(1 << k % 64)
            fill.append(((self.words[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean())
        self.wrong = np.array(fill) ** HASHES

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each text's n-grams in each language [texts, languages], and whether it has a letter."""
        out = np.zeros((len(texts), len(self.languages)))
        some = np.zeros(len(texts), bool)
        for at, to, h, owner, letter in grams(texts):
            some[at:to] = letter
            n = np.bincount(owner, minlength=to - at)
            rows = positions(h, self.bits)
            for w, table in enumerate(self.words):
                mask = table[rows[0]]
                for r in rows[1:]:
                    mask &= table[r]
                for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                    hit = np.bincount(owner, ((mask >> np.uint64(k % 64)) & np.uint64(1)).astype(np.float64), to - at)
                    out[at:to, k] = (hit / np.maximum(n, 1) - self.wrong[k]) / (1 - self.wrong[k])
        return np.clip(out, 0, 1), some


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Filter:
    """The filter learned from the documents that are not held out and have a language."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Filter([], [])
    ceiling = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, per_lang / counts[k]))) for k in languages))
    drawn = usable.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < ceiling * (1 << 30))

    def count(batches):
        tables: dict[str, list[np.ndarray]] = {}
        docs_of: dict[str, int] = {}
        for b in portions(batches):
            lang, texts = np.array(b.column(0).to_pylist()), b.column(1).to_pylist()
            for at, to, h, owner, _ in grams(texts):
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, owner = h[first], owner[first]
                for k in np.unique(lang[at:to]):
                    tables.setdefault(str(k), []).append(h[(lang[at:to] == k)[owner]])
                    docs_of[str(k)] = docs_of.get(str(k), 0) + int((lang[at:to] == k).sum())
        for k, found in tables.items():
            h, n = np.unique(np.concatenate(found), return_counts=True)
            names = pa.array([k] * (len(h) + 1))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.append(h.view("<i8"), 0)), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(h), np.int64), docs_of[k]))], names=["lang", "gram", "n", "docs"])

    counted = drawn.mapInArrow(count, "lang string, gram long, n long, docs long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rated = counted.withColumn("rate", F.col("n") / F.sum("docs").over(Window.partitionBy("lang"))).where(F.col("rate") >= MIN_RATE)
    rated = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("top"))
    chosen = rated.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))).where(F.col("place") <= GRAMS)
    found = chosen.select("lang", "gram").toPandas()
    return Filter(languages, [found.gram[found.lang == k].to_numpy(np.int64).view(np.uint64) for k in languages])


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, held_out, lang_pred, score (margin of the best language's share over the second's) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        names = np.array([*m.languages, "und"], object)
        for b in portions(batches):
            best, score = np.full(b.num_rows, len(m.languages)), np.zeros(b.num_rows)
            texts = [t or "" for t in b.column(2).to_pylist()]
            if m.languages and texts:
                shares, some = m.shares(texts)
                pick = shares.argmax(1)
                two = np.sort(np.pad(shares, ((0, 0), (1, 0))), axis=1)[:, -2:]
                best[some], score[some] = pick[some], (two[:, 1] - two[:, 0])[some]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Filter, least: float) -> DataFrame:
    """The documents with a language whose score is at least `least`, all columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in portions(batches):
            texts = [t or "" for t in b.column("text").cast(pa.string()).to_pylist()]
            if not texts or not m.languages:
                continue
            shares, some = m.shares(texts)
            two = np.sort(np.pad(shares, ((0, 0), (1, 0))), axis=1)[:, -2:]
            yield b.filter(pa.array(some & (two[:, 1] - two[:, 0] >= least)))

    return docs.mapInArrow(run, docs.schema)
