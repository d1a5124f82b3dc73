"""BPE encoding by tree concatenation, and decoding.

A text of over SPAN characters is cut in the middle, wherever that falls; its halves are encoded apart (long ones in parallel
threads), down to SPAN. Then windows around each join, 1, 2, 4, ... units to either side, are encoded again, until the first
unit of the window and the last one are what the halves have there, text and ids. As a unit ends at white space, which can be
seen in two neighbouring characters, what lies beyond such a unit cannot change, so the spliced sequence is exactly the
encoding of the whole. A short text, the leaf of the tree, is a list of units; each is encoded once and remembered.

An unsplit pre-token longer than LEAF is a tree of its own, of tokens: its halves are encoded apart, then windows of 2, 4, 8, ...
tokens around the join, until the first token of the window equals the left half's and the last one the right half's. Every
adjacent pair of the spliced sequence then occurs in one BPE encoding, so the sequence is the encoding of the whole.

Both kinds of vocabulary are covered: byte-level without normalizer ("byte"; a unit begins with its space) and lower-case
words with an end-of-word suffix ("word"; white space is dropped). Texts outside the rules proven for the units (special
tokens, runs of spaces) go to the library whole.

Defined results: a null or empty text has no tokens and decodes to the empty text; repeated rows stay; an empty table
gives an empty result. Only doc_id and text are read. Memory is bounded by CACHE entries and one portion of a batch of texts.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, portions

SPAN, LEAF, CACHE, PARALLEL = 1024, 24, 300_000, 1 << 14
#: The pre-token patterns of the two vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def spaces_or_controls() -> np.ndarray:
    """By code point up to the last white space: 1 white space, 2 controls that no unit may hold, else 0."""
    found = np.array([chr(c).isspace() for c in range(0x3002)], np.uint8)
    found[[0, 0x1C, 0x1D, 0x1E, 0x1F]] = 2
    return found


def unsafe(text: str, table: np.ndarray) -> bool:
    """Whether a text holds three white spaces in a row, two at its end, or a control of the table."""
    c = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), len(table) - 1)
    kind = table[c]
    if kind.max() == 2:
        return True
    two = kind[1:] & kind[:-1]
    return bool(len(two) and (two[-1] or (two[1:] & two[:-1]).any()))


class Bpe:
    def __init__(self, path: str, leaf: int = LEAF, span: int = SPAN):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        self.span, self.joins = max(2, span), 0
        self.leaf, self.kind = leaf, "word" if model.get("end_of_word_suffix") else "byte"
        self.model = self.library.model
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = BPE(model["vocab"], merges) if self.kind == "word" else self.model  # for pieces that do not end their word
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces = regex.compile(WORD_PATTERN if self.kind == "word" else BYTE_PATTERN).findall
        self.odd = regex.compile(r"[\x1c-\x1f]").search
        self.alphabet, self.table = byte_alphabet(), spaces_or_controls()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.strings = [self.library.id_to_token(i) or "" for i in range(size)]
        self.decimals = [str(i) for i in range(size)]
        self.units: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    # one pre-token, in the byte alphabet
    def _plain(self, piece: str, ends: bool) -> list:
        return [(t.id, t.value) for t in (self.model if ends else self.inner).tokenize(piece)]

    def _raw(self, value: str, last: bool) -> str:
        return value[:-4] if last and self.kind == "word" else value

    def tree(self, piece: str, ends: bool = True) -> list:
        """(id, token) of one unsplit piece; ends: it ends its pre-token."""
        if len(piece) <= self.leaf:
            return self._plain(piece, ends)
        half = len(piece) // 2
        parts = ((piece[:half], False), (piece[half:], ends))
        if len(piece) > PARALLEL:
            with ThreadPoolExecutor(2) as pool:
                left, right = pool.map(lambda x: self.tree(*x), parts)
        else:
            left, right = (self.tree(*x) for x in parts)
        return self.join(left, right, ends)

    def join(self, left: list, right: list, ends: bool) -> list:
        w = 2
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            closed = ends and b == len(right)
            text = "".join(v for _, v in left[a:]) + "".join(v for _, v in right[: b - closed]) + (self._raw(right[-1][1], True) if closed else "")
            window = self._plain(text, closed)
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            w *= 2

    def _word(self, piece: str, keep: bool = True) -> bytes:
        """The ids of one pre-token as unsigned 32-bit integers; a unit of one pre-token is remembered as a unit only."""
        found = self.words.get(piece) or self.units.get(piece)
        if found is None:
            shown = piece.encode("utf-8").decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.model.tokenize(shown)] if len(shown) <= self.leaf else [i for i, _ in self.tree(shown)]
            found = np.array(ids, "<u4").tobytes()
            if keep and len(self.words) < CACHE:
                self.words[piece] = found
        return found

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        """The ids of what stands between two spaces, with its space in front for byte vocabularies.

        There the pattern takes a run of white space but for its last character, so runs of at most two characters
        may be cut anywhere; longer ones, or two at the end, go to the library."""
        if unit.isascii() or max(unit) < "ɐ" and unicodedata.is_normalized("NFC", unit):
            text = unit.lower() if self.kind == "word" else unit
            body = text[1:] if text[0] == " " else text
            if body.isalpha():
                found = self._word(text, keep=text != unit or len(self.units) >= CACHE)
            elif body[:-1].isalpha() and text[-1] in ".,":
                found = self._word(text[:-1]) + self._word(text[-1])
            else:
                found = b"".join(map(self._word, self.pieces(text)))
        elif len(unit) <= self.leaf:
            found = self._library(unit)
        else:
            text = self.library.normalizer.normalize_str(unit) if self.library.normalizer else unit
            found = b"".join(np.array([i for i, _ in self.tree(p)], "<u4").tobytes() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
        if len(self.units) < CACHE and len(unit) < 64:
            self.units[unit] = found
        return found

    def split(self, text: str) -> list[str]:
        """The units of a text within the rules."""
        if self.kind == "word":
            return text.split()
        return [u for u in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if u]

    def leaves(self, units: list[str]) -> list[bytes]:
        """The ids of each unit."""
        found = list(map(self.units.get, units))
        if None in found:
            found = [f if f is not None else self.units.get(u) or self._unit(u) for u, f in zip(units, found)]
        return found

    def concatenated(self, text: str) -> tuple[list[str], list[bytes]]:
        """Units and their ids of a text within the rules, by tree concatenation."""
        if len(text) <= self.span:
            units = self.split(text)
            return units, self.leaves(units)
        half = len(text) // 2
        parts = (text[:half], text[half:])
        if len(text) > PARALLEL:
            with ThreadPoolExecutor(2) as pool:
                left, right = pool.map(self.concatenated, parts)
        else:
            left, right = map(self.concatenated, parts)
        return self.splice(left, right, " " if self.kind == "word" else "", text[half - 1].isspace() or text[half].isspace())

    def splice(self, left: tuple[list, list], right: tuple[list, list], between: str, apart: bool) -> tuple[list, list]:
        """One sequence of two; between: what stood between the units of either, apart: it also stands at the join."""
        (units, ids), (units_2, ids_2), w = left, right, 1
        while True:
            a, b = max(0, len(units) - w), min(w, len(units_2))
            window = self.split(between.join(units[a:]) + (between if apart else "") + between.join(units_2[:b]))
            found = self.leaves(window)
            self.joins += 1
            starts_alike = a == 0 or (window[0], found[0]) == (units[a], ids[a])
            if starts_alike and (b == len(units_2) or (window[-1], found[-1]) == (units_2[b - 1], ids_2[b - 1])):
                units[a:], ids[a:] = window + units_2[b:], found + ids_2[b:]
                return units, ids
            w *= 2

    def outside(self, text: str) -> bool:
        """Whether the rules for units do not hold for a text."""
        return any(s in text for s in self.special) or (bool(self.odd(text)) if self.kind == "word" else unsafe(text, self.table))

    def encode(self, text: str | None, tree: bool = True) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; tree: long texts by tree concatenation, else unit by unit."""
        if not text:
            return b""
        if self.outside(text):
            return self._library(text)
        return b"".join(self.concatenated(text)[1] if tree else self.leaves(self.split(text)))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """encode(t, tree=False) of every text. Arrow splits byte-level texts and finds their distinct units, so that each is looked up once."""
        rows = texts.to_pylist()
        if self.kind == "word" or not rows:
            return [self.encode(t, tree=False) for t in rows]
        apart = [bool(t) and self.outside(t) for t in rows]
        plain = pc.if_else(pa.array(apart, pa.bool_()), "", pc.fill_null(texts, ""))
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0"), "\0")
        units = lists.flatten().dictionary_encode()
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units.dictionary)], pa.int32()), units.dictionary.cast(pa.string())), "\0")[0].as_py()
        known = self.leaves(names.split("\0"))
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        pool, first, index = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size, dtype=np.int32) - size, units.indices.to_numpy()
        n = size[index]
        ends = np.cumsum(n, dtype=np.int32)
        place = np.repeat(first[index] - ends + n, n)
        place += np.arange(len(place), dtype=np.int32)
        data, bounds = pool[place].tobytes(), [0, *(ends[np.cumsum(lists.value_lengths().to_numpy()) - 1].astype(np.int64) * 4).tolist()]
        return [self._library(t) if out else data[a:z] for t, out, a, z in zip(rows, apart, bounds, bounds[1:])]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with skip_special_tokens=False."""
        if self.kind == "word":
            return " ".join(map(self.strings.__getitem__, ids))
        return self.library.decode(ids, skip_special_tokens=False)


def encoder(path: str) -> Bpe:
    """This process's encoder for a vocabulary file."""
    return kept(("bpe", path), lambda: Bpe(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""

    def run(batches):
        bpe = encoder(path)
        for b in portions(batches):
            ids = [np.frombuffer(bpe.encode(t), "<u4") for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The columns of the op5 contract: encode, then decode from the ids, in one pass over the texts."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches):
        bpe = encoder(path)
        for b in portions(batches):
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = np.frombuffer(bpe.encode(t), "<u4").tolist()
                n.append(len(ids))
                a.append(sha(" ".join(map(bpe.decimals.__getitem__, ids))))
                d.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
