import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from foliant.llm import bpe, tokenfile
from foliant.llm.queries import vocabulary

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = ["a", "the", "ing", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "'s", "'re", "'", "1", "23", "!!", "Σ", "İ", "中", "é", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x00", "😀", "A", "ﬁ"]


def samples():
    r = random.Random(5)
    some = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(800)]
    some += ["".join(r.choice(["th", "e", "ing", "ab", "x", "é"]) for _ in range(r.randint(25, 900))) for _ in range(60)]
    return some + ["a" * n for n in range(20, 90)] + ["ab" * 20000, "!" * 333, "中文" * 99, "1" * 80]


@pytest.mark.parametrize("name", NAMES)
def test_encoder_equals_library(name):
    library, own = Tokenizer.from_file(vocabulary(name)), bpe.Bpe(vocabulary(name), leaf=6, span=9)
    for t in samples():
        want = library.encode(t, add_special_tokens=False).ids
        for tree in (True, False):
            assert np.frombuffer(own.encode(t, tree), "<u4").tolist() == want, t[:60]
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", NAMES)
def test_tree_concatenates_the_shared_documents(name):
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t]
    long = [t for t in texts if len(t) > bpe.SPAN] + [" ".join(texts[:40])]
    library, own = Tokenizer.from_file(vocabulary(name)), bpe.Bpe(vocabulary(name))
    for t in long:
        before = own.joins
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        # a text of n spans has at least n - 1 joins, and each window is a few units wide
        assert own.joins - before >= -(-len(t) // bpe.SPAN) - 1
    assert len(long) > 50 and own.joins > 200


@pytest.mark.parametrize("name", NAMES)
def test_a_slice_of_texts_equals_library(name):
    library, own = Tokenizer.from_file(vocabulary(name)), bpe.Bpe(vocabulary(name))
    texts = [*samples(), None, "", "\n", " ", "a b\nc", "a\n b ", None, " ".join(["é"] * 3000)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        for lo, hi in ((0, len(texts)), (5, 700), (len(texts) - 7, len(texts)), (3, 3)):
            got = own.encode_all(pa.array(texts, kind).slice(lo, hi - lo))
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == want[lo:hi]


def test_token_files_look_up_each_unit_once_a_slice(monkeypatch):
    own, asked = bpe.Bpe(vocabulary(NAMES[0])), []
    leaves = own.leaves
    monkeypatch.setattr(own, "leaves", lambda units: asked.extend(units) or leaves(units))
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(words[k % 50 :] + words) for k in range(1000)]
    got = own.encode_all(pa.array(texts))
    assert len(asked) == len(set(asked)) <= 2 * len(words)
    assert got == [own.encode(t, tree=False) for t in texts]


def test_unsafe_texts_are_found():
    import re

    r, table = random.Random(1), bpe.spaces_or_controls()
    want = re.compile(r"\s\s\s|\s\s\Z|[\x1c-\x1f\x00]").search
    for _ in range(20000):
        t = "".join(r.choice("aé中 \n\t\u3000\u2003\x85\x1d😀bcdefgh") for _ in range(r.randint(1, 12)))
        assert bpe.unsafe(t, table) == bool(want(t)), repr(t)


def test_bpe_digests(spark):
    library = Tokenizer.from_file(vocabulary(NAMES[1]))
    rows = [(1, "Hello  wörld"), (2, None), (3, ""), (3, "Hello"), (None, "x" * 3000)]
    got = bpe.digests(spark.createDataFrame([(d, t, "a", 5) for d, t in rows], "doc_id long, text string, ids string, n_tokens int"), vocabulary(NAMES[1])).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d or 0, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), vocabulary(NAMES[1])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 33000, 150_000])
def test_segments_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 1 << (23 if n == 65 else 16)).astype(np.uint32)
    docs = [(None if i == 2 else i, x) for i, x in enumerate(np.split(ids, sorted(r.integers(0, n + 1, 9).tolist())))]
    data = tokenfile.pack(docs)
    doc_ids, lengths, back = tokenfile.unpack(data)
    assert doc_ids == [d for d, _ in docs] and lengths.tolist() == [len(x) for _, x in docs] and (back == ids).all()
    if n > 100_000:
        assert (tokenfile.unpack(data, range(1, 3))[2] == ids[tokenfile.BLOCK : 3 * tokenfile.BLOCK]).all()
        assert len(data) < 2 * n
    for at in (tokenfile.HEAD.size, len(data) - 1):
        if at < len(data):
            bad = bytearray(data)
            bad[at] ^= 1
            with pytest.raises(tokenfile.Corrupt):
                tokenfile.unpack(bytes(bad))


def test_token_files(spark):
    library = Tokenizer.from_file(vocabulary(NAMES[0]))
    rows = [(5, "five five"), (1, None), (3, "three " * 400), (2, ""), (9, "nine"), (None, "none")]
    got = tokenfile.round_trip(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int"), vocabulary(NAMES[0])).collect()
    start, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert tokenfile.round_trip(spark.createDataFrame([], "doc_id long, text string"), vocabulary(NAMES[0])).count() == 0


def test_token_files_with_repeated_ids(spark):
    library = Tokenizer.from_file(vocabulary(NAMES[0]))
    rows = [(i // 3, f"text {i} " * (1 + i % 5)) for i in range(60)] + [(7, "same"), (7, "same"), (70, "word " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = tokenfile.round_trip(df, vocabulary(NAMES[0])).collect()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids) + 1
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((d, count(t)) for d, t in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
