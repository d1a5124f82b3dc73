import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliant.llm import align
from foliant.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
PARTS = ["a", "the", "ing", "é", "ß", " ", "  ", "   ", "\n", "\n\n", "\t", "'s", "'", "1", "23", "!!", "Σ", "中", "é", "<|endoftext|>", "<s>", "\x1c", "\x00", "😀", "A", "ﬁ", " ", "　", "Ⅳ"]


def brute(texts):
    """Whole texts through the libraries, one by one, and loops over their tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: n for n, c in align.byte_alphabet().items()}
    every = []
    for t in texts:
        if not t:
            every.append(None)
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            every.append(None)
            continue
        links, groups, x, y, ex, ey, ga, gb = [], [], 0, 0, len(ba[0]), len(bb[0]), [], []
        while True:
            links.append((ia[x], ib[y]))
            step = (ex <= ey, ey <= ex)
            if step[0]:
                ga.append(ia[x])
            if step[1]:
                gb.append(ib[y])
            if all(step):
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
            x, y = x + step[0], y + step[1]
            if x == len(ia):
                break
            ex, ey = ex + step[0] * len(ba[x]), ey + step[1] * len(bb[y])
        every.append((len(ia), len(ib), links, groups))
    count = Counter(p for e in every if e for p in e[2])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    rows = []
    for e in every:
        if e is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n = [count[p] for p in e[2]]
            rows.append((e[0], e[1], len(e[3]), len(e[2]), sum(k == top[p[1]] for k, p in zip(n, e[2])), sum(n), ";".join(e[3])))
    return rows, count


def samples():
    r = random.Random(7)
    some = ["".join(r.choice(PARTS) for _ in range(r.randint(1, 40))) for _ in range(500)]
    some += [" ".join("".join(r.choice(["th", "er", "ing", "é", "ou", "x", "."]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 200))) for _ in range(60)]
    return some + ["", None, " ", "  ", "▁", "a▁ b", "x" * 5000, "word " * 3000, "a  b", "中文" * 300, "the same", "the same"]


@pytest.mark.parametrize("cache", [40, align.CACHE])
def test_units_equal_whole_texts(cache):
    texts = samples()
    own = align.Aligner(A, B, cache=cache)
    want, _ = brute(texts)
    for at in range(0, len(texts), 37):
        part = texts[at : at + 37]
        for slots, w in zip(own.slots(part), want[at : at + 37]):
            assert [int(own.sums[k, slots].sum()) for k in range(4)] == list(w[:4])
            assert ";".join(own.strings[s] for s in slots) == w[6]


def test_alignment(spark, monkeypatch):
    texts = samples()
    want, count = brute(texts)
    rows = [(None if i % 50 == 3 else i // 2, t, i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, groups string").repartition(3)
    monkeypatch.setattr(align, "BUFFER", 100)
    manifest = align.count_shards(docs, A, B, shard=64)
    assert manifest.count() > 3
    assert {(x.a, x.b): x.n for x in align.pair_counts(manifest).collect()} == dict(count)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    names = ["doc_id", *align.NAMES, "groups"]
    got = align.aligned(docs, A, B, manifest)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
    short = align.digests(docs, A, B).collect()
    assert Counter(x.groups_sha256 for x in short) == Counter(hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "" for w in want)


def test_no_rows_and_no_tokens(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.digests(docs, A, B).collect() == []
    assert [tuple(x) for x in align.digests(spark.createDataFrame([(1, None), (None, "▁")], "doc_id long, text string").coalesce(1), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_counts_without_a_mounted_folder(monkeypatch):
    counts = align.Counts([])
    assert [x.tolist() for x in counts.find(np.array([5, 5], np.int64))] == [[0, 0], [True, True]]
