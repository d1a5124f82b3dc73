import random

import numpy as np
import pytest
import xxhash

from foliant.llm import simhash

DOCS = "doc_id long, text string, fp string, component_id string"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    ids, label = sorted(fps), {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprint_matches_plain():
    for t in ("", None, "a", "A b", "a b c", "É a\tb\nc  d", "x " * 5000, "ÀB c d e f"):
        assert simhash.simhash(t) == plain_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_bit_sliced_links(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 1 << 63, 8, np.uint64)
    fps = np.array([base[r.integers(8)] ^ np.uint64(sum(1 << int(b) for b in r.integers(0, 64, r.integers(0, 8)))) for _ in range(300)], np.uint64)
    end = np.repeat([100, 101, 300], [100, 1, 199])
    got = {(int(i), int(j)) for a, b in simhash.bit_sliced_links(fps, end, radius, 64) for i, j in zip(a, b)}
    want = {(i, j) for i in range(300) for j in range(i + 1, int(end[i])) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize("width, radius", [(2, 9), (8, 163)])
def test_bit_sliced_links_of_wide_fingerprints(width, radius):
    r = np.random.default_rng(radius)
    fps = r.integers(0, 1 << 64, (5, width), np.uint64)[r.integers(0, 5, 200)]
    for k in range(200):
        for b in r.integers(0, 64 * width, r.integers(0, radius)):
            fps[k, b // 64] ^= np.uint64(1 << int(b) % 64)
    end = np.repeat([90, 91, 200], [90, 1, 109])
    got = {(int(i), int(j)) for a, b in simhash.bit_sliced_links(fps, end, radius, 64) for i, j in zip(a, b)}
    apart = {(i, j): int(np.bitwise_count(fps[i] ^ fps[j]).sum()) for i in range(200) for j in range(i + 1, int(end[i]))}
    assert got == {k for k, d in apart.items() if d <= radius} and 0 < len(got) < len(apart)
    assert not list(simhash.bit_sliced_links(fps[:0], end[:0], radius))


def test_components_match_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(words, k=150)) for _ in range(40)]
    rows = []
    for i in range(220):
        t = rnd.choice(texts).split()
        if i % 3:
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(300, None), (301, ""), (302, " \t"), (303, "ONE"), (304, "one")]
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)).collect()
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == plain_components(fps)


def test_split_buckets_lose_no_link(spark):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(30)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = simhash.connected_components(simhash.links(df, cap=50))
    assert {r.root for r in roots.collect()} == {min(fps)} and roots.count() == len(fps) - 1


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "q r s"), (None, "zz y")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (None, 1), (None, None)], key=str)
    kept = simhash.deduplicate(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "zz y"), (1, "a b c"), (3, "q r s")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0
