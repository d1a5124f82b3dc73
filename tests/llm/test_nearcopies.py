import math
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from foliant.llm import nearcopies

DOCS = "doc_id long, text string"


def plain(rows):
    """doc_id -> smallest reachable doc_id, by comparing the shingle sets of all pairs."""

    def found(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label = {i: found(t) for i, t in rows}, {i: i for i, _ in rows}
    near = [(a, b) for a in sets for b in sets if a < b and (not sets[a] | sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def corpus():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    rows, texts = [], [" ".join(rnd.choices(words, k=rnd.randrange(40, 200))) for _ in range(30)]
    for i in range(200):
        t = rnd.choice(texts).split()
        for _ in range(rnd.randrange(5)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((i, " ".join(t)))
    return rows + [(300, None), (301, ""), (302, "ONE two"), (303, "one two"), (304, "a b c d e"), (305, "a b c d e f")]


def test_near_copies_match_brute_force(spark):
    rows = corpus()
    want = plain(rows)
    assert 30 < len(set(want.values())) < 190
    for cap in (nearcopies.CAP, 3):
        got = nearcopies.near_copies(spark.createDataFrame(rows, DOCS), cap).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_stage_removes_near_copies(spark):
    rows = corpus()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain(rows).values()))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "q r s"), (None, "zz y")], DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in nearcopies.near_copies(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (None, 1), (None, None)], key=str)
    assert nearcopies.near_copies(df.limit(0)).count() == 0


def brute(spark, rows, cap=nearcopies.CAP):
    got = nearcopies.near_copies(spark.createDataFrame(rows, DOCS).repartition(3), cap).collect()
    return {r.doc_id: r.component_id for r in got}


def test_a_long_chain_stays_one_group(spark):
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(60)]  # each is near the next only
    want = plain(rows)
    assert len(set(want.values())) == 1
    for cap in (nearcopies.CAP, 2):
        assert brute(spark, rows, cap) == want


def test_boilerplate_costs_no_comparisons(spark, monkeypatch):
    shared = [f"b{i}" for i in range(70)]
    rows = [(i, " ".join([f"u{i}_{k}" for k in range(32)] + shared)) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 300, 50)]
    assert len(set(plain(rows[:40]).values())) == 40
    seen = []
    whole = nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda docs, distinct, pairs: seen.append(pairs.count()) or whole(docs, distinct, pairs))
    got = brute(spark, rows)
    assert {k: v for k, v in got.items() if v != k} == {1000 + i: i for i in range(0, 300, 50)}
    assert sum(seen) < 2 * len(rows)  # of 44,000 pairs that share a fifth of their words


def test_groups_of_edited_copies_and_mixed_sizes(spark):
    rnd = random.Random(5)
    rows, k = [], 0
    for n in (6, 9, 30, 120):
        base = [f"g{n}_{i}" for i in range(n)]
        for _ in range(40):
            t = list(base)
            for _ in range(rnd.randrange(3)):
                t[rnd.randrange(n)] = f"x{rnd.randrange(50)}"
            if rnd.random() < 0.3:
                t = t + [f"y{rnd.randrange(99)}" for _ in range(rnd.randrange(n // 3 + 1))]
            rows.append((k := k + 1, " ".join(t)))
    want = plain(rows)
    assert 5 < len(set(want.values())) < 150
    for cap in (nearcopies.CAP, 5):
        assert brute(spark, rows, cap) == want


def test_a_very_long_text_and_clashing_columns(spark):
    rnd = random.Random(2)
    long = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    other = list(long)
    for i in range(0, 60_000, 300):
        other[i] = "changed"
    rows = [(1, " ".join(long), 3, "p", 0), (2, " ".join(other), 3, "p", 0), (3, "short text", 1, "q", 1), (None, None, 1, "q", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, prefix string, node long")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(df).collect()} == {1: 1, 2: 1, 3: 3, None: None}


def batches(rows, names, step):
    cut = [rows[i : i + step] for i in range(0, len(rows), step)]
    return [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*part)], names=names) for part in cut]


def distance(a, b):
    return sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b))


def recorded(monkeypatch):
    """The widths of all fingerprints that are compared by bit planes."""
    seen, whole = [], nearcopies.bit_sliced_links
    monkeypatch.setattr(nearcopies, "bit_sliced_links", lambda fps, *more: seen.append(64 * fps.size // max(1, len(fps))) or whole(fps, *more))
    return seen


@pytest.mark.parametrize("step", [10_000, 70, 1])
def test_first_pairs_are_the_nearest_fingerprints(monkeypatch, step):
    r, seen = np.random.default_rng(3), recorded(monkeypatch)
    rows, base = [], r.integers(0, 1 << 63, 4, np.int64)
    for h, many in enumerate((1, 2, 300, 1, 40, 3)):
        for n in sorted(r.integers(80, 100, many).tolist()):
            rows.append((h, n << 31, len(rows), int(base[r.integers(4)]) ^ sum(1 << int(b) for b in set(r.integers(0, 63, r.integers(0, 12)).tolist()))))
    out = [x for b in nearcopies._first_pairs(iter(batches(rows, ["h", "size", "node", "bits"], step))) for x in b.to_pylist()]
    assert sorted(x["node"] for x in out if x["h"] is not None) == [x[2] for x in rows if x[0] not in (0, 3)]
    got = {}
    for x in out:
        if x["h"] is None:
            a, b = rows[x["a"]], rows[x["node"]]
            assert a[0] == b[0] and (d := (a[3] ^ b[3]).bit_count()) <= nearcopies.CLOSE
            got.setdefault(x["a"], []).append(d)
    for i, (h, size, _, bits) in enumerate(rows):
        later = [x for x in rows[i + 1 : i + 1 + nearcopies.WINDOW] if x[0] == h and nearcopies.overlap_possible(size >> 31, 0, x[1] >> 31, 0)]
        want = sorted(d for x in later if (d := (bits ^ x[3]).bit_count()) <= nearcopies.CLOSE)[: nearcopies.NEAREST]
        found = sorted(got.get(i, []))
        assert found == want if step > len(rows) else found[: len(want)] == want
    assert seen and set(seen) == {64}


@pytest.mark.parametrize("step", [10_000, 50])
def test_crossing_pairs_are_compared_by_bit_planes(monkeypatch, step):
    rnd, seen = random.Random(6), recorded(monkeypatch)
    base, rows = [[f"c{k}_{i}" for i in range(60)] for k in range(3)], []
    for g, (many, chunks, roots) in enumerate([(50, 1, 9), (1, 1, 1), (80, 2, 30), (20, 1, 1)]):
        part = []
        for _ in range(many):
            t = list(rnd.choice(base))
            for _ in range(rnd.randrange(4)):
                t[rnd.randrange(60)] = f"x{rnd.random()}"
            s = nearcopies.shingles(" ".join(t))
            part.append((g, rnd.randrange(chunks), len(rows) + len(part), len(s), 0, rnd.randrange(roots), nearcopies.sketch(s).tobytes(), nearcopies.fingerprint(s).tobytes()))
        rows += sorted(part, key=lambda x: x[3])
    names = ["g", "own", "node", "n", "place", "root", "bins", "print"]
    got = sorted((x["a"], x["b"]) for b in nearcopies._crossing(iter(batches(rows, names, step))) for x in b.to_pylist())
    want, left_out = [], 0
    for k, x in enumerate(rows):
        for y in rows[k + 1 :]:
            if x[0] != y[0] or x[5] == y[5] or (x[0] == 2 and x[1] == y[1]) or not nearcopies.overlap_possible(x[3], 0, y[3], 0):
                continue
            b, c = (np.frombuffer(z[6], "<u8").reshape(2, -1) for z in (x, y))
            apart = int(np.bitwise_count((b[0] ^ c[0]) | (b[1] ^ c[1])).sum())
            ok = distance(*(np.frombuffer(z[7], "<u8") for z in (x, y))) <= nearcopies.RADIUS
            left_out += not ok
            if ok and apart <= min((x[3] + y[3]) // 9, nearcopies.FAR):
                want.append((min(x[2], y[2]), max(x[2], y[2])))
    assert got == sorted(want) and len(want) > 50 and left_out > 50
    assert seen and set(seen) == {64 * nearcopies.WIDTH}


def test_fingerprints_are_majorities_and_miss_no_similar_pair():
    s = nearcopies.shingles(" ".join(f"m{i % 37}" for i in range(301)) + " tail")
    h = nearcopies._mixed(s[:, None] ^ nearcopies._TURN)
    plain = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[:, k]) > len(s)) for k in range(nearcopies.WIDTH)]
    assert nearcopies.fingerprint(s).tolist() == plain and not nearcopies.fingerprint(s[:0]).any()

    def ways(n):
        return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])

    def differ(n, m, both):
        """How likely one bit differs between sets of n and m shingles with so many in common."""
        one = [[ways(k - both)[2 * (np.arange(k - both + 1) + s) > k].sum() for s in range(both + 1)] for k in (n, m)]
        return sum(w * (a * (1 - b) + b * (1 - a)) for w, a, b in zip(ways(both), *one))

    up, down = nearcopies.LEAST
    most = 0
    for n in range(1, 60):
        for m in range(-(-up * n // down), n + 1):
            both = -(-up * (n + m) // (up + down))
            if both <= m:
                most = max(most, differ(n, m, both))
    bits = 64 * nearcopies.WIDTH
    assert most == 0.1875  # of five and four shingles; of many it is 0.152
    assert sum(math.comb(bits, k) * most**k * (1 - most) ** (bits - k) for k in range(nearcopies.RADIUS + 1, bits + 1)) < 1e-12
