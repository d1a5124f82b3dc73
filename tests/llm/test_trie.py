import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from foliant.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, conv long, depth int"


def brute(rows):
    """The contract by dictionaries: rows are (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    new = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
    members = {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[b] for b in below) if below else 1
        saved[key] = sum(saved[b] for b in below) + ((len(members[key]) - 1) * len(key[-1][1]) if key else 0)
    found = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(new[c]) == len(key))
        found.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(children.get(key, [])), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def conversations():
    r = random.Random(2)
    rows = []
    for c in [*range(0, 8), *range(95, 135), *range(200, 260), 305, -1, -7, 1000, 1003, 1019]:
        for k in range(r.randint(1, 9)):
            rows.append((c, k if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["hi", "ho", "a longer text, é😀", "", None, "x" * 70 + str(r.randint(0, 3))])))
    rows += [(c, k, "user", "same") for c in range(400, 430) for k in range(4)]  # copies
    rows += [(500, k, "user", f"t{k % 50}") for k in range(700)]  # one long conversation
    rows += [(501, 3, "user", "twice"), (501, 3, "user", "twice"), (501, 3, "assistant", "tie"), (501, 3, "user", "another"), (None, 1, "user", "lost"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("cap, chunk", [(trie.CAP, trie.CHUNK), (40, 7)])
def test_nodes_equal_brute_force(spark, monkeypatch, cap, chunk):
    monkeypatch.setattr(trie, "RANGE", 100)
    rows = conversations()
    df = spark.createDataFrame([(*x, 5, 6) for x in rows], SCHEMA).repartition(5)
    assert found(trie.nodes(df, cap=cap, chunk=chunk)) == brute(rows)


def test_no_rows_and_one_row(spark):
    assert found(trie.nodes(spark.createDataFrame([], SCHEMA))) == []
    for row in [(7, None, None, None), (3, 1, "user", "x" * 200_000)]:
        assert found(trie.nodes(spark.createDataFrame([(*row, 5, 6)], SCHEMA))) == brute([row])


def test_pieces_of_ends(spark):
    ends = spark.range(1000).selectExpr("1L depth", "id % 3 k1", "0L k2", "id conv")
    got = {x.k1: x.ends_sha256 for x in trie.end_digests(ends, piece=7).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(1000) if i % 3 == k).encode()).hexdigest() for k in range(3)}


def test_louds_round_trip():
    r = np.random.default_rng(4)
    for n in (1, 2, 50, 300):
        parent = np.sort(np.minimum(r.integers(0, n, n), np.arange(n)))
        assert trie.parents(trie.louds(parent)).tolist() == parent.tolist()
        assert [k for lo, hi in trie.level_bounds(parent) for k in range(lo, hi)] == list(range(1, n + 1))
    # a shard of two subtrees of different depth: (1) -> (2, 3), (2) -> (4) and another root at depth 3
    rows = pd.DataFrame([(1, 11, 1, 0, 0, 5), (2, 21, 1, 11, 1, 9), (2, 22, 1, 11, 1, 3), (3, 31, 1, 21, 1, 2), (3, 99, 1, 98, 1, 8)], columns=["depth", "k1", "k2", "p1", "p2", "label"])
    rows = rows.assign(chars=[1, 2, 3, 4, 5], n=[5, 4, 3, 2, 1], low=[0, 1, 2, 3, 4])
    t = trie.Trie(trie.encoded_shard(rows))
    name = [0, *t.arrays["k1"].tolist()]
    assert {name[j]: [name[k] for k in t.children(j)] for j in range(6)} == {0: [11, 99], 11: [22, 21], 21: [31], 22: [], 31: [], 99: []}
    children, leaves, saved = t.rollups()
    assert dict(zip(name[1:], zip(children.tolist(), leaves.tolist(), saved.tolist()))) == {11: (2, 2, 4 + 6 + 6 + 4), 21: (1, 1, 6 + 4), 22: (0, 1, 6), 31: (0, 1, 4), 99: (0, 1, 0)}
