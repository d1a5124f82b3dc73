"""Exact top-k inner products of integer vectors by KD-trees per shard.

Each component x becomes floor(SCALE * x). Rows are dealt to shards by hash; every shard becomes a KD-tree once and is written
as a file: the widest dimension is split at its median down to LEAF rows, and each node keeps its tight bounding box and
smallest vec_id. Tasks load some trees at a time and stream the written groups of queries past them (vectors.scan). A query's
bound for a box is the sum over dimensions of max(q * low, q * high). One heap holds nodes of all trees at hand, best bound
first, and the kth score found so far in any of them prunes the rest; a box whose bound equals it stays only if it may hold
a smaller vec_id.

Defined results: vectors that are null or hold null or non-finite components, and rows with null vec_id, take no part; zero
vectors do. Vectors of different lengths have no inner product, so each length is a search of its own. Equal scores go to the
smaller vec_id. A query is a row: rows that repeat a vec_id each get an answer of their own, and such a twin is a candidate for
the other. Where inner products would not be exact in doubles they are computed with Python integers, and scores are held within
a long. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V

SCALE, LEAF, SHARD, GROUP = 256, 256, 16384, 1024
EXACT = float(1 << 52)


def grown(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """The arrays of a median-split KD-tree over rows x in order of id: the rows by leaf, and for each node low, high, least (id),
    child (two nodes, or -1) and slice (of the rows, for leaves)."""
    low, high, least, child, cut, parts = [], [], [], [], [], []
    at = 0
    waiting = [(np.arange(len(x)), -1, 0)]  # rows, parent, which child of it
    while waiting:
        own, parent, side = waiting.pop()
        node, values = len(low), x[own]
        if parent >= 0:
            child[parent][side] = node
        low.append(values.min(0))
        high.append(values.max(0))
        least.append(ids[own].min())
        child.append([-1, -1])
        cut.append((at, at + len(own)))
        if len(own) <= leaf:
            parts.append(own)
            at += len(own)
        else:
            split = np.argsort(values[:, int(np.argmax(high[-1] - low[-1]))], kind="stable")
            half = len(own) // 2
            waiting += [(np.sort(own[split[half:]]), node, 1), (np.sort(own[split[:half]]), node, 0)]
    order = np.concatenate(parts)
    return {"x": x[order], "ids": ids[order], "rows": rows[order], "low": np.array(low), "high": np.array(high), "least": np.array(least), "child": np.array(child), "slice": np.array(cut)}


def scaled(*arrays: np.ndarray) -> list[np.ndarray]:
    """floor(SCALE * x) of arrays of vectors, as doubles where all inner products are exact in them, else as Python integers."""
    with np.errstate(over="ignore"):
        found = [np.floor(SCALE * a.astype(np.float64)) for a in arrays]
    most = max((float(np.abs(v).max()) for v in found if v.size), default=0.0)
    if arrays[0].shape[1] * most * most < EXACT:
        return found
    whole = lambda c, d: int(c) if np.isfinite(c) else int(d) * SCALE
    return [np.array([[whole(c, d) for c, d in zip(r, s)] for r, s in zip(v, a.astype(np.float64))], object).reshape(v.shape) for v, a in zip(found, arrays)]


def nearest(q: np.ndarray, own: int, trees: list[dict], bounds: list[np.ndarray], k: int, depth: list | None = None) -> list[tuple]:
    """The k best (score, -id, -row) of a query's row over all trees, best first; bounds: its bound for every node of every tree."""
    heap = [(-b[0], t, 0) for t, b in enumerate(bounds)]
    heapq.heapify(heap)
    top: list[tuple] = []  # a heap, worst first
    while heap:
        bound, t, node = heapq.heappop(heap)
        tree = trees[t]
        if len(top) == k:
            if -bound < top[0][0]:
                break
            if -bound == top[0][0] and tree["least"][node] > -top[0][1]:
                continue
        if tree["child"][node][0] >= 0:
            for c in tree["child"][node]:
                if len(top) < k or bounds[t][c] >= top[0][0]:
                    heapq.heappush(heap, (-bounds[t][c], t, int(c)))
            continue
        a, z = tree["slice"][node]
        s, ids, rows = tree["v"][a:z] @ q, tree["ids"][a:z], tree["rows"][a:z]
        if depth is not None:
            depth.append(z - a)
        good = np.flatnonzero(s >= top[0][0]) if len(top) == k else np.arange(z - a)
        for i in good[np.lexsort((rows[good], ids[good], -s[good].astype(np.float64)))] if len(good) > 1 else good:
            entry = (s[i], -int(ids[i]), -int(rows[i]))
            if entry[2] == -own:
                continue
            if len(top) < k:
                heapq.heappush(top, entry)
            elif entry > top[0]:
                heapq.heapreplace(top, entry)
            elif s[i] < top[0][0] and s.dtype != object:
                break
    return sorted(top, reverse=True)


def answers(q: dict, trees: list[dict], k: int) -> tuple[np.ndarray, ...]:
    """Columns query_row, query_id, row, vec_id, score."""
    asked, *parts = scaled(q["x"], *(t[name] for t in trees for name in ("x", "low", "high")))
    trees = [t | {"v": v} for t, v in zip(trees, parts[::3])]
    above, below = np.maximum(asked, 0), np.minimum(asked, 0)
    bounds = [above @ high.T + below @ low.T for low, high in zip(parts[1::3], parts[2::3])]
    found: tuple[list, list, list, list, list] = ([], [], [], [], [])
    for i, (own, query) in enumerate(zip(q["rows"].tolist(), q["ids"].tolist())):
        for score, vec_id, row in nearest(asked[i], own, trees, [b[i] for b in bounds], k):
            for column, value in zip(found, (own, query, -row, -vec_id, max(1 - 2**63, min(2**63 - 1, int(score))))):
                column.append(value)
    return tuple(np.array(c, np.int64) for c in found)


def search(vectors: DataFrame, chosen=None, k: int = 5, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row for which the condition chosen (on vec_id) holds, against all other rows."""
    rows = V.rows(vectors, zero=True)
    index = V.shards(rows, shard, grown)
    asked = V.deal(rows.where(F.col("vec_id") % 50 == 0 if chosen is None else chosen), group)
    return V.top_k(V.scan(index, asked, lambda q, trees: answers(q, trees, k), k, "long"), k)
