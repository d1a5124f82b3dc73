"""Approximate nearest neighbours for the largest inner product: anisotropic product quantisation, four-bit scans, exact reranking.

Codebooks of 16 centres per pair of dimensions are fitted on a bounded sample (about SAMPLE rows, by hash of the row) under the
score-aware loss |r|^2 + (eta - 1) (r.x)^2 / |x|^2, which weighs the residual r parallel to x more: codes are assigned by
coordinate descent, centres by weighted least squares. Every row is coded once, to half a byte per pair of dimensions, in the
shard that the hash of its row gives; a shard is a written file. Equal vectors of a shard share one code and keep all their ids.

Tasks load shards and stream the written groups of queries past them (vectors.scan). A query's sixteen-entry tables, rounded
to integers and joined by two to 256 entries, are scanned over the packed codes; the best DEPTH distinct vectors of the shard
are scored exactly in double precision on the original vectors, and the best k of all shards remain.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with null vec_id, take no
part; vectors of different lengths have no inner product, so each length is a search of its own; equal scores go to the
smaller vec_id, equal codes are kept in that order too. A query is a row: rows that repeat a vec_id each get an answer of
their own, and such a twin is a candidate for the other. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import hash_sample

SAMPLE, CENTRES, ROUNDS, ETA, DEPTH, SHARD, GROUP = 8192, 16, 6, 4.0, 256, 16384, 2048

SAMPLE_BYTES = 32 << 20


def assign(x: np.ndarray, centres: np.ndarray, eta: float = ETA, sweeps: int = 2) -> np.ndarray:
    """Codes [n, m] of x [n, 2 m] by coordinate descent on the anisotropic loss; centres: [m, CENTRES, 2]."""
    m, n = len(centres), len(x)
    parts = x.reshape(n, m, 2).transpose(1, 0, 2)
    error = ((parts[:, :, None] - centres[:, None]) ** 2).sum(-1)  # [m, n, centres]
    dots = (parts[:, :, None] * centres[:, None]).sum(-1)
    codes = error.argmin(-1)
    norm = np.maximum((x * x).sum(1), 1e-30)
    row = np.arange(n)
    rest = norm - sum(dots[j, row, codes[j]] for j in range(m))  # r.x, the parallel residual times |x|
    for _ in range(sweeps):
        for j in range(m):
            other = rest + dots[j, row, codes[j]]
            loss = error[j] + (eta - 1) * (other[:, None] - dots[j]) ** 2 / norm[:, None]
            codes[j] = loss.argmin(-1)
            rest = other - dots[j, row, codes[j]]
    return codes.T.astype(np.uint8)


def fit(x: np.ndarray, rounds: int = ROUNDS, eta: float = ETA) -> np.ndarray:
    """Centres [m, CENTRES, 2] for rows x [n, 2 m]."""
    n, d = x.shape
    m = d // 2
    parts = x.reshape(n, m, 2)
    pick = np.random.default_rng(0).choice(n, CENTRES, replace=n < CENTRES)
    centres = parts[pick].transpose(1, 0, 2).copy()
    norm = np.maximum((x * x).sum(1), 1e-30)
    for turn in range(rounds):
        codes = assign(x, centres, eta if turn >= rounds // 2 else 1.0, 1)
        weight = (eta - 1) / norm if turn >= rounds // 2 else np.zeros(n)
        coded = np.stack([centres[j, codes[:, j]] for j in range(m)], 1)
        rest = norm - (coded * parts).sum((1, 2))
        for j in range(m):
            p, c = parts[:, j], codes[:, j]
            other = rest + (coded[:, j] * p).sum(1)
            a = np.zeros((CENTRES, 2, 2))
            b = np.zeros((CENTRES, 2))
            for r in range(2):
                b[:, r] = np.bincount(c, p[:, r] * (1 + weight * other), CENTRES)
                for s in range(2):
                    a[:, r, s] = np.bincount(c, weight * p[:, r] * p[:, s] + (r == s), CENTRES)
            used = np.bincount(c, minlength=CENTRES) > 0
            centres[j, used] = np.linalg.solve(a[used], b[used][..., None])[..., 0]
            coded[:, j] = centres[j, c]
            rest = other - (coded[:, j] * p).sum(1)
    return centres


def packed(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Four-bit codes, two to a byte, one row per pair of code books: [ceil(m / 2), n]."""
    codes = np.concatenate([assign(x[at : at + 2048], centres) for at in range(0, len(x), 2048)]).T
    if len(codes) % 2:
        codes = np.concatenate([codes, np.zeros_like(codes[:1])])
    return np.ascontiguousarray(codes[::2] | codes[1::2] << 4)


def tables(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[ceil(m / 2), 256] integer scores of all bytes for a query; all books share one step, so that sums compare."""
    t = (centres * q.reshape(-1, 1, 2)).sum(-1)
    t = t - t.min(1, keepdims=True)
    t = np.rint(t * (255 / max(t.max(), 1e-30))).astype(np.int32)
    if len(t) % 2:
        t = np.concatenate([t, np.zeros_like(t[:1])])
    return (t[::2, None, :] + t[1::2, :, None]).reshape(len(t) // 2, 256)


def shard_of(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, centres: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a shard: distinct vectors x in order of their smallest id, their codes, and the ids and rows of each from start[i] to start[i + 1]."""
    _, first, own = np.unique(x, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")  # ids ascend, so the first row has the smallest
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    own = place[own.reshape(-1)]
    by = np.argsort(own, kind="stable")
    distinct = x[first[order]]
    return {"x": distinct, "codes": packed(padded(distinct), centres), "ids": ids[by], "rows": rows[by], "start": np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(order)))])}


def padded(x: np.ndarray) -> np.ndarray:
    """x as doubles with an even number of dimensions."""
    return np.pad(x.astype(np.float64), ((0, 0), (0, x.shape[1] % 2)))


def best(q: np.ndarray, q_rows: np.ndarray, shard: dict, centres: np.ndarray, k: int, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """(query's place, row, id, exact score) of each query's best k in a shard, by scan and reranking."""
    codes, start, n = shard["codes"], shard["start"], len(shard["x"])
    columns = np.ascontiguousarray(shard["x"].T.astype(np.float64))
    late = np.arange(n - 1, -1, -1)
    wide = padded(q)
    total, step = np.empty(n, np.int64), np.empty(n, np.int32)
    out = []
    for i in range(len(q)):
        if n > depth:
            t = tables(wide[i], centres)
            step[:] = t[0][codes[0]]
            for j in range(1, len(codes)):
                step += t[j].take(codes[j])
            np.multiply(step, n, out=total, dtype=np.int64)
            total += late  # equal sums in order of id
            pick = np.argpartition(total, n - depth)[n - depth :]
        else:
            pick = np.arange(n)
        exact = np.zeros(len(pick))
        for d in range(q.shape[1]):
            exact += columns[d][pick] * float(q[i, d])
        some = np.lexsort((pick, -exact))[: k + 1]  # one of them may be the query itself
        copies = np.minimum(start[pick[some] + 1] - start[pick[some]], k + 1)
        at = np.repeat(start[pick[some]] - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
        score = np.repeat(exact[some], copies)
        fine = shard["rows"][at] != q_rows[i]
        at, score = at[fine], score[fine]
        top = np.lexsort((shard["rows"][at], shard["ids"][at], -score))[:k]
        out.append((np.full(len(top), i), shard["rows"][at[top]], shard["ids"][at[top]], score[top]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (none, none, none, np.zeros(0))


def books_of(rows: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """The codebooks of each length of vectors, fitted one after the other on at most about `sample` rows and SAMPLE_BYTES."""
    books = {}
    for dim, n in sorted((r[0], r[1]) for r in rows.groupBy("dim").count().collect()):
        some = min(sample, max(CENTRES, SAMPLE_BYTES // (8 * dim)))
        drawn = hash_sample(rows.where(F.col("dim") == dim), some, n, "row").select("row", "v").toArrow().sort_by("row").column("v")
        books[dim] = fit(padded(V.matrix(drawn)) if len(drawn) else np.zeros((1, dim + dim % 2)))
    return books


def search(vectors: DataFrame, chosen=None, k: int = 20, sample: int = SAMPLE, shard: int = SHARD, group: int = GROUP, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which the condition chosen (on vec_id) holds."""
    rows = V.rows(vectors)
    books = books_of(rows, sample)
    index = V.shards(rows, shard, lambda x, ids, own: shard_of(x, ids, own, books[x.shape[1]]))
    asked = V.deal(rows.where(F.col("vec_id") % 20 == 0 if chosen is None else chosen), group)

    def answer(q: dict, shards: list[dict]) -> tuple:
        found = []
        for s in shards:
            i, row, vec_id, score = best(q["x"], q["rows"], s, books[q["x"].shape[1]], k, depth)
            found.append((q["rows"][i], q["ids"][i], row, vec_id, score))
        return V.best_of(found, k)

    return V.top_k(V.scan(index, asked, answer, k, "double"), k)
