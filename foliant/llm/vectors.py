"""Vectors in shards that are indexed once: array files in the shared folder, searched where they are read.

rows() writes the vectors that take part, each with a row number of its own, as vec_id may repeat. shards() deals them by hash
to groups of bounded size, gives each group to build() once and saves the arrays it returns; deal() does the same with the
queries. scan() runs over the written shards: a task loads a few of them at a time and streams the files of queries of the
same length past them, so that no candidate is moved again for any query, however many there are. Files are named in
written manifests; those of lost or repeated tasks are never read. The driver holds the names of the files of queries only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load_arrays, materialize, save_arrays, scratch

#: Bytes of vectors in a shard and of shards that a task holds at once; groups of queries whose best it keeps.
SHARD_BYTES, HELD_BYTES, QUERIES = 8 << 20, 48 << 20, 64
FOUND = "query_row long, query_id long, row long, vec_id long, score "


def rows(vectors: DataFrame, zero: bool = False) -> DataFrame:
    """row, vec_id, dim, v of the rows that take part (zero: zero vectors do too); floats stay floats, other numbers become doubles."""
    kind = dict(vectors.dtypes)["embedding"]
    v = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(v) > 0)
    if not zero:
        fine = fine & F.exists(v, lambda x: x != 0)
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    found = found.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    return materialize(found.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), "v"), "vectors")


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as an array."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _saved(found: DataFrame, most: int, least: int, name: str, build: Callable[..., dict]) -> DataFrame:
    """dim, file, n of the groups of rows that build made arrays of. least: so many groups if they have 1,024 rows each."""
    folder = scratch(found.sparkSession, name)
    fits = F.least(F.lit(most), F.greatest(F.lit(64), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("of")))))
    counts = found.groupBy(F.col("dim").alias("of")).agg(F.count("*").alias("rows"))
    counts = counts.select("of", F.greatest(F.ceil(F.col("rows") / fits), F.least(F.lit(least), F.floor(F.col("rows") / 1024)), F.lit(1)).cast("long").alias("groups"))
    dealt = found.join(counts, F.col("dim") == F.col("of")).withColumn("group", F.pmod(F.xxhash64("row"), F.col("groups")))

    def run(key, t):
        x, ids, own = matrix(t.column("v")), t.column("vec_id").to_numpy(), t.column("row").to_numpy()
        order = np.lexsort((own, ids))
        path = save_arrays(folder, **build(x[order], ids[order], own[order]))
        return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "file": [path], "n": pa.array([len(x)], pa.int64())})

    return materialize(dealt.groupBy("dim", "group").applyInArrow(run, "dim int, file string, n long"), f"{name}-manifest")


def shards(found: DataFrame, most: int, build: Callable[..., dict]) -> DataFrame:
    """The manifest of all rows in shards of at most about `most`; build gets vectors, ids and row numbers in order of id."""
    return _saved(found, most, 4 * found.sparkSession.sparkContext.defaultParallelism, "shard", build)


def deal(found: DataFrame, most: int) -> DataFrame:
    """The manifest of queries in groups of at most about `most`."""
    return _saved(found, most, 1, "queries", lambda x, ids, own: {"x": x, "ids": ids, "rows": own})


def scan(index: DataFrame, asked: DataFrame, answer: Callable[[dict, list[dict]], tuple], k: int, score: str) -> DataFrame:
    """FOUND of the queries' k best in the shards of each task; answer(queries, shards) gives its columns.

    There are as many tasks as the cluster has cores, so what they hand on grows with the queries only. A task keeps the best so
    far of QUERIES groups of queries while it loads its shards one lot after the other."""
    files: dict[int, list[str]] = {}
    for r in asked.select("dim", "file").collect():
        files.setdefault(r[0], []).append(r[1])
    kinds = [pa.int64()] * 4 + [pa.float64() if score == "double" else pa.int64()]

    def lots(paths: list[str]):
        held, size = [], 0
        for path in paths:
            held.append(load_arrays(path))
            size += sum(a.nbytes for a in held[-1].values())
            if size > HELD_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        own: dict[int, list[str]] = {}
        for b in batches:
            for dim, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own.setdefault(dim, []).append(path)
        for dim, paths in own.items():
            for at in range(0, len(files.get(dim, [])), QUERIES):
                groups = files[dim][at : at + QUERIES]
                best: dict[str, tuple] = {}
                for held in lots(paths):
                    for g in groups:
                        found = answer(load_arrays(g), held)
                        best[g] = best_of([best[g], found] if g in best else [found], k)
                for found in best.values():
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(found, kinds)], names=["query_row", "query_id", "row", "vec_id", "score"])

    tasks = max(1, min(index.count(), index.sparkSession.sparkContext.defaultParallelism))
    return index.select("dim", "file").repartition(tasks).mapInArrow(run, FOUND + score)


def best_of(found: list[tuple], k: int) -> tuple:
    """Of the columns query_row, query_id, row, vec_id, score of several shards the k best rows a query."""
    q, qid, own, ids, s = (np.concatenate([np.asarray(part) for part in c]) for c in zip(*found))
    order = np.lexsort((own, ids, -s, q))
    q = q[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    order = order[place < k]
    return q[place < k], qid[order], own[order], ids[order], s[order]


def top_k(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query's row, ties to the smaller vec_id."""
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
