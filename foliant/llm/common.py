"""Shared pieces: scratch tables in the cluster's shared folder and file access for executors."""

from __future__ import annotations

import atexit
import ctypes
import io
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_KEPT: dict[Hashable, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset on a local master (tests) one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="foliant-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back; lost executors then cost no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables; call it only when all that is computed from them has been written."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    found = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        found.append(n)
    return found


def hash_sample(df: DataFrame, n: int, total: int, *keys) -> DataFrame:
    """About n of total rows by a hash of keys, all if there are no more. It is a filter: no task gathers the sample, as limit() would."""
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(77)), F.lit(1 << 30)) < F.lit(int((1 << 30) * n / total)))


def give_back() -> None:
    """Return free memory to the system. glibc by itself keeps every gap below its last block in use, such as that of an Arrow batch's body."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def kept(key: Hashable, make: Callable[[], object]):
    """make(), remembered by the process until another key is asked for: a worker serves many stages, and holds what one of them needs."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def portions(batches, rows: int = 1000, size: int = 4 << 20):
    """Arrow batches cut into slices of at most `rows` rows and about `size` bytes, so that the Python objects made of them stay few.
    Spark itself bounds the batches by spark.sql.execution.arrow.maxBytesPerBatch. The last slice is a copy, so that who still holds
    it does not hold its batch; free memory goes back after every slice and at the end, when the last batch is gone."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            if 0 < at >= b.num_rows - step:
                part, b = pc.take(part, pa.array(range(part.num_rows)), memory_pool=pa.system_memory_pool()), None
            yield part
            part = None
            give_back()
            if b is None:
                break
        b = None
    give_back()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI; executors reach the shared folder by it."""
    from pyarrow import fs

    if "://" not in uri:
        if uri.startswith("file:"):
            uri = uri[5:]
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def save_arrays(folder: str, **arrays) -> str:
    """Write numpy arrays to a new file in a shared folder; its path. A task that is repeated writes another file."""
    import numpy as np

    path, data = f"{folder}/{uuid.uuid4().hex}.npz", io.BytesIO()
    np.savez(data, **arrays)
    fs, inner = filesystem(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner, compression=None) as out:
        out.write(data.getbuffer())
    return path


def load_arrays(path: str) -> dict:
    """The arrays of save_arrays()."""
    import numpy as np

    fs, inner = filesystem(path)
    with fs.open_input_stream(inner, compression=None) as f:
        with np.load(io.BytesIO(f.read()), allow_pickle=False) as found:
            return {k: found[k] for k in found.files}
