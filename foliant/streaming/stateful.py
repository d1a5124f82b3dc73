"""Streams: a write queue that coalesces by path, deduplicated runs, caches with time to live, running layouts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scratch import written
from ..operators.dedupe import first_by

#: Recency blocks of the cache table.
BLOCKS = 256


def latest_per_path(ops: DataFrame) -> DataFrame:
    """The last operation of each path."""
    return first_by(ops, ["path"], [F.desc("enqueued_at"), F.desc("seq")])


def with_retry(work: Callable[[], None], tries: int = 3, pause: float = 1.0, sleep=time.sleep) -> int:
    """Run work, waiting pause * 2**n after the nth failure; the last failure is raised, so the batch is replayed from its checkpoint."""
    for n in range(tries + 1):
        try:
            work()
            return n
        except Exception:
            if n == tries:
                raise
            sleep(pause * 2**n)
    return tries


def write_queue(ops: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds", **trigger) -> StreamingQuery:
    """Micro-batches of operations, coalesced by path, to an idempotent sink(batch, epoch)."""
    run = lambda batch, epoch: with_retry(lambda: sink(latest_per_path(batch), epoch))
    return ops.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": every})).start()


def debounced(ops: DataFrame, late: str = "10 seconds", quiet: str = "2 seconds") -> DataFrame:
    """Bursts of operations per path, closed by a quiet time: last data, count."""
    return ops.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet).alias("burst")).agg(F.max_by("data", "ts").alias("data"), F.count("*").alias("n"))


def run_once(runs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each run key (name, size, modification time) once within the watermark."""
    keyed = runs.withColumn("run_key", F.concat_ws("::", "name", F.col("size").cast("string"), F.col("mtime").cast("string")))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_key"])


def cached_reads(ops: DataFrame, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """path, seq, data, hit of every get in a stream of puts (path, seq, data) and gets (data null); a value lives ttl_ms after its last use."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else None
        found = []
        for row in pd.concat(batches).sort_values("seq").itertuples():
            if row.data is not None and row.data == row.data:
                held = row.data
            else:
                found.append((key[0], row.seq, held, held is not None))
        if held is not None:
            state.update((held,))
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(found, columns=["path", "seq", "data", "hit"])

    return ops.groupBy("path").applyInPandasWithState(step, "path string, seq long, data string, hit boolean", "data string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def lru_within(entries: DataFrame, budget: int) -> DataFrame:
    """Cache entries that fit the budget, most recently used first (batch form of eviction); sums by recency block, then inside it."""
    from pyspark.sql import Window

    dealt = entries.repartitionByRange(BLOCKS, F.desc("accessed_at"), F.col("path")).withColumn("__block", F.spark_partition_id())
    dealt = written(dealt, "recency")  # the blocks' borders are sampled, so they are drawn once
    sums = dealt.groupBy("__block").agg(F.sum("size").alias("__sum"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__block").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")).where(F.col("__before") <= budget)
    inner = Window.partitionBy("__block").orderBy(F.desc("accessed_at"), "path").rowsBetween(Window.unboundedPreceding, 0)
    held = dealt.join(sums, F.col("__block") == F.col("__b")).withColumn("held", F.col("__before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return held.where(F.col("held") <= budget).select(*entries.columns, "held")


def live_layouts(events: DataFrame) -> DataFrame:
    """key, seq, layout of a stream of (key, seq, slots): letter and number scores by position, and the layout after each event."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        letter, number = (list(map(int, x)) for x in state.get) if state.exists else ([], [])
        found = []
        for row in pd.concat(batches).sort_values("seq").itertuples():
            more = len(row.slots) - len(letter)
            letter, number = letter + [0] * more, number + [0] * more
            layout = ""
            for pos, c in enumerate(row.slots):
                if c.isascii() and c.isalnum() and c not in "0157OIlST":
                    letter[pos] += 5 * c.isalpha()
                    number[pos] += 5 * c.isdigit()
                lead = letter[pos] + number[pos] >= 20 and abs(letter[pos] - number[pos]) >= 15
                layout += ("L" if letter[pos] > number[pos] else "N") if lead else "?"
            found.append((key[0], row.seq, layout))
        state.update((letter, number))
        yield pd.DataFrame(found, columns=["key", "seq", "layout"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, seq long, layout string", "letter array<int>, number array<int>", "append", GroupStateTimeout.NoTimeout)


def counters(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
