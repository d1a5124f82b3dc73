import json
import os
import time

import pytest
from pyspark.sql import functions as F

from foliant.sources import readers, writers
from foliant.streaming import stateful


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "hi"', None), ("", "x", "y")], "p string, q string, r string")
    assert [r.line for r in writers.csv_rows(df, ["p", "q", "r"]).collect()] == ['"a,b","say ""hi""",', ",x,y"]
    writers.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.csv_table(spark, str(tmp_path / "c")).na.fill("").collect())) == [("", "x", "y"), ("a,b", 'say "hi"', "")]


def test_json_lines_keep_errors(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 3}\n')
    got = readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").orderBy("line_no").collect()
    assert [(r.line_no, r.a, r.error) for r in got] == [(1, 1, None), (3, None, "{bad"), (4, 3, None)]
    folder = tmp_path / "many"
    folder.mkdir()
    for name, n in (("a", 900), ("b", 7)):
        (folder / name).write_text("".join(f'{{"a": {i}}}\n' for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = readers.json_lines(spark, str(folder), "a int").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 907 and all(r.a == r.line_no for r in got)


def test_chunks(spark):
    df = spark.createDataFrame([("k", "x" * 25), ("s", "short")], "key string, value string")
    c = readers.chunks(df, "key", "value", 10, 20)
    assert c.count() == 4 and dict(map(tuple, readers.reassembled(c, "key").collect())) == {"k": "x" * 25, "s": "short"}
    with pytest.raises(Exception, match="missing chunk"):
        readers.reassembled(c.where("i <> 1"), "key").collect()


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "store")
    row = lambda *r: spark.createDataFrame([r], "uid string, wizard_id string, v string, version int")
    writers.upsert(spark, path, row("u", "w", "a", 1).unionByName(row("z", "w", "q", 1)), ["uid", "wizard_id"])
    writers.upsert(spark, path, row("u", "w", "b", 2), ["uid", "wizard_id"])
    assert {(r.uid, r.v) for r in spark.read.parquet(path).collect()} == {("u", "b"), ("z", "q")}
    assert readers.store(spark, path, "u", "w").first().v == "b"


def run(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def source(spark, tmp_path, schema, *batches):
    d = tmp_path / "in"
    d.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        (d / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(d / f"{i}.json", (1_700_000_000 + i,) * 2)  # files are read in order of time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))


def test_write_queue_coalesces(spark, tmp_path):
    ops = source(spark, tmp_path, "path string, data string, enqueued_at long, seq long", [{"path": "p", "data": str(i), "enqueued_at": i, "seq": i} for i in range(3)] + [{"path": "q", "data": "z", "enqueued_at": 0, "seq": 9}])
    seen, fails = [], [1]

    def sink(batch, epoch):
        if fails:
            fails.pop()
            raise OSError("first try")
        seen.extend(map(tuple, batch.select("path", "data").orderBy("path").collect()))

    stateful.with_retry.__defaults__ = (3, 0.0, stateful.time.sleep)
    run(stateful.write_queue(ops, sink, str(tmp_path / "cp"), availableNow=True))
    assert seen == [("p", "2"), ("q", "z")]


def test_retry_gives_up():
    waits = []
    with pytest.raises(ValueError):
        stateful.with_retry(lambda: int("x"), 3, 1.0, waits.append)
    assert waits == [1.0, 2.0, 4.0]


def test_live_layouts(spark, tmp_path):
    ev = source(spark, tmp_path, "key string, seq long, slots string", [{"key": "k", "seq": i, "slots": "A2"} for i in range(4)], [{"key": "k", "seq": 4, "slots": "A2"}])
    q = stateful.live_layouts(ev).writeStream.format("memory").queryName("layouts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    run(q)
    assert [r.layout for r in spark.table("layouts").orderBy("seq").collect()] == ["??", "??", "??", "LN", "LN"]


def test_ttl_cache(spark, tmp_path):
    ops = source(spark, tmp_path, "path string, seq long, data string", [{"path": "a", "seq": 0, "data": "v"}, {"path": "a", "seq": 1}, {"path": "b", "seq": 2}])
    q = stateful.cached_reads(ops).writeStream.format("memory").queryName("cache").outputMode("append").option("checkpointLocation", str(tmp_path / "cp3")).start()
    for _ in range(80):  # with a timeout set, batches never end by themselves
        if spark.table("cache").count() == 2:
            break
        time.sleep(0.5)
    q.stop()
    assert {(r.path, r.data, r.hit) for r in spark.table("cache").collect()} == {("a", "v", True), ("b", None, False)}


def test_run_once(spark, tmp_path):
    s = source(spark, tmp_path, "name string, size long, mtime long, ts timestamp", [{"name": "f", "size": 1, "mtime": 2, "ts": "2024-01-01T00:00:00Z"}] * 2, [{"name": "f", "size": 1, "mtime": 2, "ts": "2024-01-01T00:01:00Z"}])
    q = stateful.run_once(s).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "cp4")).start()
    run(q)
    assert spark.table("once").count() == 1


def test_lru(spark):
    e = spark.createDataFrame([("a", 5, 3), ("b", 5, 2), ("c", 5, 1)], "path string, size int, accessed_at int")
    assert {r.path for r in stateful.lru_within(e, 10).collect()} == {"a", "b"}
    assert writers.report(e.orderBy("path"), "Cache", "%s=%d", ["path", "size"]) == "Cache\na=5\nb=5\nc=5"
    assert F.col("a") is not None


def test_lru_holds_every_entry_that_fits(spark):
    e = spark.range(120_000).select(F.format_string("p%06d", "id").alias("path"), (F.col("id") % 3 + 1).cast("int").alias("size"), (-F.col("id") / 7).cast("int").alias("accessed_at"))
    got = stateful.lru_within(e, 230_000)
    assert got.count() == 115_000 and got.agg(F.max("path"), F.max("held")).first() == ("p114999", 229_999)
