import gzip
import hashlib
import random

from foliant.llm import warc
from foliant.llm.common import filesystem, scratch

PAGES = "page_id long, url string, html string, digest string, head int, file string"


def test_loser_tree_merges():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 64):
        runs = [sorted(str(r.randrange(50)) for _ in range(r.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_merge_beyond_fan(tmp_path):
    slices = []
    for i in range(9):
        data = "".join(f"k{j:03d} {i}\n" for j in range(i, 40, 3)).encode()
        (tmp_path / f"r{i}").write_bytes(b"skip\n" + data)
        slices.append((str(tmp_path / f"r{i}"), 5, len(data)))
    got = list(warc.merged(slices, str(tmp_path), fan=3))
    assert got == sorted(got) and len(got) == sum(len(range(i, 40, 3)) for i in range(9))


def test_round_trip(spark):
    big, other = "é" * 600, "<p>" + "x" * 2000
    rows = [(1, "http://www.Example.com:80/b#f", big), (2, "https://example.com/a?q=1", big), (3, None, big), (4, "http://a.b/", "short"), (5, "http://a.b/", "short"), (6, "x y\nz", None), (7, "http://c", other), (None, "http://d", other), (8, "http://example.com/b", other), (8, "http://example.com/b", other), (9, "http://e", "y" * 1000)]
    df = spark.createDataFrame([(*r, "d", 1, "f") for r in rows], PAGES)
    got = warc.round_trip(df).collect()
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        same = [q for q, _, g in rows if (g or "").encode() == data and q is not None]
        to = max(same) if len(data) >= 1000 and sum((g or "").encode() == data for _, _, g in rows) > 1 and p != max(same) else None
        want.append((p or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to))
    assert sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_index_is_ordered(spark):
    rows = [(i, f"http://h{i % 7}.com/{i % 3}", "z" * i, "", 0, "") for i in range(200)]
    index = warc.archive(spark.createDataFrame(rows, PAGES), scratch(spark, "test"))
    got = [(r.url_key, r.time, r.page_id) for r in index.orderBy("range", "place").collect()]
    assert got == sorted(got) and len(got) == 200
    entry = index.first()
    fs, path = filesystem(entry.file)
    with fs.open_input_file(path) as f:
        assert gzip.decompress(f.read_at(entry.length, entry.offset)).startswith(b"WARC/1.1\r\n")


def test_url_keys(spark):
    df = spark.createDataFrame([("HTTP://User@www2.Ex.org:8080/A b?c#d",), ("",), (None,), ("ex.org",)], "u string")
    got = [r[0] for r in df.select(warc.url_key(df.u)).collect()]
    assert got == ["org,ex)/ab?c", "-", "-", "org,ex)/"]
