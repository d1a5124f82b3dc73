"""WARC archives with revisit records and an external merge of their capture index.

Every task writes one gzip-per-record WARC file of its own name and, for every RUN captures, a run: index lines sorted by
URL key, timestamp and page_id. Ranges of that key, of about PER_RANGE captures, are cut at quantiles of a sample of PER_CUT
keys a range, and the manifest says where each range lies in each run. One task per range merges its slices of all runs with
a loser tree, FAN at a time (more slices go through intermediate files), and hands on its lines in batches; this gives the
globally ordered capture histories. Records are read back by
their index entries, dealt by file and read in order of offset. Files that the written manifest does not name (of lost or
repeated tasks) are never read.

Pages carry no time, so the capture time is 2020-01-01 plus page_id seconds (modulo 2**31).

Defined results: a null html is an empty payload; a null url has the key "-"; of records with equal payloads of at least
LEAST bytes the one with the largest page_id is the response and the rest are revisits, so rows that repeat that page_id
are responses too, and with page_ids all null every row is a response; an empty table gives an empty result. Only
page_id, url and html are read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, hash_sample, materialize, portions, scratch

LEAST, RUN, FAN, PER_CUT, PER_RANGE, PER_TASK, CHUNK, LEVEL, LINES = 1000, 1 << 17, 128, 16, 1 << 18, 1 << 14, 1 << 16, 1, 1 << 13
INDEX = "page_id long, url_key string, time string, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Sortable key: the host's labels from last to first, without www, port, scheme and fragment, then path and query."""
    clean = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"#.*$|[\x00-\x20]", "")
    rest = F.regexp_replace(clean, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^([^@]*@)|:\d+$", "")
    host = F.regexp_replace(host, r"^www\d*\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.when(clean == "", "-").otherwise(key)


def capture_time(page_id: Column) -> Column:
    seconds = F.lit(1577836800) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(2**31))
    return F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss")


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, url_key, time, digest, bytes, refers_to, html of every page, the html of revisits null."""
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    many = rows.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
    many = materialize(many.where("n > 1 and head is not null").select(F.col("digest").alias("same"), "head"), "warc-heads")
    rows = rows.join(many, F.col("digest") == F.col("same"), "left")
    refers = F.when(F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    return rows.select("page_id", "url", url_key(F.col("url")).alias("url_key"), capture_time(F.col("page_id")).alias("time"), "digest", "bytes", refers.alias("refers_to"), F.when(refers.isNull(), F.col("html")).alias("html"))


def line_key(key: str, time: str, page_id: int | None) -> str:
    return f"{key} {time} {(page_id if page_id is not None else -(2**63)) + 2**63:020d}"


def record(row: dict) -> bytes:
    """One WARC record, compressed as a gzip member."""
    time = row["time"]
    stamp = f"{time[:4]}-{time[4:6]}-{time[6:8]}T{time[8:10]}:{time[10:12]}:{time[12:14]}Z"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    block = http + (row["html"] or b"")
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"]) if row["url"] is not None else None
    head = ["WARC/1.1", f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:x-page:{row['page_id']}>" if row["page_id"] is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    head += [f"WARC-Date: {stamp}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()]
    if row["refers_to"] is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{row['refers_to']}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a compressed record."""
    head, _, rest = zlib.decompress(member, wbits=31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page = lambda s: int(s[12:-1]) if s and s.startswith("<urn:x-page:") else None
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(next(x.split(b": ", 1)[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return {"page_id": page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To"))}


class LoserTree:
    """k-way merge: leaf i is the next line of run i, an inner node holds the loser of its match, node 0 the winner."""

    def __init__(self, runs: list[Iterator[str]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.node = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at > 0:
            held = self.node[at]
            if held < 0:  # while the tree is built, the first to arrive waits for its opponent
                self.node[at] = winner
                return
            if self._beats(held, winner):
                self.node[at], winner = winner, held
            at //= 2
        self.node[0] = winner

    def __iter__(self) -> Iterator[str]:
        while (line := self.heads[w := self.node[0]]) is not None:
            yield line
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def slice_lines(path: str, offset: int, length: int) -> Iterator[str]:
    """The lines of a slice of a run, CHUNK bytes at a time."""
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as f:
        rest, at, end = b"", offset, offset + length
        while at < end:
            data = f.read_at(min(CHUNK, end - at), at)
            at += len(data)
            *lines, rest = (rest + data).split(b"\n")
            yield from (x.decode() for x in lines)


def merged(slices: list[tuple[str, int, int]], folder: str, fan: int = FAN) -> Iterator[str]:
    """All lines of the slices in order; at most fan runs are open at once."""
    while len(slices) > fan:
        group, slices = slices[:fan], slices[fan:]
        path, size = f"{folder}/merge-{uuid.uuid4().hex}", 0
        fs, inner = filesystem(path)
        with fs.open_output_stream(inner, compression=None) as out:
            for line in LoserTree([slice_lines(*s) for s in group]):
                data = line.encode() + b"\n"
                out.write(data)
                size += len(data)
        slices.append((path, 0, size))
    return iter(LoserTree([slice_lines(*s) for s in slices]))


def write(rows: DataFrame, path: str, bounds: list[str]) -> DataFrame:
    """Write WARC files and index runs of captures(); the written manifest: range, run, offset, length of every slice."""

    def run(batches):
        fs = out = None
        at, lines = 0, []
        warc = f"{path}/{uuid.uuid4().hex}.warc.gz"

        def flush():
            nonlocal lines
            lines.sort()
            name = f"{path}/{uuid.uuid4().hex}.cdxj"
            fs, inner = filesystem(name)
            cuts = [0, *(bisect.bisect_left(lines, b) for b in bounds), len(lines)]
            found, offset = [], 0
            with fs.open_output_stream(inner, compression=None) as f:
                for r, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    if a < z:
                        data = ("\n".join(lines[a:z]) + "\n").encode()
                        f.write(data)
                        found.append((r, name, offset, len(data)))
                        offset += len(data)
            lines = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["range", "run", "offset", "length"])

        for b in portions(batches):
            for row in b.to_pylist():
                if out is None:
                    fs, inner = filesystem(warc)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(inner, compression=None)
                data = record(row)
                out.write(data)
                lines.append(f"{line_key(row['url_key'], row['time'], row['page_id'])} {json.dumps([row['page_id'], warc, at, len(data)])}")
                at += len(data)
                if len(lines) >= RUN:
                    yield flush()
        if lines:
            yield flush()
        if out is not None:
            out.close()

    return materialize(rows.mapInArrow(run, "range int, run string, offset long, length long"), "warc-manifest")


def merge(manifest: DataFrame, folder: str, ranges: int) -> DataFrame:
    """The index in order of URL key, time and page_id within and across ranges: range, place and the INDEX columns."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = ["range", "place", *(x.split()[0] for x in INDEX.split(", "))]

    def run(batches):
        slices = ((r, s) for b in batches for r, *s in zip(*(c.to_pylist() for c in b.columns)))
        for r, own in itertools.groupby(slices, key=lambda x: x[0]):
            lines = merged([tuple(s) for _, s in own], folder)
            place = 0
            while some := list(itertools.islice(lines, LINES)):
                found = []
                for line in some:
                    url, time, _, entry = line.split(" ", 3)
                    page_id, file, offset, length = json.loads(entry)
                    found.append((r, place, page_id, url, time, file, offset, length))
                    place += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    dealt = manifest.select("range", "run", "offset", "length").repartition(ranges, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, f"range int, place long, {INDEX}")


def read(index: DataFrame) -> DataFrame:
    """The columns of the op3 contract, each record read from its archive."""

    def run(batches):
        name, f = None, None
        for b in batches:
            found = []
            for row in b.to_pylist():
                if row["file"] != name:
                    if f is not None:
                        f.close()
                    name = row["file"]
                    fs, inner = filesystem(name)
                    f = fs.open_input_file(inner)
                found.append(parse(f.read_at(row["length"], row["offset"])))
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        if f is not None:
            f.close()

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    tasks = max(2 * index.sparkSession.sparkContext.defaultParallelism, index.count() // PER_TASK)  # by number: entries are small, their records are not
    dealt = index.withColumn("part", F.floor(F.col("offset") / (4 << 20))).repartition(tasks, "file", "part").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Write the archives of a pages table below path and return their merged index, itself written there."""
    rows = captures(pages)
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), url_key(F.col("url").cast("string")).alias("url_key"))
    total = narrow.count()
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, total // PER_RANGE)
    drawn = hash_sample(narrow, PER_CUT * parts, total, "page_id", "url_key").select("page_id", "url_key", capture_time(F.col("page_id")).alias("time")).collect()
    keys = sorted(line_key(r["url_key"], r["time"], r["page_id"]) for r in drawn)
    bounds = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    return materialize(merge(write(rows, path, bounds), path, parts), "warc-index")


def round_trip(pages: DataFrame) -> DataFrame:
    return read(archive(pages, scratch(pages.sparkSession, "warc")))
