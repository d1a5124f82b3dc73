"""What a Python worker, which lives through many stages, holds on to."""

import gc
import os
import subprocess
import sys
import weakref

import pyarrow as pa
import pytest

from foliant.llm import bpe, langid, nearcopies
from foliant.llm.common import portions
from foliant.llm.queries import vocabulary

STAGE = """
import re, sys
import pandas  # as in a worker
import numpy as np, pyarrow as pa
from foliant.llm import nearcopies
from foliant.llm.common import portions

def used():
    return sum(int(x) for x in re.findall(r"\\nAnonymous: +(\\d+)", open("/proc/self/smaps").read())) / 1024

def task(path):
    for b in portions(pa.ipc.open_stream(open(path, "rb", 1 << 16))):
        yield [nearcopies.shingles(t) for t in b.column(0).to_pylist()]

list(map(len, task(sys.argv[2])))
before = used()
for _ in range(2):
    for _ in task(sys.argv[1]):
        pass
print(used() - before)
"""


def test_last_portion_does_not_hold_its_batch():
    batch = pa.RecordBatch.from_pydict({"k": list(range(5000)), "t": ["x" * 2000] * 5000, "l": [{"a": [k]} for k in range(5000)]})
    found = []
    for part in portions(iter([batch, batch.slice(0, 0), batch.slice(7, 3)])):
        found.append(part.to_pylist())
        if part.num_rows > 3:
            last = part
    assert last.get_total_buffer_size() < batch.nbytes / 2
    assert sum(found, []) == batch.to_pylist() + batch.slice(7, 3).to_pylist()
    assert max(map(len, found)) <= 1000


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_worker_returns_the_memory_of_a_task(tmp_path):
    words = [f"word{k * 7919 % 10007}" for k in range(20_000)]
    texts = [" ".join(words[k % 9000 : k % 9000 + 400]) for k in range(8000)]
    for name, own in (("large", texts), ("small", texts[:1500])):
        batch = pa.RecordBatch.from_pydict({"text": own})
        with pa.ipc.new_stream(str(tmp_path / name), batch.schema) as out:
            out.write_batch(batch)
    root = os.path.dirname(os.path.dirname(bpe.__file__)) + "/.."
    run = subprocess.run([sys.executable, "-c", STAGE, str(tmp_path / "large"), str(tmp_path / "small")], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert float(run.stdout) < 15  # MB


def test_a_process_keeps_the_state_of_one_stage():
    path = vocabulary("word_bpe_49k.json")
    first = bpe.encoder(path)
    assert bpe.encoder(path) is first
    gone = weakref.ref(first)
    del first
    counters = nearcopies._counters([(1, "")])
    assert nearcopies._counters([(1, "")]) is counters and len(nearcopies._counters([(2, "")])) == 2 * len(counters)
    gc.collect()
    assert gone() is None
    assert langid.letters()[ord("é")] and not langid.letters()[ord("1")] and langid.letters() is langid.letters()
