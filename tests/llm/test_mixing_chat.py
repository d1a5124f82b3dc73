import hashlib
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm import chat, mixing

DOCS = "doc_id long, source string, text string, size string, taken int, chunk int"


def fill(sizes, weights):
    """Targets by resharing the excess until no source is above three times its size."""
    total, stopped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in stopped)
        open_ = [i for i in range(len(sizes)) if i not in stopped]
        if not open_:
            return [3.0 * s for s in sizes]
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 3 * sizes[i]}
        if not over:
            return [3.0 * sizes[i] if i in stopped else share[i] for i in range(len(sizes))]
        stopped |= over


def test_mix_reaches_targets(spark):
    counts = {"a": 900, "b": 3, "ä": 200, None: 400, "c": 0}
    rows = [(1000 * k + i, s, "w " * (1 + (i * 7) % 40), "x", 1, 2) for k, (s, n) in enumerate(counts.items()) for i in range(max(n // 20, 1))]
    rows = [(d, s, t if s != "c" else " ", *x) for d, s, t, *x in rows] + [(99999, "a", None, "", 0, 0)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block=16).collect()
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5), block=16).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, s, t, *_ in rows}
    assert {r.doc_id: r.size for r in got} == size and all(r.taken <= 3 * r.size for r in got)
    order = sorted(k for k in counts if k is not None) + [None]
    sizes = [sum(size[d] for d, s, *_ in rows if s == k) for k in order]
    for k, s, target in zip(order, sizes, fill(sizes, [i % 3 + 1 for i in range(len(order))])):
        own = [r for r in got if r.source == k]
        assert own[0].target == pytest.approx(target) and own[0].source_size == s
        assert abs(sum(r.taken for r in own) - target) < 1 + 1e-6


def test_schedule_is_even(spark):
    base = spark.createDataFrame([(i, "a" if i % 3 else "b", 64, i) for i in range(300)], "doc_id long, source string, size long, place long")
    goal = mixing.targets(base, 16)
    slots = mixing.schedule(goal, 16).orderBy("time").collect()
    assert [r.time for r in slots] == sorted(r.time for r in slots) and len({r.time for r in slots}) == len(slots)
    share = sum(r.src == 0 for r in slots) / len(slots)
    for n in range(64, len(slots), 64):
        assert abs(sum(r.src == 0 for r in slots[:n]) - share * n) < 12
    for src in (0, 1):
        assert [r.rank for r in slots if r.src == src] == list(range(sum(r.src == src for r in slots)))


def test_mix_of_nothing_and_resampling(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0 and mixing.resampled(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", "", "", 0, 0), (None, None, None, "", 0, 0)], DOCS)
    assert sorted(r.taken for r in mixing.mix(blank).collect()) == [0, 0]
    df = spark.createDataFrame([(i, "a" if i < 8 else "b", "w " * 100, "s", 0, 0) for i in range(9)] + [(1, "a", "w " * 100, "s", 0, 0)], DOCS)
    out = mixing.resampled(df, 10)
    assert out.columns == df.columns and out.where("source = 'b'").count() == 3
    native = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in native and "Arrow" not in native


def test_mix_is_read_in_the_order_of_the_schedule(spark):
    docs = [(i, "abc"[i % 3], " ".join(f"{i}.{k}" for k in range(1 + (i * 11) % 70)), "", 0, 0) for i in range(200)]
    docs += [(500, "a", " ".join(f"x{k}" for k in range(900)), "", 0, 0), (None, "b", "no id here", "", 0, 0), (None, "b", "nor here", "", 0, 0), (7, "b", docs[7][2], "", 0, 0)]
    df = spark.createDataFrame(docs, DOCS)
    rows = mixing.blocks(df, 16).orderBy("time", "p").collect()
    goal = {r.source: r for r in mixing.mix(df, 16).collect()}
    times = sorted({r.time: r.source for r in rows}.items())
    for s in "abc":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.stop - r.start for r in own) - goal[s].target) < 1 + 1e-6
        assert [r["pass"] for r in own] == sorted(r["pass"] for r in own)  # every block once before any comes again
        share = sum(x == s for _, x in times) / len(times)
        assert all(abs(sum(x == s for _, x in times[:n]) - share * n) < 8 for n in range(len(times)))
    taken = {}
    for r in rows:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.stop - r.start
    by_mix = {}
    for r in mixing.mix(df, 16).where("taken > 0").collect():
        by_mix[r.doc_id] = by_mix.get(r.doc_id, 0) + r.taken
    assert taken == by_mix


def test_resampled_cuts_the_last_pass_and_meets_the_targets(spark):
    docs = [(i, "abc"[i % 3], " \n" * (i % 2) + "  ".join(f"{i}.{k}" for k in range((i * 11) % 70)) + " ", "", 0, 0, 5, {"m": 1}) for i in range(200)]
    docs += [docs[4], docs[4], (None, "b", "no id here", "", 0, 0, 0, None), (None, None, None, "", 0, 0, 0, None), (9, "c", "", "", 0, 0, 0, None)]
    df = spark.createDataFrame(docs, DOCS + ", n_chars long, row map<string,int>")
    out = mixing.resampled(df, 16)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows, mix = out.collect(), mixing.mix(df, 16).collect()
    whole = {(d[0], d[2]) for d in docs}
    cut = [r for r in rows if (r.doc_id, r.text) not in whole]
    assert 0 < len(cut) <= 3 and all(any(d == r.doc_id and t.startswith(r.text) for d, t in whole if t) for r in cut)
    assert all(r.n_chars == len(r.text) for r in rows)
    count = lambda t: len(re.findall(mixing.WORD, t))
    for s in "abc":
        assert abs(sum(count(r.text) for r in rows if r.source == s) - next(m.target for m in mix if m.source == s)) < 1 + 1e-6
    taken = {}
    for m in mix:
        taken[m.doc_id] = taken.get(m.doc_id, 0) + m.taken
    for d in {r.doc_id for r in rows}:
        assert sum(count(r.text) for r in rows if r.doc_id == d) == taken[d]


MESSAGES = "conv_id long, turn long, role string, text string"


def read(spark, rows):
    m = spark.createDataFrame(rows, MESSAGES)
    return chat.formatted(m.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|x", "a\nb\\n", "", None, "é😀<|", "<|image_1|>", "\\\\|\\|"]
    rows = [(k, i, "assistant" if i % 2 else "user", t) for k, t0 in enumerate(odd) for i, t in enumerate([t0, "x", t0, t0])]
    rows += [(50, 0, "ro\nle\\n<|im_end|>\n", "t"), (50, None, None, "first"), (None, 0, "assistant", "n")]
    out = read(spark, rows)
    got = {r.conv_id: r for r in chat.digests(chat.parsed(out)).collect()}
    raw = {r.conv_id: r for r in out.collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0))
        lines = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[k].n_turns == len(own) and got[k].turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k].formatted_chars == len(raw[k].formatted) and raw[k].formatted.count("<|im_start|>") == len(own)
    assert chat.digests(chat.parsed(read(spark, rows).limit(0))).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_parts_become_placeholders(spark):
    parts = [("text", "see <|", None, None), ("image", None, "s3://a", 3), ("audio", None, "b", None), ("slides", None, "c", 2), (None, "end", None, None)]
    m = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", []), (2, 0, "user", None)], f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    r = {x.conv_id: x for x in chat.formatted(m).collect()}
    assert r[1].formatted == "<|im_start|>user\nsee <\\|<|image_1|><|audio_2|><|document_3|>end<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.message, a.place, a.kind, a.uri, a.tokens) for a in r[1].attachments] == [(0, 1, "image", "s3://a", 768), (0, 2, "audio", "b", 25), (0, 3, "document", "c", 2048)]
    assert r[1].attachment_tokens == 2841 and r[2].attachment_tokens == 0
