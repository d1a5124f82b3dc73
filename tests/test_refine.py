import math
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import corrections, frames, refine, transfer

BOXES = "page long, id long, x double, y double, w double, h double, confidence double, ocr boolean, contour boolean, text_density double"


def inter(a, b):
    x, y = max(a[0], b[0]), max(a[1], b[1])
    w, h = min(a[0] + a[2], b[0] + b[2]) - x, min(a[1] + a[3], b[1] + b[3]) - y
    return (x, y, w, h) if w > 0 and h > 0 else None


def plain_overlaps(rows):
    """Pair by pair over lists, by id."""
    box = [list(r[2:6]) for r in rows]
    area = lambda b: b[2] * b[3]
    parent = []
    for j, b in enumerate(box):
        around = [(area(a), i) for i, a in enumerate(box) if i != j and a[0] <= b[0] and a[1] <= b[1] and a[0] + a[2] >= b[0] + b[2] and a[1] + a[3] >= b[1] + b[3] and area(a) > area(b) * 1.1]
        parent.append(min(around)[1] if around else -1)
    worth = [r[6] + 0.3 * r[7] + 0.1 * r[8] + 0.2 * (r[9] > 0.5) for r in rows]
    gone = set()
    for i in range(len(rows)):
        if i in gone:
            continue
        for j in range(i + 1, len(rows)):
            if j in gone:
                continue
            if parent[j] == i or parent[i] == j:
                inside, outside = (j, i) if parent[j] == i else (i, j)
                if area(box[inside]) / max(1, area(box[outside])) < 0.8:
                    continue
            s = inter(box[i], box[j])
            part = area(s) / max(1, min(area(box[i]), area(box[j]))) if s else 0
            if part < 0.3:
                continue
            if area(s) / (area(box[i]) + area(box[j]) - area(s)) > 0.7:
                if worth[i] >= worth[j]:
                    gone.add(j)
                    continue
                gone.add(i)
                break
            if part < 0.85 and parent[i] == parent[j]:
                big, small = (i, j) if area(box[i]) >= area(box[j]) else (j, i)
                b, s = box[big], inter(box[big], box[small])
                cuts = []
                if s[0] == b[0]:
                    cuts.append((s[2], "left"))
                if s[0] + s[2] == b[0] + b[2]:
                    cuts.append((s[2], "right"))
                if s[1] == b[1]:
                    cuts.append((s[3], "top"))
                if s[1] + s[3] == b[1] + b[3]:
                    cuts.append((s[3], "bottom"))
                if cuts:
                    n, side = min(cuts, key=lambda c: c[0])
                    if side in ("left", "right"):
                        b[2] -= n
                        b[0] += n * (side == "left")
                    else:
                        b[3] -= n
                        b[1] += n * (side == "top")
    return {r[1]: tuple(b) for k, (r, b) in enumerate(zip(rows, box)) if k not in gone}


def plain_snap(boxes, tolerance):
    def clusters(values):
        values, out, start = sorted(values), [], 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] - values[i - 1] > tolerance:
                out.append(sum(values[start:i]) / (i - start))
                start = i
        return out

    xs = clusters([v for b in boxes.values() for v in (b[0], b[0] + b[2])])
    ys = clusters([v for b in boxes.values() for v in (b[1], b[1] + b[3])])

    def snap(v, cs):
        best = min(cs, key=lambda c: abs(v - c))
        return math.floor(best * 100 + 0.5) / 100 if abs(v - best) <= tolerance else v

    out = {}
    for i, (x, y, w, h) in boxes.items():
        left, top = snap(x, xs), snap(y, ys)
        out[i] = (left, top, max(2, snap(x + w, xs) - left), max(2, snap(y + h, ys) - top))
    return out


def pages():
    r = random.Random(12)
    rows = []
    for page in range(6):
        for i in range(40 if page else 1):
            x, y = r.randrange(0, 400, 10), r.randrange(0, 300, 10)
            rows.append((page, i, float(x), float(y), float(r.choice([40, 60, 61, 100])), float(r.choice([20, 22, 50])), r.randrange(10) / 10, r.random() < 0.3, r.random() < 0.3, r.random()))
        if page:
            rows.append((page, 98, *rows[-1][2:6], 0.99, True, True, 1.0))  # a copy that is worth more
            rows.append((page, 99, *rows[-9][2:6], *rows[-9][6:]))  # one that is worth the same
    return rows


def test_overlaps_are_resolved_as_by_a_plain_loop(spark):
    rows = pages()
    got = {}
    for x in refine.without_overlaps(spark.createDataFrame(rows, BOXES).repartition(3), ["page"]).collect():
        got.setdefault(x.page, {})[x.id] = (x.x, x.y, x.w, x.h)
    trimmed = 0
    for page in range(6):
        mine = [r for r in rows if r[0] == page]
        assert got[page] == plain_overlaps(mine)
        trimmed += sum(got[page].get(r[1]) not in (None, r[2:6]) for r in mine)
    assert trimmed > 10 and sum(map(len, got.values())) < len(rows)


@pytest.mark.parametrize("tolerance", [4.0, 6.0])
def test_edges_snap_as_by_a_plain_loop(spark, tolerance):
    r = random.Random(4)
    rows = [(p, i, r.random() * 300, r.random() * 300, 20 + r.random() * 50, r.random() * 30, 0.5, False, False, 0.0) for p in range(3) for i in range(25)]
    got = {(x.page, x.id): (x.x, x.y, x.w, x.h) for x in refine.snapped(spark.createDataFrame(rows, BOXES), ["page"], tolerance).collect()}
    for p in range(3):
        for i, w in plain_snap({row[1]: row[2:6] for row in rows if row[0] == p}, tolerance).items():
            assert got[p, i] == pytest.approx(w, abs=0.011)


def test_repeated_sizes_become_equal_and_tile(spark):
    cells = [(1, i, 100.0 * i, 50.0, 95.0 + i, 20.0 + i % 2, 0.5, False, False, 0.0) for i in range(4)]
    other = [(1, 9, 10.0, 200.0, 30.0, 30.0, 0.5, False, False, 0.0), (2, 1, 1.0, 2.0, 3.0, 4.0, None, None, None, None)]
    got = {(x.page, x.id): x for x in refine.with_equal_sizes(spark.createDataFrame(cells + other, BOXES), ["page"]).collect()}
    assert {got[1, i].h for i in range(4)} == {20.0, 21.0}  # half a pixel is left alone
    assert all(abs(got[1, i].x + got[1, i].w - got[1, i + 1].x) < 1e-9 for i in range(3))
    assert tuple(got[1, 9])[2:6] == (10.0, 200.0, 30.0, 30.0)
    whole = refine.refined(spark.createDataFrame(cells + other, BOXES), ["page"])
    assert whole.columns == BOXES.replace(",", "").split()[::2] and whole.count() == 6
    assert refine.refined(spark.createDataFrame([], BOXES), ["page"]).collect() == []


def test_angles_wrap_around(spark):
    seeds = spark.createDataFrame([(1, k, 100.0, 40.0, 20.0, 20.0, b) for k, b in ((1, 0.0), (2, None), (3, 30.0), (4, None), (5, None))], "p long, id long, x double, y double, w double, h double, block_angle double")
    lines = spark.createDataFrame([(1, 1, 355.0), (1, 1, 5.0), (1, 5, 10.0), (1, 5, 190.0), (1, 4, None)], "p long, id long, angle double")
    near = spark.createDataFrame([(1, 2, 358.0), (1, 2, -358.0), (1, 3, 90.0)], "p long, id long, angle double")
    f = frames.local_frames(seeds, lines, near, ["p"])
    got = {x.id: x for x in f.collect()}
    close = lambda a, b: min(abs(a - b), 360 - abs(a - b)) < 1e-6
    assert close(got[1].angle, 0) and got[1].source == "text-line-orientation" and got[1].confidence == pytest.approx(0.9)
    assert close(got[2].angle, 0) and got[2].source == "region-orientation"
    assert (got[3].angle, got[3].source) == (30.0, "containing-block-orientation")
    assert (got[4].angle, got[4].source, got[4].confidence) == (0.0, "fallback-seed-axis", 0.2)
    assert close(got[5].angle, 10)  # opposite lines cancel
    back = f.withColumn("l", frames.to_local(F.lit(7.0), F.lit(9.0))).withColumn("g", frames.to_page(F.col("l.x"), F.col("l.y"))).collect()
    assert all(abs(x.g.x - 7) < 1e-9 and abs(x.g.y - 9) < 1e-9 for x in back)
    anchors = spark.createDataFrame([(1, 3, n, f"t{n}", 110.0, 50.0 + n, 0.5) for n in range(9)], "p long, id long, node_id long, text string, x double, y double, score double")
    labels = spark.createDataFrame([(1, 3, n, f"l{n}", n / 10) for n in range(5)], "p long, id long, node_id long, text string, score double")
    s = {x.id: x for x in frames.signatures(f.withColumn("structure", F.lit(0.4)), anchors, labels, spark.createDataFrame([(1, 3)] * 90, "p long, id long"), ["p"]).collect()}
    assert [a.node_id for a in s[3].anchors] == [0, 1, 2, 3, 4, 5] and [a.node_id for a in s[3].labels] == [4, 3, 2, 1] and s[3].edges == 80
    assert s[3].confidence == pytest.approx(0.18 + 0.38 * 0.25 + 0.3) and s[1].anchors is None
    assert s[3].anchors[2].at.y == pytest.approx(2 * math.cos(math.radians(30)))


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_the_best_box_is_found_as_by_a_plain_loop(spark):
    r = random.Random(3)
    fields = [(1, k, r.random() * 0.7, r.random() * 0.7, 0.12, 0.08) for k in range(12)] + [(1, 50, 0.0, 0.9, 0.004, 0.004)]
    regions = [(1, k, f[2] - 0.01, f[3] - 0.01, 0.15, 0.1) for k, f in enumerate(fields[:6])] + [(1, 90, 0.0, 0.0, 1.0, 1.0)]
    tokens = [(1, 1, n, r.choice(["red", "bolt", "ring"]), r.random() * 0.9, round(r.random() * 0.9, 2), 0.03, 0.01, r.random()) for n in range(500)]
    box = "b long, id long, x double, y double, w double, h double"
    make = spark.createDataFrame
    tried = frames.variants(make(fields, box), make(regions, box), ["b"])
    by_field = {}
    for v in tried.collect():
        by_field.setdefault(v.id, []).append(v)
    assert {k: len(v) for k, v in by_field.items() if k < 6} == {k: 21 for k in range(6)} and all(19 <= len(by_field[k]) <= 21 for k in range(6, 12))
    assert all(v.w * v.h <= 2 * v.o_w * v.o_h + 1e-9 for vs in by_field.values() for v in vs) and len(by_field[50]) < 19
    t = make(tokens, "b long, doc long, id long, text string, x double, y double, w double, h double, confidence double")
    read = transfer.read(tried.withColumn("doc", F.lit(1).cast("long")).withColumn("field_id", F.struct("id", "n")), t, ["b"]).withColumn("wanted", F.lit("Red bolt"))
    scored = frames.scored_variants(read)
    for v in scored.collect():
        said, want = v.text.strip(), "Red bolt"
        alike = 0.0
        if said:
            alike = (1 - lev(said, want) / max(len(said), len(want))) * 0.6 + sum(w in said.lower() for w in ("red", "bolt")) / 2 * 0.4
        shared = max(0, min(v.x + v.w, v.o_x + v.o_w) - max(v.x, v.o_x)) * max(0, min(v.y + v.h, v.o_y + v.o_h) - max(v.y, v.o_y))
        away = math.hypot(v.x + v.w / 2 - v.o_x - v.o_w / 2, v.y + v.h / 2 - v.o_y - v.o_h / 2)
        align = shared / (v.w * v.h + v.o_w * v.o_h - shared) * 0.6 + max(0, 1 - away / 0.15) * 0.4
        sure = min(1, v.text_confidence) * 0.7 + min(1, v.tokens / 5) * 0.3 if v.tokens else 0
        assert v.total == pytest.approx(align * 0.4 + sure * 0.3 + alike * 0.3, abs=1.1e-4)
    best = {x.id: x for x in frames.best_boxes(scored, ["b"]).collect()}
    for i in by_field:
        mine = sorted((v for v in scored.where(F.col("id") == i).collect()), key=lambda v: (-v.total, v.n))
        assert (best[i].x, best[i].total, best[i].tried) == (mine[0].x, mine[0].total, len(mine)) and best[i].improvement >= 0


def codes(n=400):
    r = random.Random(5)
    rows = []
    for seq in range(n):
        text = r.choice(["KV-4", "KV-8"]) + f"{r.randrange(1000):03d}" + r.choice(["", " ab2", " 77x"])
        if r.random() < 0.2:
            text = text.replace("0", "O").replace("1", "I")
        if r.random() < 0.1:
            text = text.replace("V", "5")
        rows.append((r.randrange(3), seq, None if r.random() < 0.02 else "--" if r.random() < 0.02 else text, r.choice(["any", "any", "any", "text", "numeric", None])))
    return rows


EVENTS = "account long, seq long, text string, kind string"


def test_corrections_equal_a_plain_walk_over_the_events(spark):
    df = spark.createDataFrame(codes(), EVENTS).repartition(4)
    got = {x.seq: x for x in corrections.corrected(df, ["account"]).collect()}
    state, changed = {}, 0
    for x in sorted(corrections.typed(df).collect(), key=lambda x: x.seq):
        want = corrections.advance(state.setdefault(x.account, {}), x.slots, list(x.words))
        g = got[x.seq]
        assert (g.layout, g.expected, g.violation) == want, x
        changed += g.final != g.typed
        if g.final == g.typed:
            continue
        assert g.violation and g.ok and len(g.final) == len(g.typed)
        for a, b, l in zip([c for c in g.typed if c.isalnum()], [c for c in g.final if c.isalnum()], g.layout):
            assert a == b or (l == "N" and b.isdigit()) or (l == "L" and b.isalpha())
    assert len(got) == 400 and changed > 10
    # a word that is known to hold letters there vetoes the digit
    assert spark.range(1).select(corrections._fixed(F.lit("O5O"), F.lit("NLN"), F.lit("LN?"))).first()[0] == "O50"


def test_batch_and_stream_forms_agree(spark, tmp_path):
    rows = codes()
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : (part + 1) * 100], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    name = "corrected_stream_test"
    run = corrections.corrected_stream(stream, ["account"]).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    want = corrections.corrected(spark.createDataFrame(rows, EVENTS), ["account"])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table(name)) == key(want)
