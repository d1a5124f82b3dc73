import math
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import cells, constellation, phrases

KEYS, PAGE = ["b"], ["page"]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fits(e, a):
    return bool(e and a) and (e == a or len(e) >= 4 and e in a or len(a) >= 4 and a in e or max(len(e), len(a)) > 3 and lev(e, a) <= 1)


def test_compatible_pairs_equal_all_pairs(spark):
    r = random.Random(1)
    words = ["", "a", "ab", "abc", "abcd", "xabcdx", "total", "totals", "totl", "subtotal", "tot", "toal", "otal"] + ["".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(150)]
    a = spark.createDataFrame([(1, w) for w in words], "b long, norm string")
    e = spark.createDataFrame([(1, w) for w in words[::2]] + [(2, "abcd")], "b long, norm string")
    got = {(x.b, x.expected, x.actual) for x in constellation.compatible_pairs(e, a, KEYS).collect()}
    assert got == {(1, x, y) for x in words[::2] for y in words if fits(x, y)}
    assert len(got) > 200


def plain_candidates(objects, members, px, py, most=5):
    counts = {}
    for m in members:
        counts[m["kind"]] = counts.get(m["kind"], 0) + 1
    main = max(counts, key=lambda k: (counts[k], k))
    rows = []
    for i, kind, x, y in objects:
        near = 1 - math.hypot(x - px, y - py) / 0.3
        if near >= 0.05:
            rows.append((-(near + (0.25 if kind == main else 0)), i, x, y))
    kept = []
    for row in sorted(rows):
        if len(kept) < most and all(math.hypot(row[2] - k[2], row[3] - k[3]) >= 0.08 for k in kept):
            kept.append(row)
    if not any(math.hypot(k[2] - px, k[3] - py) < 0.05 for k in kept) and len(kept) < most:
        kept.append((-0.15, None, px, py))
    return [(i, x - px, y - py, -s) for s, i, x, y in kept]


def plain_match(cand, members, objects, relations):
    _, tx, ty, score = cand
    used, rows = set(), []
    for m in members:
        best = None
        for i, kind, x, y in sorted(objects):
            d = math.hypot(x - m["x"] - tx, y - m["y"] - ty)
            if i in used or d > 0.08:
                continue
            d *= 1 if kind == m["kind"] else 2
            if best is None or d < best[0]:
                best = (d, i, x, y, kind == m["kind"])
        if best:
            used.add(best[1])
        rows.append((m, best))
    on = [(m, o) for m, o in rows if o]
    average = sum(max(0, 1 - o[0] / 0.08) * (1 if o[4] else 0.5) for _, o in on) / len(members)
    at = {m["id"]: o for m, o in on}
    checked = agreed = 0
    for a, b, *want in relations:
        if a in at and b in at:
            dx, dy = at[b][2] - at[a][2], at[b][3] - at[a][3]
            ax, ay = abs(dx) <= 0.02, abs(dy) <= 0.02
            have = ("horizontal" if ay and not ax else "vertical" if ax and not ay else "diagonal", "same_h" if ax else "left_of" if dx < 0 else "right_of", "same_v" if ay else "above" if dy < 0 else "below")
            checked += sum(w is not None for w in want)
            agreed += sum(w == h for w, h in zip(want, have) if w is not None)
    hits = total = 0
    for i, (a, p) in enumerate(on):
        for b, q in on[i + 1 :]:
            c, h = math.hypot(a["x"] - b["x"], a["y"] - b["y"]), math.hypot(p[2] - q[2], p[3] - q[3])
            total += 1
            hits += 0.65 <= h / c <= 1.5 if c > 1e-6 else h < 0.03
    seen = [(o[2] + m["vx"], o[3] + m["vy"]) for m, o in on]
    center = 1.0
    if len(seen) >= 2:
        mx, my = sum(x for x, _ in seen) / len(seen), sum(y for _, y in seen) / len(seen)
        center = min(1, max(0, 1 - math.sqrt(sum((x - mx) ** 2 + (y - my) ** 2 for x, y in seen) / len(seen)) / 0.06))
    rel, dist = (agreed / checked if checked else 0), (hits / total if total else 0)
    final = average * 0.55 + rel * 0.25 + dist * 0.2 if checked else average * 0.8 + dist * 0.2
    if center < 0.8:
        final *= 0.5 + 0.5 * center
    final = min(1, max(0, final + min(0.15, max(0, score * 0.15))))
    return [o[1] if o else None for _, o in rows], len(on) / len(members), rel, dist, center, final


def test_members_are_assigned_as_by_a_plain_loop(spark):
    r = random.Random(6)
    patterns, pages, relations = {}, {}, {}
    for p in range(4):
        base = [{"id": k, "kind": r.choice(["line", "box"]), "x": 0.3 + r.random() * 0.4, "y": 0.3 + r.random() * 0.4} for k in range(5)]
        px, py = base[0]["x"] + 0.05, base[0]["y"]
        patterns[p] = (px, py, [m | {"vx": px - m["x"], "vy": py - m["y"]} for m in base])
        relations[p] = [(0, 1, "diagonal", "left_of", None), (1, 2, None, "right_of", "above"), (2, 3, "horizontal", None, "same_v")] if p else []
    for page in range(5):
        objects = []
        for _, _, ms in patterns.values():
            objects += [(m["kind"] if r.random() < 0.8 else "box", m["x"] + 0.03 * page + r.gauss(0, 0.01), m["y"] + r.gauss(0, 0.01)) for m in ms if r.random() < 0.85]
        objects += [("box", r.random(), r.random()) for _ in range(20)]
        pages[page] = [(i, *o) for i, o in enumerate(objects)] if page < 4 else [(0, "box", 0.99, 0.99)]
    make = spark.createDataFrame
    objects = make([(1, page, *o) for page, os in pages.items() for o in os], "b long, page long, id long, kind string, x double, y double")
    members = make([(1, p, m["id"], m["kind"], m["x"], m["y"], px, py, m["vx"], m["vy"]) for p, (px, py, ms) in patterns.items() for m in ms], "b long, pattern_id long, member_id long, kind string, x double, y double, px double, py double, vx double, vy double")
    links = make([(1, p, *x) for p, xs in relations.items() for x in xs], "b long, pattern_id long, from_id long, to_id long, alignment string, h_order string, v_order string")
    cand = constellation.candidates(objects, members, KEYS, PAGE)
    got = constellation.scored(constellation.assigned(cand, members, objects, KEYS, PAGE), links, KEYS, PAGE).collect()
    want = {}
    for page, os in pages.items():
        for p, (px, py, ms) in patterns.items():
            for c in plain_candidates(os, ms, px, py):
                want[page, p, c[0]] = plain_match(c, ms, os, relations[p])
    assert {(g.page, g.pattern_id, g.candidate_id) for g in got} == set(want)
    for g in got:
        w = want[g.page, g.pattern_id, g.candidate_id]
        assert [m.object_id for m in g.members] == w[0]
        assert [round(v, 4) for v in (g.coverage, g.relation_ratio, g.distance_ratio, g.center_ratio)] == pytest.approx([round(v, 4) for v in w[1:5]], abs=1.1e-4)
        assert g.final == pytest.approx(w[5], abs=1.1e-4)
        assert g.accepted == (w[5] >= 0.35 and w[1] >= 0.5)
        ids = [m.object_id for m in g.members if m.object_id is not None]
        assert len(ids) == len(set(ids))
    assert any(g.accepted for g in got) and any(g.candidate_id is None for g in got)


def plain_phrases(stable, positions, docs):
    """By loops over sorted lists: head, text, documents."""
    found = []
    for b in {s[0] for s in stable}:
        rows = sorted((s for s in stable if s[0] == b), key=lambda s: (s[4], s[1]))
        line, lines = [], []
        for s in rows:
            if line and s[4] - line[-1][4] > 0.02:
                lines.append(line)
                line = []
            line.append(s)
        lines.append(line)
        at = {}
        for q in positions:
            at.setdefault((q[0], q[1]), set()).add(q[2])
        n = len({d[1] for d in docs if d[0] == b})
        for line in lines:
            line, used = sorted(line, key=lambda s: (s[3], s[1])), set()
            for i, s in enumerate(line):
                if s[1] in used:
                    continue
                chain, last = [s], s
                used.add(s[1])
                for t in line[i + 1 :]:
                    if t[1] in used:
                        continue
                    if abs(t[4] - last[4]) > (last[6] + t[6]) / 2 * 1.5:
                        break
                    if 0 <= t[3] - (last[3] + last[5] / 2) < max(last[5], t[5]) * 2:
                        chain.append(t)
                        used.add(t[1])
                        last = t
                both = set.intersection(*(at.get((b, c[1]), set()) for c in chain))
                groups = [(chain, both)] if len(both) >= 2 else [([c], at.get((b, c[1]), set())) for c in chain]
                for g, d in groups:
                    if len(d) >= 2:
                        conf = min(1, len(d) / n * 0.5 + sum(c[7] for c in g) / len(g) * 0.5)
                        found.append((b, g[0][1], " ".join(c[2] for c in g), len(g), len(d), round(conf, 4)))
    return sorted(found)


def test_phrases_equal_a_plain_loop(spark):
    r = random.Random(9)
    stable, positions, docs = [], [], [(b, d) for b in (1, 2) for d in range(4)]
    for b in (1, 2):
        for i in range(80):
            x, y = r.random(), r.choice([0.1, 0.105, 0.2, 0.3, 0.31, 0.5]) + r.random() * 0.002
            stable.append((b, i, f"t{i}", x, y, r.choice([0.02, 0.05]), r.choice([0.005, 0.01]), round(r.random(), 3)))
            positions += [(b, i, d, x, y, 0.02, 0.01) for d in range(4) if r.random() < 0.9]
    make = spark.createDataFrame
    s = make(stable, "b long, id long, text string, mean_x double, mean_y double, mean_w double, mean_h double, stability double")
    p = make(positions, "b long, id long, doc long, x double, y double, w double, h double")
    found = phrases.phrases(s, p, make(docs, "b long, doc long"), KEYS)
    got = sorted((x.b, x["head"], x.text, x.tokens, x.docs, x.confidence) for x in found.collect())
    want = plain_phrases(stable, positions, docs)
    assert [g[:5] for g in got] == [w[:5] for w in want] and all(abs(g[5] - w[5]) <= 1.1e-4 for g, w in zip(got, want))
    assert sum(g[3] > 1 for g in got) > 10
    boxes = phrases.phrase_boxes(s, p, found, KEYS)
    assert boxes.groupBy("b", "head").count().join(found.where("tokens > 1"), ["b", "head"]).where(F.col("count") != F.col("docs")).count() == 0
    none = phrases.phrases(s.where("false"), p, make(docs, "b long, doc long"), KEYS)
    assert none.collect() == []


def test_cells_keep_tokens_where_none_is_aligned(spark):
    make = spark.createDataFrame
    tokens = make([(1, k, 100.0 + 7 * k, 50.0, 5.0, 10.0, f"t{k}") for k in range(4)] + [(1, 9, 101.0, 50.0, 5.0, 10.0, " "), (1, 10, 100.0, 5.0, 5.0, 10.0, "head")], "b long, id long, x double, y double, w double, h double, text string")
    bands = make([(1, 1, 45.0, 65.0), (1, 2, 64.0, 64.5)], "b long, band_id long, y0 double, y1 double")
    schema = "b long, column_id long, x0 double, x1 double, header_bottom double, header_pad double, expected_left double, expected_right double, expected_center double, tolerance double, align string"
    columns = make([(1, 1, 90.0, 200.0, 20.0, 2.0, 100.0, None, None, 8.0, None), (1, 2, 90.0, 200.0, 20.0, 2.0, 300.0, None, None, 8.0, "left"), (1, 3, 90.0, 200.0, 20.0, 2.0, None, None, None, 8.0, "right"), (1, 4, 90.0, 200.0, 20.0, 2.0, 300.0, None, None, None, "left")], schema)
    got = {}
    for x in cells.cell_tokens(tokens, columns, bands, KEYS).collect():
        got.setdefault((x.column_id, x.band_id), []).append((x.id, x.aligned))
    assert sorted(got[1, 1]) == [(0, True), (1, True)]
    assert sorted(got[2, 1]) == [(2, False), (3, False)]  # the two nearest of four
    assert len(got[3, 1]) == 4 and len(got[4, 1]) == 4 and all(ok for _, ok in got[4, 1])
    assert {k[1] for k in got} == {1}
    assert [x.text for x in cells.cell_texts(cells.cell_tokens(tokens, columns, bands, KEYS), KEYS).where("column_id = 1").collect()] == ["t0 t1"]
    assert cells.cell_tokens(tokens.where("false"), columns, bands, KEYS).collect() == []
