import random
import re

from foliant.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string, items string, n_chars long", "item_id long, text string, w int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    """Every window of every item against every place of every document."""
    rows = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            n = min(window, len(p))
            grams = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add("" if item is None else str(item))
        rows.append((doc_id, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return rows


def corpus():
    r = random.Random(3)
    some = ["alpha", "Beta", "gamma", "École", "école", "İx", "σς", "d1", "中文", "K"]
    passage = lambda n: r.choice([" ", ", ", ".\n"]).join(r.choices(some, k=n))
    items = [(k, passage(r.randint(10, 30))) for k in range(20)] + [(100, passage(3)), (101, "one"), (102, ""), (103, None), (None, passage(12)), (7, passage(15)), (9, passage(1) + " ! " + passage(11))]
    items += [(k, items[3][1].upper()) for k in (30, 200)]
    docs = []
    for k in range(120):
        parts = [passage(r.randint(0, 40)) for _ in range(r.randint(0, 3))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), r.choice(items)[1] or "")
        docs.append((k if k % 9 else None, " ".join(parts).upper() if k % 7 == 0 else " - ".join(parts)))
    docs += [(500, None), (501, ""), (502, "..."), (503, "One"), (503, "one two"), (504, "K"), (505, "filler " * 30000 + (items[0][1]) + " filler" * 5)]
    return docs + docs[:40] + [docs[5]] * 30, items


def rows_of(df):
    return sorted(((x.doc_id, x.n_words, x.n_hit, tuple(x["items"]), x.contaminated) for x in df.collect()), key=str)


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, 1) for i in items], ITEMS)


def test_contamination_equals_brute_force(spark):
    docs, items = corpus()
    want = sorted(brute(docs, items), key=str)
    d, b = tables(spark, docs, items)
    assert rows_of(decontam.contamination(d, b)) == want
    assert rows_of(decontam.contamination(d, b, rows=60)) == want  # the windows in several broadcasts
    assert sum(x[4] for x in want) > 40


def test_windows_of_full_length_only(spark):
    docs, items = corpus()
    items = [i for i in items if len(words(i[1])) >= 10]
    d, b = tables(spark, docs, items)
    assert rows_of(decontam.contamination(d, b)) == sorted(brute(docs, items), key=str)


def test_nothing_to_find(spark):
    docs = [(1, "a b"), (None, None)]
    d, b = tables(spark, docs, [])
    assert rows_of(decontam.contamination(d, b)) == sorted(brute(docs, []), key=str)
    empty, b = tables(spark, [], [(1, "a b")])
    assert decontam.contamination(empty, b).collect() == []


def test_spans_and_documents_are_removed(spark):
    docs, items = corpus()
    d, b = tables(spark, docs, items)
    flagged = brute(docs, items)
    kept = decontam.decontaminated(d, b, whole=True).collect()
    assert sorted(((x.doc_id, x.text) for x in kept), key=str) == sorted((doc for doc, f in zip(docs, flagged) if not f[4]), key=str)
    spans = decontam.decontaminated(d, b)
    assert spans.columns == d.columns
    found = spans.collect()
    assert len(found) == len(docs)
    assert sorted((len(words(x.text)) for x in found)) == sorted(f[1] - f[2] for f in flagged)
    clean = [doc for doc, f in zip(docs, flagged) if not f[4]]
    assert all(c in [(x.doc_id, x.text) for x in found] for c in clean)
    assert all(x.text is None or x.n_chars == len(x.text) for x in found if x.text is not None)


def test_no_python_in_the_plan(spark):
    docs, items = corpus()
    plan = decontam.digests(decontam.contamination(*tables(spark, docs[:5], items)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
