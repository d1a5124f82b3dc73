import random

import numpy as np

from foliant.llm import langid, toxicity

WORDS = {"en": ["the", "with", "thing", "other"], "de": ["der", "ung", "schön", "über"], "fr": ["les", "été", "avec", "chose"]}


def texts(n, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[k]) for _ in range(r.randint(8, 60))), k, "s", 0.5, k) for i in range(n) for k in [r.choice(list(WORDS))]]


SCHEMA = "doc_id long, text string, lang string, source string, score double, lang_pred string"


def test_language_of_held_out(spark):
    rows = texts(600) + [(1000, None, "en", "s", 0.0, ""), (1001, "123 !!", "en", "s", 0.0, ""), (1002, "", None, "s", 0.0, ""), (None, "the other thing", None, "s", 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(df)).collect()}
    import zlib

    for d, _, lang, *_ in rows[:600]:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and got[d].lang_pred == lang and 0 <= got[d].score <= 1
    assert [got[k].lang_pred for k in (1000, 1001, 1002, None)] == ["und", "und", "und", "en"]
    assert langid.keep(df, langid.fit(df), 0.02).count() == 601
    empty = df.limit(0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.fit(empty)).collect()} == {"und"}


def test_long_text_without_a_letter_is_und(spark):
    rows = [(i, t, "en", "s", 0.0, "") for i, t in enumerate(["12345 " * 12, "of it", "- " * 40, "of it", "1 2 3", "the of it"])]
    model = langid.Filter(["en"], [np.concatenate([h for _, _, h, *_ in langid.grams(["the of it"])])])
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, SCHEMA).coalesce(1), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "en"] * 3 and [got[i].score for i in (0, 2, 4)] == [0, 0, 0]
    assert {r.doc_id for r in langid.keep(spark.createDataFrame(rows, SCHEMA).coalesce(1), model, 0.001).collect()} == {1, 3, 5}


def test_no_ngram_spans_two_texts():
    alone = [np.sort(h).tolist() for t in ("12345 ", "of it", "a") for _, _, h, *_ in langid.grams([t])]
    for _, _, h, owner, some in langid.grams(["12345 ", "of it", "a"]):
        assert [np.sort(h[owner == k]).tolist() for k in range(3)] == alone and some.tolist() == [False, True, True]


def test_filter_has_no_false_negatives_and_corrects():
    sets = [np.arange(k, 30000, 3, dtype=np.uint64) * langid.FACTORS[0] for k in range(70)]
    f = langid.Filter([f"l{k:02d}" for k in range(70)], sets)
    for k in (0, 63, 64, 69):
        mask = ~np.uint64(0)
        for p in langid.positions(sets[k]):
            mask = mask & f.words[k // 64][p]
        assert ((mask >> np.uint64(k % 64)) & np.uint64(1)).all()
    assert (f.wrong < 0.05).all()


def test_chain(spark):
    r = random.Random(2)
    plain = [f"word{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(900):
        bad, junk = i % 9 == 0, i % 7 == 0
        words = r.choices(plain, k=25) + (r.choices(["scum", "idiot"], k=2) if bad else [])
        r.shuffle(words)
        docs.append((i, " ".join(w.upper() + "!!" if junk else w for w in words), "p", 1))
        if i % 4:
            labels.append((i, 0 if junk else 1, int(bad)))
    labels += [(5000, 1, 1), (2, None, 1), (None, 1, 0)]
    df = spark.createDataFrame([*docs, (None, None, "", 0), (10**6, "", "", 0)], "doc_id long, text string, p_toxic string, toxic int")
    lab = toxicity.with_low_quality(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    chain = toxicity.fit(df, lab, ["low_quality", "toxic"])
    got = {x.doc_id: x for x in toxicity.predict(df, chain).collect()}
    assert np.mean([(got[i].p_toxic >= 0.5) == (i % 9 == 0) for i in range(900)]) > 0.98
    assert np.mean([(got[i].p_low_quality >= 0.5) == (i % 7 == 0) for i in range(900)]) > 0.98
    assert got[None].p_toxic < 0.5 and toxicity.keep(df, chain, "toxic").columns == df.columns
    none = toxicity.fit(df.limit(0), lab, ["low_quality", "toxic"])
    assert toxicity.predict(df, none).where("p_toxic > 0.01").count() == 0


SHARED = "/root/testdata"


def test_language_of_the_shared_documents_held_out(spark):
    docs = spark.read.parquet(f"{SHARED}/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 150 and np.mean([r.lang_pred == r.lang for r in got]) > 0.98


def test_toxicity_of_the_shared_documents_held_out(spark):
    docs = spark.read.parquet(f"{SHARED}/sf0.1/documents.parquet").select("doc_id", "text")
    labels = toxicity.with_low_quality(spark.read.parquet(f"{SHARED}/sf0.1/labels.parquet"))
    chain = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"), ["low_quality", "toxic"])
    test = labels.where("doc_id % 3 = 0").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic")
    got = toxicity.predict(docs.join(test, "doc_id"), chain).join(test, "doc_id").collect()
    found, wrong = ([r.p_toxic >= 0.5 for r in got if r.toxic == k] for k in (1, 0))
    assert len(found) > 100 and np.mean(found) > 0.8 and np.mean(wrong) < 0.01
