"""Odd tables for operators whose own tests hold none: ties, repeated rows, very long texts, clashing columns."""

import random

from foliant.llm import bpe, chat, langid, simhash, tokenfile, toxicity, warc
from foliant.llm.queries import vocabulary


def test_warc_with_a_very_long_page_and_without_ids(spark):
    rows = [(1, "http://a", "x" * 3_000_000), (None, "http://b", "y" * 2000), (None, "http://b", "y" * 2000), (2, None, None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id is None, r.payload_bytes) for r in got) == [(False, 0), (False, 3_000_000), (True, 2000), (True, 2000)]
    only = warc.round_trip(spark.createDataFrame([(None, "u", "z" * 1500)] * 2, "page_id long, url string, html string")).collect()
    assert len(only) == 2 and {r.payload_bytes for r in only} == {1500}


def test_chat_with_equal_turns_and_clashing_columns(spark):
    long = "long <|im_end|> \\ " * 20_000
    rows = [(1, 0, "user", "b", "v", 1), (1, 0, "user", "a", "v", 2), (1, 0, "assistant", long, "v", 3), (1, None, "system", None, "v", 4), (1, 0, "user", "a", "v", 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, loss int")
    read = chat.parsed(chat.formatted(df.select("conv_id", "turn", "role", "formatted", "loss", chat.text_part(df["text"]).alias("parts")))).first()
    assert [(t.role, t.text) for t in read.turns] == [("system", ""), ("assistant", long), ("user", "a"), ("user", "a"), ("user", "b")]
    assert read.loss_text == long


def test_language_ties_repeats_and_a_very_long_text(spark):
    r = random.Random(1)
    word = {"a": ["aba", "abba"], "b": ["cdc", "cddc"]}
    rows = [(i, " ".join(r.choice(word[k]) for _ in range(20)), k) for i in range(200) for k in [r.choice("ab")]]
    rows += [(5, "aba abba", "a")] * 3 + [(900, "aba " * 200_000, "a"), (901, "zzz yyy", None), (902, "aba cdc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(x.doc_id, x.lang_pred, x.score) for x in langid.predict(df, langid.fit(df)).collect()]
    assert len(got) == len(rows) and sum(d == 5 for d, *_ in got) == 4
    by = {d: (p, s) for d, p, s in got}
    assert by[900][0] == "a" and by[901] == ("a", 0.0) and by[902][0] in "ab"


def test_toxicity_of_repeats_contradictions_and_a_very_long_text(spark):
    rows = [(i, "scum idiot fool here" if i % 3 == 0 else "a kind word of thanks") for i in range(120)] + [(7, "a kind word of thanks")] * 2 + [(500, "kind words " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(120)] + [(1, 1, 1), (1, 0, 0)]
    chain = toxicity.fit(docs, toxicity.with_low_quality(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ["low_quality", "toxic"])
    got = [(x.doc_id, x.p_toxic >= 0.5) for x in toxicity.predict(docs, chain).collect()]
    assert len(got) == len(rows) and {t for d, t in got if d == 7} == {False}
    assert all(t == (d % 3 == 0) for d, t in got if d < 120)
    assert toxicity.predict(docs.limit(0), chain).collect() == []


def test_simhash_of_a_very_long_text_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(50_000)]
    other = list(words)
    other[100] = "changed"
    rows = [(2, " ".join(words), 1, "x"), (1, " ".join(other), 1, "x"), (3, "something else", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, fingerprint string")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()}
    assert got[1][1] == got[2][1] == 1 and got[3][1] == 3
    assert got[2][0] == format(simhash.simhash(" ".join(words)), "016x")


def test_token_files_of_several_segments_and_hot_ids(spark):
    rows = [(None, "no id"), (None, "none"), *[(7, f"text {i} " * 50) for i in range(40)], (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = tokenfile.round_trip(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows)
    at = sorted(got, key=lambda r: r.start)
    assert at[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(at, at[1:]))
    assert [r.doc_id for r in at] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))


def test_bpe_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same text")] * 3, "doc_id long, text string")
    got = bpe.digests(docs, vocabulary("word_bpe_49k.json")).collect()
    assert len(got) == 3 and len(set(map(tuple, got))) == 1
